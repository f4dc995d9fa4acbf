import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import bpe, packing, sstable, token_counts, tokens
from quarrylight.llm.common import text_buffer
from tests.llm.rows import documents, many, odd_texts, texts

P = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def library(path, rows):
    return [e.ids for e in tokens._library(path).encode_batch([t or "" for t in rows], add_special_tokens=False)]


def words(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path, make", [(WORD, tokens.word_bpe), (BYTE, tokens.byte_bpe)])
def test_chunked_ids_are_the_librarys(path, make):
    rows = texts() + odd_texts(3000, 9)
    flat, first = make(path).ids(*text_buffer(pa.array(rows, pa.string())))
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:])] == library(path, rows)


def test_cache_that_overflows_still_gives_the_same_ids():
    rows = texts()
    encoder = tokens.Encoder(tokens.split_words, tokens._by_library(WORD, True), lower=True, words=50)
    for part in (rows[:30], rows[30:60], rows[:30]):
        flat, first = encoder.ids(*text_buffer(pa.array(part, pa.string())))
        assert [flat[a:b].tolist() for a, b in zip(first, first[1:])] == library(WORD, part)


def test_piece_counts_are_the_librarys():
    import sentencepiece

    rows = texts() + odd_texts(3000, 11)
    got = np.diff(tokens.piece_bpe(PIECE).counts(*text_buffer(pa.array(rows, pa.string()))))
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert got.tolist() == [len(processor.encode(t or "")) for t in rows]


def test_segment_tree_bpe_encodes_and_decodes_as_the_library():
    rows = texts() + odd_texts(2000, 3)
    own, tokenizer = bpe.WordBpe(WORD), tokens._library(WORD)
    want = library(WORD, rows)
    assert [own.encode(t or "") for t in rows] == want
    assert [own.decode(i) for i in want] == [tokenizer.decode(i, skip_special_tokens=False) for i in want]


@given(st.lists(st.integers(0, 3), max_size=40), st.permutations([(a, b) for a in range(4) for b in range(4)]))
@settings(max_examples=60, deadline=None)
def test_merge_is_leftmost_lowest(symbols, order):
    pairs = {p: (r, 4 + r) for r, p in enumerate(order)} | {(4, 5): (16, 30), (5, 4): (17, 31), (4, 4): (18, 32)}
    plain = list(symbols)
    while found := [(pairs[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in pairs]:
        _, i = min(found)
        plain[i : i + 2] = [pairs[plain[i], plain[i + 1]][1]]
    assert bpe.merge(list(symbols), pairs) == plain


def test_encode_and_decode_query(spark):
    rows = many(spark)
    got = sorted(tuple(r) for r in bpe.encode_and_decode(documents(spark, rows), WORD).collect() if r["doc_id"] is not None)
    ids = library(WORD, [t for _, t in rows])
    decode = tokens._library(WORD).decode
    want = sorted((i, len(x), hashlib.sha256(words(x)).hexdigest(), hashlib.sha256(decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, ids) if i is not None)
    assert got == want


def test_shards_round_trip(spark):
    rows = many(spark)
    df = sstable.token_table(documents(spark, rows), lambda: tokens.word_bpe(WORD), 2, 49_408, shards=5)
    ids = [x + [2] for x in library(WORD, [t for _, t in rows])]
    order = sorted(range(len(rows)), key=lambda k: (-1 if rows[k][0] is None else rows[k][0]))
    want, at = [], 0
    for k in order:
        want.append((rows[k][0], at, len(ids[k]), zlib.crc32(words(ids[k]))))
        at += len(ids[k])
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_shard_lookup_finds_every_key_and_no_other():
    keys = [None, -5, -1, 0, 1, 7, 255, 256, 1 << 40, (1 << 63) - 1]
    values = [np.arange(i, 3 * i + 1, dtype="<u2") for i in range(len(keys))]
    writer, out = sstable.Writer(3, 2, block_bytes=20), []
    for k, v in zip(keys, values):
        if (block := writer.add(sstable.key_of(k), v.tobytes())) is not None:
            out.append(block)
    out += writer.finish()
    reader = sstable.Reader(b"".join(s + b"\n" for s in out))
    assert len(reader.blocks) > 2 and reader.shard == 3 and reader.documents == len(keys)
    for k, v in zip(keys, values):
        assert reader.get(k).tolist() == v.tolist()
    assert all(reader.get(k) is None for k in (2, 3, 1 << 41, -7, 254))
    assert [sstable.id_of(k) for k, _ in reader] == keys
    with pytest.raises(ValueError):
        sstable.Reader(b"".join(out)[:-3] + b"abcd\n")


def test_counts_come_from_the_cache_the_second_time(spark, tmp_path):
    import sentencepiece

    rows = many(spark)
    docs, cache = documents(spark, rows), f"file://{tmp_path}/cache"
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    n = [len(processor.encode(t or "")) for _, t in rows]
    want = sorted(((i, len((t or "").encode()), k, k > 40) for (i, t), k in zip(rows, n)), key=str)
    for more in (0, 0):
        got = token_counts.token_counts(docs, PIECE, cache, limit=40)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + more
    extra = documents(spark, [(1, "an altogether new text"), (2, rows[0][1])])
    assert token_counts.token_counts(extra, PIECE, cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1


def check_packing(got, rows, capacity, ids):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    for (i, _), x in zip(rows, ids):
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(mine):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(words(x[at : at + r["length"]]))
            at += r["length"]
        assert at == len(x)
    return len(places)


def test_packing_places_every_piece_once(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = packing.pack(documents(spark, rows), lambda: tokens.byte_bpe(BYTE), 2, 256).collect()
    ids = [x + [2] for x in library(BYTE, [t for _, t in rows])]
    n = check_packing(got, rows, 256, ids)
    assert n <= 1.03 * -(-sum(map(len, ids)) // 256) + 1


def test_packing_takes_repeated_rows_and_rows_without_id(spark):
    rows = [*many(spark), (None, None), (None, "no id"), (5, "another text of the same id " * 40)]
    ids = [x + [2] for x in library(BYTE, [t for _, t in rows])]
    want = []
    for (i, _), x in zip(rows, ids):
        head = len(x) - (-(-len(x) // 256) - 1) * 256
        cuts = [0, *range(head, len(x) + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(words(x[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack(documents(spark, rows), lambda: tokens.byte_bpe(BYTE), 2, 256).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        ends = [a + n for a, n in sorted(place)]
        assert [a for a, _ in sorted(place)] == [0, *ends[:-1]] and ends[-1] <= 256


def few_lengths():
    r = random.Random(1)
    return [{500: 10**6, 270: 10**6, 235: 10**6}, {600: 500, 400: 700}, {341: 999, 342: 999}, *({r.randint(20, 700): r.randint(1000, 10**5) for _ in range(r.randint(2, 6))} for _ in range(12))]


@pytest.mark.parametrize("histogram", few_lengths())
def test_few_lengths_come_near_the_bound(histogram):
    patterns, bound = packing.plan(histogram, 1024)
    placed = defaultdict(int)
    for times, items in patterns:
        for s, n in items:
            placed[s] += times * n
    used = sum(t for t, _ in patterns)
    assert dict(placed) == histogram and bound <= used + 1e-6 and used <= bound + 2 * len(histogram)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
@settings(max_examples=40, deadline=None)
def test_plan_covers_the_histogram(histogram):
    patterns, bound = packing.plan(histogram, 64)
    placed = defaultdict(int)
    for times, items in patterns:
        assert times > 0 and sum(s * n for s, n in items) <= 64
        for s, n in items:
            placed[s] += times * n
    assert dict(placed) == histogram
    used = sum(t for t, _ in patterns)
    assert bound <= used + 1e-6
    ffd = first_fit(histogram, 64)
    assert used <= 1.02 * ffd + 2


def lengths_of(folder):
    """How many pieces of each length a table's texts give."""
    texts = [t or "" for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    out = defaultdict(int)
    for ids in library(BYTE, texts):
        n = len(ids) + 1
        out[n - (-(-n // 1024) - 1) * 1024] += 1
        out[1024] += -(-n // 1024) - 1
    return dict(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("times", [1, 48])
def test_plan_of_real_lengths_comes_near_the_bound_by_priced_patterns(times):
    histogram = {s: times * n for s, n in lengths_of("/root/testdata/sf0.1").items()}
    patterns, bound = packing.plan(histogram, 1024)
    placed = defaultdict(int)
    for n, items in patterns:
        for s, m in items:
            placed[s] += n * m
    assert {s: n for s, n in placed.items() if n} == {s: n for s, n in histogram.items() if n}
    used = sum(n for n, _ in patterns)
    assert bound <= used <= bound * 1.0005 and used <= greedy(histogram, 1024)


@pytest.mark.parametrize("low, high, kinds, pieces", [(300, 520, 150, 9000), (200, 700, 200, 9000), (340, 700, 300, 900), (500, 600, 80, 900), (1, 1023, 900, 5000), (330, 520, 120, 3000), (250, 400, 100, 999)])
def test_plan_is_no_worse_than_greedy(low, high, kinds, pieces):
    r = random.Random(low)
    sizes, histogram = r.sample(range(low, high), kinds), defaultdict(int)
    for _ in range(pieces):
        histogram[r.choice(sizes)] += 1
    patterns, bound = packing.plan(histogram, 1024)
    used = sum(n for n, _ in patterns)
    assert bound <= used + 1e-6 and used <= greedy(histogram, 1024)


def greedy(histogram, capacity):
    """Best fit from the largest length down, each time with the one or two lengths more that leave least room."""
    have, used = dict(histogram), 0
    while sizes := sorted((s for s, n in have.items() if n), reverse=True):
        pattern, room = [sizes[0]], capacity - sizes[0]
        while there := [s for s in sizes if s <= room and have[s] > pattern.count(s)]:
            pick = there[0]
            for s in there if pick < room else ():
                if s < room and have.get(room - s, 0) > pattern.count(room - s) + (2 * s == room):
                    pick = s
                    break
            pattern.append(pick)
            room -= pick
        times = min(have[s] // pattern.count(s) for s in pattern)
        for s in set(pattern):
            have[s] -= times * pattern.count(s)
        used += times
    return used


def first_fit(histogram, capacity):
    rooms = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        for i, r in enumerate(rooms):
            if r >= s:
                rooms[i] -= s
                break
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [])
    assert packing.pack(docs, lambda: tokens.byte_bpe(BYTE), 2).collect() == []
    assert sstable.token_table(docs, lambda: tokens.word_bpe(WORD), 2, 49_408).collect() == []
    assert token_counts.token_counts(docs, PIECE, f"file://{tmp_path}/c").collect() == []
    assert bpe.encode_and_decode(docs, WORD).collect() == []
