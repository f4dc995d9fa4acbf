"""Removal of repeated byte strings by common-prefix interval trees of a sparse enhanced suffix array.

Every string of `width` bytes holds a smallest k-gram by hash (k = GRAM), at the same place in
each of its occurrences. Only suffixes that start at such a k-gram, an anchor, are kept: some
2 / (width - k + 2) of all. A repeated string shows up as two suffixes of one anchor k-gram whose
common prefix and common left extension come to `width` or more.

1. Scan tasks find anchors. Occurrences whose surroundings, as far as a string of `width` bytes that
   holds the anchor can reach, are byte for byte those of an earlier occurrence of the same stretch
   of the task are folded there: they are repeats throughout, and the earlier one stands for them.
   Hashes only bring them together. A passage that a third of all rows hold so goes on once from
   each stretch, not once from each row.
2. Rows meet by k-gram, sorted by the hash of their surroundings. The first of each kind of
   surroundings stands for the kind. Each other row claims that its bytes are those around the first;
   claims on one text at one distance that touch are joined to long ones, and each claim's bytes are
   fetched from both texts and compared. Only what is equal is a repeat throughout. (Different bytes
   of equal 64-bit hashes, should that happen, are kept.) K-grams with one kind are done.
3. The kinds of the others fetch their surroundings from the texts and are sorted by their suffixes:
   an enhanced suffix array. A stack scan over its common prefixes gives the interval tree. In each
   interval a second scan over the reversed left contexts tests how far they agree; each place where
   they begin to differ gives a maximal repeat with all its occurrences. The first stays.
4. A k-gram with more than `most` kinds, which bounds what a task holds, is first split by halves of
   the places that the anchor can have in the string. A half shares more bytes, which are a longer
   key, and has shorter surroundings, of which equal ones (compared as bytes) fold again; six
   halvings lead to single strings.

What is listed for a document (anchors, ranges) is bounded by its length.

Null texts are empty. Documents are in order of doc_id, null first; texts of one doc_id in order
of a hash of the text, where equal rows are one document and get one result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import blocks, discard, materialise, mix, prepare, release, running_sums, spread, sum_hashes, text_buffer

GRAM = 32
_NULL_ID = -(1 << 63)


def _slide(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over each w neighbours, in steps that double."""
    span = 1
    while span * 2 <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Places of anchors, their texts, hash of the k-gram, hash of the surroundings, bytes left and right that they take in."""
    n, w = len(data), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    sums = running_sums(data)
    at = np.arange(n - gram + 1)
    grams = sum_hashes(sums, at, at + gram) | np.uint64(1)
    least = _slide(grams, w, np.minimum)  # of the strings that start at 0 .. n - width
    edge = np.zeros(len(least) + 1, np.int32)
    long = np.diff(offsets) >= width
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - width + 1, -1)
    least[np.cumsum(edge[:-1]) == 0] = 0  # a string lies in one text
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    places = np.flatnonzero(_slide(padded, w, np.maximum)[: len(grams)] == grams)
    text = np.searchsorted(offsets, places, "right") - 1
    left = np.minimum(width - gram, places - offsets[text])
    right = np.minimum(width, offsets[text + 1] - places)
    around = mix(sum_hashes(sums, places - left, places + right) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
    return places, text, grams[places], around, left, right


def _merge(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the intervals of each document."""
    if not len(doc):
        return doc, sub, start, end
    order = np.lexsort((start, sub, doc))
    doc, sub, start, end = doc[order], sub[order], start[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (np.int64(1) << 32)) - group * (np.int64(1) << 32)
    fresh = new.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], sub[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


_ANCHOR = "gram long, around long, doc long, sub long, at long"
_NAMES = ["gram", "around", "doc", "sub", "at"]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], _NAMES)


def _equal_before(data: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray, step: int = 8192) -> np.ndarray:
    """Of the rows, those whose bytes data[start:start + size] are the bytes of the row before."""
    kept = [rows[:0]]
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        some = some[size[some] == size[some - 1]]
        if len(some):
            at = np.arange(size[some].max())
            here, before = (np.minimum(start[x][:, None] + at, len(data) - 1) for x in (some, some - 1))
            kept.append(some[((data[here] == data[before]) | (at >= size[some][:, None])).all(1)])
    return np.concatenate(kept)


def _scan(width: int, stretch: int = 1 << 19):
    """Rows (gram, around, doc, sub, at): at is the anchor's place * 256 + the bytes right of it; or, for repeats that a stretch of the task found alone, -1 - start, with around the stop and gram any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[bytes] = []
        size = length = 0

        def fold() -> Iterator[pa.RecordBatch]:
            gram, around, doc, sub, at, left, right, start = (np.concatenate(c) for c in zip(*held, strict=True))
            data = np.frombuffer(b"".join(texts), np.uint8)
            held.clear()
            texts.clear()
            order = np.lexsort((at, sub, doc, around, gram))
            gram, around, doc, sub, at, left, right, start = (c[order] for c in (gram, around, doc, sub, at, left, right, start))
            alike = 1 + np.flatnonzero((gram[1:] == gram[:-1]) & (around[1:] == around[:-1]) & (left[1:] == left[:-1]))
            again = np.zeros(len(gram), np.bool_)
            again[_equal_before(data, start, left + right, alike)] = True
            kept = ~again
            yield _batch(*(c[kept] for c in (gram, around, doc, sub, at << 8 | right)))
            d, s, begin, end = _merge(doc[again], sub[again], at[again] - left[again], at[again] + right[again])
            if len(d):
                yield _batch(mix(d.view(np.uint64)), end, d, s, -1 - begin)

        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            docs, subs = batch.column("doc").to_numpy(), batch.column("sub").to_numpy()
            for i, j in blocks(offsets):
                part = np.frombuffer(data, np.uint8, offsets[j] - offsets[i], offsets[i])
                begin = offsets[i : j + 1] - offsets[i]
                places, text, gram, around, left, right = anchors(part, begin, width)
                held.append((gram.view(np.int64), around.view(np.int64), docs[i + text], subs[i + text], places - begin[text], left, right, length + places - left))
                texts.append(part.tobytes())
                size += len(places)
                length += len(part)
                if size > stretch:
                    yield from fold()
                    size = length = 0
        if held:
            yield from fold()

    return run


_FOUND = "gram long, doc long, sub long, start long, stop long"
_KINDS = _FOUND + ", first_doc long, first_sub long, shift long"


def _found(gram, doc, sub, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (gram, doc, sub, start, stop)], ["gram", "doc", "sub", "start", "stop"])


def _kind_rows(gram, doc, sub, start, stop, *first) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c, np.int64)) for c in (gram, doc, sub, start, stop, *first)]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(columns[0]), pa.int64())] * (8 - len(columns)), ["gram", "doc", "sub", "start", "stop", "first_doc", "first_sub", "shift"])


def _kinds(width: int):
    """Rows sorted by (gram, around, doc, sub, at). Gives repeats (start, stop); claims, which have first_doc, first_sub and shift, the distance to the first's place; and the first of each kind of a gram with two kinds or more (start -1, stop its place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (gram, around, doc, sub, place) of the last kind's first row
        gone = False  # whether that was given out
        for batch in batches:
            gram, around, doc, sub, at = (batch.column(c).to_numpy() for c in _NAMES)
            own = at < 0
            if own.any():
                yield _kind_rows(gram[own], doc[own], sub[own], -1 - at[own], around[own])
                gram, around, doc, sub, at = (c[~own] for c in (gram, around, doc, sub, at))
            if not len(gram):
                continue
            place, right = at >> 8, at & 255
            if last is not None:  # the last kind's first row goes before all
                gram, around, doc, sub, place = (np.append(np.int64(x), c) for x, c in zip(last, (gram, around, doc, sub, place), strict=True))
                right = np.append(np.int64(0), right)
            same_gram = np.append(False, gram[1:] == gram[:-1])
            again = same_gram & np.append(False, around[1:] == around[:-1])
            heads = np.flatnonzero(~again)
            head = heads[np.cumsum(~again) - 1][again]
            yield _kind_rows(np.zeros(int(again.sum())), doc[again], sub[again], place[again] - np.minimum(place[again], width - GRAM), place[again] + right[again], doc[head], sub[head], place[head] - place[again])
            several = np.append(False, gram[heads[1:]] == gram[heads[:-1]])
            several[:-1] |= several[1:]
            give = several.copy()
            if last is not None and gone:
                give[0] = False
                if len(heads) == 1:
                    several[0] = True
            give = heads[give]
            if len(give):
                yield _kind_rows(gram[give], doc[give], sub[give], np.full(len(give), -1), place[give])
            at_end = heads[-1]
            last, gone = (gram[at_end], around[at_end], doc[at_end], sub[at_end], place[at_end]), bool(several[-1])

    return run


def _joined(claims: DataFrame) -> DataFrame:
    """Claims of one text on another at one distance that touch, as one."""
    same = ["doc", "sub", "first_doc", "first_sub", "shift"]
    order = Window.partitionBy(*same).orderBy("start")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = claims.select(*same, "start", "stop", (F.col("start") > before).cast("int").alias("apart"))
    runs = parted.withColumn("run", F.sum(F.coalesce("apart", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*same, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _proved(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(gram, doc, sub, start, stop) of the claims whose bytes are equal in both texts. Bytes travel to the first text, once for each claim; the texts are shuffled once for both joins."""
    part = lambda at: F.expr(f"substring(data, cast({at} + 1 as int), cast(stop - start as int))")
    texts = docs.select("doc", "sub", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    named = claims.join(texts, ["doc", "sub"]).withColumn("bytes", part("start")).drop("data")
    firsts = texts.select(F.col("doc").alias("first_doc"), F.col("sub").alias("first_sub"), "data")
    both = named.join(firsts, ["first_doc", "first_sub"]).filter(F.col("bytes") == part("start + shift"))
    return both.select(F.lit(0).cast("long").alias("gram"), "doc", "sub", "start", "stop")


def _with_gram(merged: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return (np.zeros(len(merged[0]), np.int64), *merged)


_CONTEXT = "gram binary, doc long, sub long, place long, rest binary, left binary, lo int, hi int"
_CONTEXT_NAMES = ["gram", "doc", "sub", "place", "rest", "left", "lo", "hi"]


def _contexts(width: int):
    """Suffixes and reversed left contexts, as far as a string that holds the anchor reaches, of the anchors listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            out: list[list] = [[] for _ in range(6)]
            for doc, sub, marks, a, b in zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), batch.column("marks").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for m in marks:
                    place = m["at"]
                    here = a + place
                    for column, x in zip(out, (m["gram"].to_bytes(8, "big", signed=True), doc, sub, place, data[here : min(b, here + width)], data[max(a, here - width + GRAM) : here][::-1]), strict=True):
                        column.append(x)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, width - GRAM + 1, np.int32))], _CONTEXT_NAMES)

    return run


def common_prefixes(strings: list[bytes], width: int) -> list[int]:
    """Length of the common prefix of each string and the one before it, `width` at most; 0 for the first."""
    out = [0] * min(1, len(strings))
    for a, b in zip(strings, strings[1:]):
        low, high = 0, min(len(a), len(b), width)
        if a[:high] != b[:high]:
            while high - low > 1:  # low bytes agree, high don't
                middle = (low + high) // 2
                if a[low:middle] == b[low:middle]:
                    low = middle
                else:
                    high = middle
            high = low
        out.append(high)
    return out


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """The interval tree of a sorted run by a stack scan: (first, last, depth, depth of the parent) of each interval of two or more."""
    stack = [(0, 0)]  # (depth, first)
    for i in range(1, len(prefixes) + 1):
        depth = prefixes[i] if i < len(prefixes) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if i - 1 > first:
                yield first, i - 1, top, max(depth, stack[-1][0] if stack else -1)
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(rest: list[bytes], left: list[bytes], width: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, all members) of repeats of width or more around the anchor.

    rest is sorted; left holds reversed contexts. Only strings with the anchor at lo .. hi - 1 count."""
    hi = width + 1 if hi is None else hi
    for first, last, depth, parent in intervals(common_prefixes(rest, width)):
        shortest, longest = max(lo, width - depth), min(hi - 1, width - max(parent, 0) - 1)
        if shortest > longest:
            continue
        members = sorted(range(first, last + 1), key=lambda i: left[i])
        agree = common_prefixes([left[i] for i in members], width)
        for a, b, same, above in intervals(agree):
            reach = min(same, longest)
            if reach >= shortest and reach > min(above, longest):
                yield reach, width - shortest, [members[i] for i in range(a, b + 1)]


def _solve(width: int):
    """Rows sorted by (gram, rest); one gram's rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            if len(rows) < 2:
                return
            rest, left = [r[3] for r in rows], [r[4] for r in rows]
            for back, ahead, members in maximal_repeats(rest, left, width, rows[0][5], rows[0][6]):
                keep = min(members, key=lambda i: rows[i][:3])
                out.extend((rows[i][0], rows[i][1], rows[i][2] - back, rows[i][2] + ahead) for i in members if i != keep)

        def give() -> pa.RecordBatch:
            columns = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            out.clear()
            return _found(*_with_gram(_merge(*columns)))

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
                if g != key:
                    close()
                    key, rows = g, []
                rows.append(row)
            if len(out) > 50_000:
                yield give()
        close()
        yield give()

    return run


def _halve(width: int):
    """Members of grams with too many kinds, twice: with the anchor in the earlier and in the later half of its places. The bytes that a half shares make the key longer; surroundings are cut to what the half can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, doc, sub, place, rest, left, lo, hi in zip(*(batch.column(c).to_pylist() for c in _CONTEXT_NAMES), strict=True):
                middle = (lo + hi) // 2
                for a, b in ((lo, middle), (middle, hi)):
                    if a < b and len(left) >= a and len(rest) >= width - b + 1:
                        key = hashlib.blake2b(gram + bytes([a, b]) + left[:a] + b"|" + rest[: width - b + 1], digest_size=16).digest()
                        out.append((key, doc, sub, place, rest[: width - a], left[: b - 1], a, b))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], _CONTEXT_NAMES)

    return run


def _split_hot(contexts: DataFrame, width: int, most: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(contexts with no gram of more than most members, repeats found on the way, tables that both read)."""
    done, found, tables = [], [], [contexts]
    for _ in range((width - GRAM).bit_length() + 1):
        sizes = contexts.groupBy("gram").agg(F.count("*").alias("size"), F.max("hi").alias("h"), F.max("lo").alias("l"))
        large = sizes.filter((F.col("size") > most) & (F.col("h") - F.col("l") > 1)).select("gram")
        if not large.head(1):
            break
        done.append(contexts.join(large, "gram", "left_anti"))
        halves = materialise(contexts.join(large, "gram").select(*_CONTEXT_NAMES).mapInArrow(_halve(width), _CONTEXT), "suffix-halves")
        first = F.min(F.struct("doc", "sub", "place"))
        kinds = halves.groupBy("gram", "rest", "left").agg(first.alias("first"))
        marked = halves.join(kinds, ["gram", "rest", "left"])
        is_first = F.struct("doc", "sub", "place") == F.col("first")
        found.append(marked.filter(~is_first).select(F.lit(0).cast("long").alias("gram"), "doc", "sub", (F.col("place") - F.length("left")).alias("start"), (F.col("place") + F.length("rest")).alias("stop")))
        several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
        contexts = materialise(marked.filter(is_first).join(several, "gram").select(*_CONTEXT_NAMES), "suffix-contexts")
        tables += [halves, contexts]
        release(contexts.sparkSession)
    for d in done:
        contexts = contexts.unionByName(d)
    return contexts, found, tables


def repeated_spans(docs: DataFrame, width: int = 100, most: int = 65_536) -> DataFrame:
    """A table with (doc, sub, start, stop): byte ranges to remove, overlapping ones too, of the documents that numbered() gives."""
    spark = docs.sparkSession
    n = spread(docs)
    rows = docs.mapInArrow(_scan(width), _ANCHOR).repartition(n, "gram").sortWithinPartitions(*_NAMES)
    found = materialise(rows.mapInArrow(_kinds(width), _KINDS), "suffix-kinds")
    release(spark)
    claims = materialise(_joined(found.filter("first_doc is not null").repartition(n, "doc", "sub", "first_doc", "first_sub", "shift")), "suffix-claims")
    release(spark)
    proved = materialise(_proved(claims, docs), "suffix-proved")
    discard(claims)
    release(spark)
    marks = found.filter("start = -1").groupBy("doc", "sub").agg(F.collect_list(F.struct("gram", F.col("stop").alias("at"))).alias("marks"))
    contexts = materialise(docs.join(marks, ["doc", "sub"]).select("doc", "sub", "text", "marks").mapInArrow(_contexts(width), _CONTEXT), "suffix-contexts")
    release(spark)
    contexts, more, tables = _split_hot(contexts, width, most)
    repeats = contexts.repartition(n, "gram").sortWithinPartitions("gram", "rest").mapInArrow(_solve(width), _FOUND)
    for m in more:
        repeats = repeats.unionByName(m)
    alone = found.filter("start >= 0 and first_doc is null").select("gram", "doc", "sub", "start", "stop")
    spans = materialise(repeats.unionByName(alone).unionByName(proved), "suffix-repeats")
    discard(found, proved, *tables)
    release(spark)
    return spans


def numbered(docs: DataFrame) -> DataFrame:
    """docs with doc (doc_id, null first of all) and sub (0, or a hash of the text where some doc_id comes twice), which name a document."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").head(1)
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(_NULL_ID)), "sub": F.xxhash64(F.coalesce("text", F.lit(""))) if again else F.lit(0).cast("long")})


def union(spans: list | None) -> list[tuple[int, int]]:
    """Disjoint ascending ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _with_spans(docs: DataFrame, width: int, most: int, *columns: str) -> DataFrame:
    prepare(docs.sparkSession)
    table = numbered(docs.select(*dict.fromkeys(["doc_id", "text", *columns])))
    once = table.select("doc", "sub", "text")
    if once.groupBy("doc", "sub").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        once = once.dropDuplicates(["doc", "sub"])  # else a row would be a later copy of its equal
    repeats = repeated_spans(once, width, most)
    spans = materialise(repeats.groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans")
    discard(repeats)
    release(docs.sparkSession)
    return table.join(spans, ["doc", "sub"], "left")


def suffix_dedup(docs: DataFrame, width: int = 100, most: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row: without each byte that a string of width bytes covers which also starts earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            rows = []
            for spans, a, b in zip(batch.column("spans").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                gone = union(spans)
                rows.append((b - a, sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept_bytes(data[a:b], gone)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, width, most).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 100, most: int = 65_536) -> DataFrame:
    """The documents with their repeated strings taken out, all columns of documents kept; n_chars is that of the new text.

    A character that is removed in part goes whole. Rows of which only white space is left go, if anything was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            texts = []
            for spans, old, a, b in zip(batch.column("spans").to_pylist(), batch.column("text").is_null().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                gone = union(spans)
                texts.append(None if old else kept_bytes(data[a:b], gone).decode("utf-8", "ignore"))
            keep = pa.array([not s or bool(t and t.strip()) for s, t in zip(batch.column("spans").to_pylist(), texts, strict=True)])
            sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), sizes], ["doc_id", "text", "lang", "source", "n_chars"])
            yield out.filter(keep)

    return _with_spans(docs, width, most, "lang", "source").select("doc_id", "text", "lang", "source", "spans").mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
