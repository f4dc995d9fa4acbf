import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrylight.llm import embedding_dedup, exact_dedup, graph, jaccard_join, suffix_dedup
from tests.llm.rows import documents, many, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(LOWER)


@pytest.mark.parametrize("key_bits", [62, 3])
def test_exact_dedup(spark, key_bits):
    rows = many(spark)
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    got = exact_dedup.exact_dedup(documents(spark, rows), key_bits=key_bits, bucket_bytes=4000, flush_bytes=5000).collect()
    ids = lambda g: [i for i in g if i is not None]
    want = [(i, max(ids(groups[low(t)]), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows]
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == sorted(want, key=str)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_directory_splits_only_what_is_full():
    weights = np.array([1, 1, 1, 1, 40, 1, 1, 1.0])
    depth, slots, sizes = exact_dedup.directory(weights, 3, 5)
    assert depth == 3 and sizes.tolist() == [4, 40, 1, 2] and slots.tolist() == [0, 0, 0, 0, 1, 2, 3, 3]
    assert exact_dedup.directory(np.array([3.0, 1]), 1, 10)[0] == 0


def words(t):
    return [w for w in low(t).encode().replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]


def grams(t, n):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((doc_id, len(sets[i]), least.get(root(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows) if doc_id is not None)


def families(seed, n=160):
    """Chains of edited copies, so that components hold pairs that are far apart, and strangers that share a passage."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 200]))]
        for _ in range(n // 8):
            copy = list(r.choice([base, out[-1].split() if out and r.random() < 0.5 else base]))
            for _ in range(r.randint(0, 3)):
                if len(copy) > 3:
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join([*passage, *(r.choice(vocabulary) for _ in range(8))]) for _ in range(n // 4)]
    return out


@pytest.mark.parametrize("n, num, den, options", [(3, 90, 100, {}), (5, 80, 100, {}), (3, 80, 100, {"most": 6000, "fan": 3, "levels": 2}), (3, 90, 100, {"most": 3000, "levels": 0}), (2, 90, 100, {"heavy": 0}), (3, 80, 100, {"most": 2000, "levels": 5})])
def test_jaccard_join(spark, n, num, den, options):
    rows = [r for r in many(spark) if r[0] is not None and r[0] != 5][:80] + [(20_000 - k, t) for k, t in enumerate(families(n))]
    got = jaccard_join.jaccard_classes(documents(spark, rows), n, num, den, **options)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, num, den)


def test_rows_without_id_connect_others(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[:40]), " ".join(base[2:42]), " ".join(base[4:44]), " ".join(base[6:46])]
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[2]), (4, chain[3]), (9, "something else altogether"), (None, "x" * 50), (None, None)]
    got = jaccard_join.jaccard_classes(documents(spark, rows), 3, 85, 100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted([("1", 38, "1"), ("None", 38, "1"), ("None", 38, "1"), ("4", 38, "1"), ("9", 1, "9"), ("None", 1, "None"), ("None", 0, "None")])


def tree(k, links):
    parent = list(range(k))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[root(i)] = root(j)
    return [root(i) for i in range(k)]


@pytest.mark.parametrize("num, fan", [(90, 8), (80, 2), (80, 1), (60, 5), (30, 8)])
def test_voronoi_regions_keep_every_component(num, fan):
    r = np.random.default_rng(num + fan)
    sets, middles = [], [r.integers(0, 10**6, 60, dtype=np.uint64) for _ in range(12)]
    for _ in range(200):
        s = middles[r.integers(12)].copy()
        s[: r.integers(0, 12)] = 0
        s[r.integers(0, 60, r.integers(0, 20))] = r.integers(0, 10**6, dtype=np.uint64)
        sets.append(np.unique(s))
    sets += [np.unique(np.append(r.integers(0, 10**6, 50, dtype=np.uint64), middles[0][:8])) for _ in range(60)]  # strangers that share a passage
    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= num * (len(sets[i]) + len(sets[j]) - both)]
    seen = []
    got = jaccard_join.region_links(sets, num, 100, fan, seen=seen)
    assert set(map(frozenset, got)) <= set(map(frozenset, want)) and len(got) < len(sets)
    a, b = tree(len(sets), got), tree(len(sets), want)
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b)))
    assert len(seen) > 1 and all(n <= jaccard_join.OVERLAP * size for size, parts, n in seen)


def test_regions_are_split_again():
    """Two far groups of chains: the first step tells the groups apart, later ones the chains within."""
    sets = [np.arange(g * 1000 + 3 * c, g * 1000 + 3 * c + 40, dtype=np.uint64) for g in range(2) for c in range(30)]
    seen = []
    links = jaccard_join.region_links(sets, 80, 100, 4, seen=seen)
    assert len(set(tree(60, links))) == 2 and len(links) == 58 and max(parts for _, parts, _ in seen) > 1 and len(seen) > 4


def test_jaccard_join_takes_odd_rows(spark):
    rows = many(spark)
    got = jaccard_join.jaccard_classes(documents(spark, rows), 3, 90, 100).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[5, len(grams(rows[5][1], 3))] == 5


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 50)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(90)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x["node"]: x["component"] for x in got} == {i: root(i) for i in list(parent)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_spans(rows, width):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = [False] * len(b)
        for p in range(len(b) - width + 1):
            if (w := b[p : p + width]) in seen:
                mark[p : p + width] = [True] * width
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(m and not p for m, p in zip(mark, [False, *mark])), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice("abcé \n") for _ in range(k))
    common = [make(r.choice([70, 90, 130, 300])) for _ in range(4)]
    out = []
    for _ in range(40):
        out.append("".join(r.choice([make(r.randint(1, 80)), r.choice(common), r.choice(common)[r.randint(0, 40) :]]) for _ in range(r.randint(1, 7))))
    return [*out, "z" * 700, "ab" * 300, common[3] * 4, "q" * 99, "q" * 100, "q" * 100]


@pytest.mark.parametrize("most", [65_536, 2])
def test_suffix_dedup(spark, most):
    rows = [(i, t) for i, t in many(spark) if i is not None and i != 5] + [(5000 + i, t) for i, t in enumerate(passages(4))]
    got = suffix_dedup.suffix_dedup(documents(spark, rows), 100, most)
    assert sorted(map(tuple, got.collect())) == brute_spans(rows, 100)


def test_suffix_dedup_takes_odd_rows(spark):
    rows = many(spark)
    got = suffix_dedup.suffix_dedup(documents(spark, rows)).collect()
    assert len(got) == len(rows) and len({tuple(r) for r in got if r["doc_id"] == 5}) == 1
    left = suffix_dedup.without_repeats(documents(spark, rows)).collect()
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in left)
    assert any(r["text"] is None for r in left)


@pytest.mark.parametrize("most", [65_536, 2])
def test_suffix_dedup_keeps_rows_that_come_twice(spark, most):
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh ") for _ in range(700))
    once = [(1, "head " + long[:300]), (2, long), (3, "tail " + long[200:]), (4, "short"), (6, long[::-1])]
    rows = [*once, once[1], once[4], once[4], once[3]]
    want = {r[0]: r for r in brute_spans(once, 100)}
    got = suffix_dedup.suffix_dedup(documents(spark, rows), 100, most).collect()
    assert sorted(map(tuple, got)) == sorted(want[i] for i, _ in rows) and 0 < want[2][2] < 700
    left = suffix_dedup.without_repeats(documents(spark, rows), 100, most).collect()
    assert sorted((x["doc_id"], hashlib.sha256(x["text"].encode()).hexdigest()) for x in left) == sorted((i, want[i][4]) for i, _ in rows if want[i][2] < want[i][1])


def test_scan_folds_on_bytes(monkeypatch):
    """Where all surroundings hash alike and hardly any k-gram is told apart, a task folds nothing that differs, and the tree finds all."""
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(0))
    plain = suffix_dedup.sum_hashes
    monkeypatch.setattr(suffix_dedup, "sum_hashes", lambda *a: plain(*a) >> np.uint64(55))
    rows = list(enumerate(passages(11)))
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for _, t in rows]), pa.array([i for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64())], ["text", "doc", "sub"])
    found = [r for b in suffix_dedup._scan(100)(iter([batch])) for r in b.to_pylist()]
    marks, spans = defaultdict(list), defaultdict(list)
    for r in found:
        if r["at"] < 0:
            spans[r["doc"]].append((-1 - r["at"], r["around"]))
        else:
            marks[r["doc"]].append({"gram": r["gram"], "at": r["at"] >> 8})
    listed = pa.RecordBatch.from_arrays([pa.array([rows[i][1].encode() for i in marks]), pa.array(list(marks), pa.int64()), pa.array([0] * len(marks), pa.int64()), pa.array(list(marks.values()))], ["text", "doc", "sub", "marks"])
    contexts = pa.Table.from_batches(list(suffix_dedup._contexts(100)(iter([listed])))).sort_by([("gram", "ascending"), ("rest", "ascending")])
    for b in suffix_dedup._solve(100)(iter(contexts.to_batches())):
        for r in b.to_pylist():
            spans[r["doc"]].append((r["start"], r["stop"]))
    for i, _, gone, n, _ in brute_spans(rows, 100):
        merged = suffix_dedup.union([{"start": a, "stop": b} for a, b in spans[i]])
        assert (sum(b - a for a, b in merged), len(merged)) == (gone, n)


def test_kinds_are_the_same_however_batches_are_cut():
    r = random.Random(2)
    rows = sorted((r.randint(0, 12), r.randint(0, 3), r.randint(0, 30), 0, r.randint(0, 50) << 8 | 40) for _ in range(300))
    rows += [(99, 150, 4, 0, -1 - 7)]
    want = None
    for size in (300, 301, 7, 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], suffix_dedup._NAMES) for i in range(0, len(rows), size)]
        got = sorted((tuple(x.values()) for b in suffix_dedup._kinds(100)(iter(batches)) for x in b.to_pylist()), key=str)
        want = want or got
        assert got == want
    firsts = {}
    for gram, around, doc, sub, at in rows[:-1]:
        firsts.setdefault((gram, around), (doc, sub, at >> 8))
    kinds = [(g, *v) for (g, _), v in firsts.items() if sum(h == g for h, _ in firsts) > 1]
    assert sorted((g, d, s, stop) for g, d, s, start, stop, f, *_ in want if start == -1) == sorted(kinds)
    assert sum(f is not None for *_, f, _, _ in want) == 300 - len(firsts) and (99, 4, 0, 7, 150, None, None, None) in want


def test_claims_are_joined_and_proved(spark):
    texts = [(1, "abcdefghij" * 5), (2, "xx" + "abcdefghij" * 4), (3, "abcdefghiX" * 4)]
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts], "doc long, sub long, text string")
    claims = [(2, 0, 2, 22, 1, 0, -2), (2, 0, 12, 42, 1, 0, -2), (2, 0, 2, 12, 1, 0, 8), (3, 0, 0, 20, 1, 0, 0), (3, 0, 30, 39, 1, 0, 0)]
    joined = suffix_dedup._joined(spark.createDataFrame(claims, "doc long, sub long, start long, stop long, first_doc long, first_sub long, shift long"))
    assert sorted((r["doc"], r["start"], r["stop"], r["shift"]) for r in joined.collect()) == [(2, 2, 12, 8), (2, 2, 42, -2), (3, 0, 20, 0), (3, 30, 39, 0)]
    proved = suffix_dedup._proved(joined, docs).collect()
    assert sorted((r["doc"], r["start"], r["stop"]) for r in proved) == [(2, 2, 12), (2, 2, 42), (3, 30, 39)]


def test_common_prefixes():
    assert suffix_dedup.common_prefixes([], 9) == [] and suffix_dedup.common_prefixes([b"a"], 9) == [0]
    assert suffix_dedup.common_prefixes([b"", b"abc", b"abc", b"abd", b"abdef", b"x"], 9) == [0, 0, 3, 2, 3, 0]
    assert suffix_dedup.common_prefixes([b"abcdef", b"abcdef"], 4) == [0, 4]


def test_maximal_repeats_have_all_occurrences():
    rest, left = [b"abcX", b"abcY", b"abcY", b"abdZ"], [b"pq", b"pr", b"s", b"pr"]
    got = sorted((back, ahead, sorted(m)) for back, ahead, m in suffix_dedup.maximal_repeats(rest, left, 4))
    assert got == [(0, 4, [1, 2]), (1, 3, [0, 1]), (2, 2, [1, 3])]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    vectors = np.concatenate([base, base[:20] + 0.08 * rng.standard_normal((20, 16)), base[:10], 3 * base[:5]])
    rows = [(i, v.tolist(), int(i % 2) if i < 40 else int((i - 40) % 20 % 2)) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, base[0].tolist(), None), (905, [float("inf")] * 16, 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0), (None, base[1].tolist(), 1), (3, base[3].tolist(), 1), (908, [], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, class string")
    good = []
    for k, (_, v, label) in enumerate(rows):
        ok = label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
        good.append(np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if ok else None)
    links = defaultdict(set)
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.93:
                links[i].add(j)
    for most, recall in ((2048, 0.9999), (2, 0.9999), (2048, 0.995)):
        got = embedding_dedup.embedding_dedup(df, 0.93, recall=recall, most=most).collect()
        assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == sorted((str(rows[i][0]), len(links[i])) for i in range(len(rows)))
        component = {r["vec_id"]: r["component_id"] for r in got}
        assert component[900] == 900 and component[907] == 906 and component[60] == 0 and component[None] == 1
    assert embedding_dedup.embedding_dedup(df.limit(0)).collect() == []


def test_recall_of_pairs_near_the_threshold(spark):
    """With the registered parameters, on pairs of cosines from 0.93 to 0.95 among thousands of strangers of one label."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((1500, 64))
    noise -= (noise * base[:1500]).sum(1, keepdims=True) * base[:1500]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.95, (1500, 1))
    vectors = np.float32(np.concatenate([base, c * base[:1500] + np.sqrt(1 - c * c) * noise]))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum() - len(unit)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = sum(r["n_links"] for r in embedding_dedup.embedding_dedup(df, cosine=0.93).collect())
    assert want >= 3000 and 0.99 * want <= got <= want


def test_a_large_group_of_near_copies_is_counted_whole(spark):
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((2, 32))
    vectors = np.float32(np.concatenate([middle[g] + 0.2 * rng.standard_normal((700, 32)) for g in (0, 1)] + [rng.standard_normal((300, 32))]))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    for most in (4096, 100):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df, cosine=0.93, most=most).collect()}
        assert sum(got.values()) >= 0.999 * links.sum() and all(got[i] <= n for i, n in enumerate(links.tolist()))


def test_buckets_wider_than_one_square_give_the_same_candidates(monkeypatch):
    rng = np.random.default_rng(6)
    sketches = rng.integers(0, 2**63, (90, 4), dtype=np.uint64)
    sketches[40:60, 1:] = sketches[:20, 1:]
    sketches[40:60, 0] = sketches[:20, 0] ^ np.uint64(0b1011 << 20)
    order = rng.permutation(90)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(90, np.int64)), pa.array(order), pa.nulls(90, pa.int64()), pa.array(np.zeros(90, np.int32)), pa.array([sketches[i].tobytes() for i in order])], embedding_dedup._ENTRY_NAMES)
    for wide, close in ((2048, 0), (16, 0), (16, 5)):
        monkeypatch.setattr(embedding_dedup, "WIDE", wide)
        monkeypatch.setattr(embedding_dedup, "CLOSE", close)
        pairs = [p for b in embedding_dedup._candidates(40)(iter([batch])) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist())]
        roots = tree(90, pairs)
        assert len(set(roots)) == 70 and all(roots[i] == roots[40 + i] for i in range(20))


def test_sketches_lose_no_more_than_they_may():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    hasher = embedding_dedup.Hasher(24, 1.5, 3, 4)
    differ = embedding_dedup._differ(hasher(a)[1], hasher(b)[1])
    assert (differ > embedding_dedup.most_bits(0.93, 0.001)).mean() < 0.02 and (differ > embedding_dedup.most_bits(0.93, 0.4)).mean() > 0.2


def test_more_tables_for_a_higher_recall():
    assert embedding_dedup.plan(1000, 0.93, 0.999)[2] > embedding_dedup.plan(1000, 0.93, 0.9)[2]


def test_empty_documents(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_dedup(docs).collect() == []
    assert jaccard_join.jaccard_classes(docs).collect() == []
    assert suffix_dedup.suffix_dedup(docs).collect() == []


def test_texts_fixture_has_the_awkward_cases():
    rows = texts()
    assert None in rows and "" in rows and max(len(t or "") for t in rows) > 20_000
