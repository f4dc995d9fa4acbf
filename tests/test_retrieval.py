import os
import math
import sqlite3

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import chunkers
from quarrylight.functions import columns as C
from quarrylight.operators import fulltext, fusion, indexing, ranking, search, vectors
from quarrylight.queries import QUERIES
from quarrylight.plans import schemas
from quarrylight.plans.query import Match, Phrase, SearchOptions, intent, prepared_match, raw_match
from quarrylight.sources import store
from quarrylight.streaming import watch


def chunk_table(spark, rows):
    """rows: dicts with id and whatever differs from a plain function."""
    base = {"path": "/test/file.swift", "content": "func testFunction() { }", "start_line": 1, "end_line": 1, "kind": "function", "symbols": ["testFunction"], "references": [], "conformances": [], "is_type_declaration": False, "token_count": 5, "language": "swift"}
    names = schemas.CHUNKS.fieldNames()
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schemas.CHUNKS)


@pytest.fixture(scope="module")
def mini(spark):
    return chunk_table(
        spark,
        [
            {"id": "chunk1", "path": "/src/auth/login.swift", "content": "func authenticate(user: String, password: String) { }", "symbols": ["authenticate"], "references": ["User", "Credentials"]},
            {"id": "chunk2", "path": "/src/auth/logout.swift", "content": "func logout(session: Session) { }", "symbols": ["logout"], "references": ["Session"]},
            {"id": "chunk3", "path": "/src/models/user.swift", "content": "struct User { var name: String }", "kind": "struct", "symbols": ["User"], "conformances": ["Codable", "", "Codable"], "is_type_declaration": True},
        ],
    ).cache()


def fts(rows, match):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, a, b, tokenize='unicode61 remove_diacritics 0')")
    con.executemany("insert into f values (?, ?, ?)", rows)
    return {i: -s for i, s in con.execute("select id, bm25(f) from f where f match ?", (match,))}


def test_bm25_agrees_with_sqlite(spark):
    words = "alpha beta gamma delta betamax foo bar baz".split()
    rows = [(str(i), " ".join(words[(i * k) % 8] for k in range(1, 3 + i % 7)), "foo bar" if i % 5 == 0 else "bar foo") for i in range(40)]
    docs = spark.createDataFrame(rows, "id string, a string, b string")
    cases = {
        "one": ("alpha", Match((Phrase(("alpha",), False),), True)),
        "both": ("alpha beta*", Match((Phrase(("alpha",), False), Phrase(("beta",), True)), True)),
        "any": ("gamma OR beta*", Match((Phrase(("gamma",), False), Phrase(("beta",), True)), False)),
        "phrase": ('"foo bar"', Match((Phrase(("foo", "bar"), False),), True)),
    }
    got = fulltext.bm25(docs, {n: m for n, (_, m) in cases.items()}, ("a", "b")).collect()
    for name, (text, _) in cases.items():
        want = fts(rows, text)
        mine = {r["id"]: r["score"] for r in got if r["query_id"] == name}
        assert mine.keys() == want.keys() and all(math.isclose(mine[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_search(mini):
    got = search.bm25_search(mini, {"q": "authenticate"}).collect()
    assert [(r["id"], r["rank"]) for r in got] == [("chunk1", 1)]
    assert search.bm25_search(mini, {"q": "User", "e": "()"}, SearchOptions(path_filter="**/models/*.swift")).collect()[0]["id"] == "chunk3"
    assert search.bm25_search(mini, {"q": "user"}, SearchOptions(extensions=("txt",))).collect() == []


def test_tokens_are_not_stemmed(spark):
    docs = chunk_table(spark, [{"id": "1", "content": "public struct VSearchError: Error {}", "symbols": []}, {"id": "2", "content": "func performSearch() {}", "symbols": []}, {"id": "3", "content": "This is generic code", "symbols": []}])
    got = {(r["query_id"], r["id"]) for r in fulltext.bm25(docs, {q: prepared_match(q) for q in ("VSearchError", "performSearch", "performsearch", "generically")}).collect()}
    assert got == {("VSearchError", "1"), ("performSearch", "2"), ("performsearch", "2")}


def test_postings_give_the_same_scores(spark, mini, tmp_path):
    index = fulltext.write_index(mini, fulltext.CHUNK_FIELDS, f"file://{tmp_path}/index", 2)
    q = {"a": raw_match("user session"), "b": prepared_match("String"), "c": prepared_match("struct user", False), "d": raw_match("user_session")}
    want = sorted(fulltext.bm25(mini, q).collect())
    assert want and want == sorted(fulltext.bm25(index, q).collect())
    plan = fulltext.bm25(index, q)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "PushedFilters: [Or(" in plan


def test_ranges_of_terms_hold_all_that_is_asked():
    many = {str(i): raw_match(f"t{i:04d} x{i}") for i in range(0, 900, 3)} | {"e": prepared_match("Codable no", False)}
    ranges = fulltext.term_ranges(many)
    assert len(ranges) <= fulltext.MOST_RANGES and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    inside = lambda t: any(a <= t <= b for a, b in ranges)
    assert all(inside(t) for t in ("t0003", "t0897z", "x0", "x897", "codable", "no")) and not inside("zebra") and not inside("aaa")
    assert fulltext.term_ranges({"q": prepared_match("ab", False)}) == [("ab", "ab")] and fulltext.term_ranges({}) == []


def ranked(spark, *lists):
    rows = [("q", i, name, rank, score) for i, items in enumerate(lists) for rank, (name, score) in enumerate(items, 1)]
    return spark.createDataFrame(rows, "query_id string, list_no int, id string, rank int, score double")


def test_fusion(spark):
    lists = ranked(spark, [("a", 1.0), ("b", 0.8), ("c", 0.6)], [("b", 0.9), ("c", 0.7), ("d", 0.5)])
    got = {r["id"]: r for r in fusion.rrf(lists).collect()}
    assert got["b"]["ranks"] == [2, 1] and got["b"]["score"] > got["a"]["score"]
    assert math.isclose(fusion.rank_score(60, 1), 1 / 61) and math.isclose(fusion.rank_score(60, 10), 1 / 70)
    w = {r["id"]: r["score"] for r in fusion.weighted(lists, [0.3, 0.7]).collect()}
    assert w["b"] > w["a"] and math.isclose(w["a"], 0.3 * (0.7 / 61 + 0.3))
    for bad in ((0, 1), (60, 0)):
        with pytest.raises(ValueError):
            fusion.rank_score(*bad)
    with pytest.raises(ValueError):
        fusion.weighted(lists, [1, 1], alpha=2)


def test_overlay_keeps_local_files(spark):
    schema = "query_id string, id string, path string, score double, rank int"
    local = spark.createDataFrame([("q", "local-1", "/project/Sources/Auth.swift", 0.5, 1)], schema)
    remote = spark.createDataFrame([("q", "remote-1", "/project/Sources/Auth.swift", 0.9, 1), ("q", "remote-2", "/project/B.swift", 0.4, 2)], schema)
    got = fusion.overlay(local, remote).orderBy("place").collect()
    assert [(r["id"], r["score"]) for r in got] == [("local-1", 0.5), ("remote-2", 0.4)]


def test_nearest(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.7, 0.7]), ("n", [0.0, 0.0]), ("long", [1.0, 0.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    got = vectors.nearest(v, q, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["x", "z"] and math.isclose(got[1]["score"], math.sqrt(0.5), rel_tol=1e-6)
    assert [r["id"] for r in vectors.nearest(v, q, 3, 0.9).collect()] == ["x"]
    with pytest.raises(ValueError):
        vectors.check_dimension(v, 2)


def test_a_vector_is_at_exactly_1_from_itself(spark):
    """A percentage is the floor of a hundred times the score, so that the last bit of a double counts."""
    rng = np.random.default_rng(5)
    given = [(str(i), [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(80)]
    v = spark.createDataFrame(given, "id string, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vectors.cosine_scores(v, q).filter("id = query_id").select("score", C.search_percent(F.lit(0.0), F.col("score")).alias("percent")).collect()
    assert len(got) == 80 and {(r["score"], r["percent"]) for r in got} == {(1.0, 100)}


def test_embedding_is_a_function_of_the_text(spark):
    a, b = vectors.hash_embedding("x", 8), vectors.hash_embedding("x", 8)
    assert (a == b).all() and math.isclose((a * a).sum(), 1) and (a != vectors.hash_embedding("y", 8)).any()

    def down(_):
        raise OSError("down")

    chain = vectors.ProviderChain({"a": down, "b": lambda t: [[1.0]] * len(t)})
    assert chain(["t"]) == [[1.0]] and chain.active == "b"
    with pytest.raises(RuntimeError):
        vectors.ProviderChain({"a": down})(["t"])


def asked(rows, terms, camel=(), question=False):
    """rows with a query's terms (term, whether it's rare) as ranking.query_table() gives them."""
    struct = lambda i, t, rare: F.struct(F.lit(i).alias("place"), F.lit(t).alias("term"), F.lit(t.lower()).alias("low"), F.lit(rare).alias("rare"))
    each = [struct(i, t, rare) for i, (t, rare) in enumerate(terms)]
    none = F.array().cast("array<struct<place: int, term: string, low: string, rare: boolean>>")
    return rows.withColumns({"terms": F.array(*each) if each else none, "camel": F.array(*(e for e, (t, _) in zip(each, terms) if t in camel)) if camel else none, "conceptual": F.lit(question)})


def test_boosts(spark, mini):
    rows = mini.join(ranking.query_table(mini, {"q": "User"}), F.lit(True))
    boost = {r["id"]: r["b"] for r in rows.withColumn("b", ranking.rank_boost()).select("id", "b").collect()}
    assert boost["chunk3"] == 2.5 and boost["chunk1"] == 1.0 and boost["chunk2"] == 0.3
    assert asked(mini, [("String", False)], ["String"]).filter(ranking.exact_content()).count() == 0
    assert asked(mini, [("String", True)], ["String"]).filter(ranking.exact_content()).count() > 0
    odd = mini.select(*(F.lit(None).cast("string").alias("signature") if c == "signature" else F.col(c) for c in mini.columns))
    assert asked(odd, []).withColumn("b", ranking.rank_boost()).filter("b is null").count() == 0


def test_query_table(mini):
    rows = {r["query_id"]: r for r in ranking.query_table(mini, {"a": "what is User session", "b": "the", "c": "nowhere User"}).collect()}
    assert [t["term"] for t in rows["a"]["terms"]] == ["User", "session"] and [t["term"] for t in rows["a"]["camel"]] == ["User"] and rows["a"]["conceptual"]
    assert rows["b"]["terms"] == [] and not rows["b"]["conceptual"] and all(t["rare"] for t in rows["c"]["terms"])


def test_plans_do_not_grow_with_the_number_of_queries(spark, mini):
    size = lambda n: len(ranking.query_table(mini, {str(i): f"Term{i} word{i}" for i in range(n)})._jdf.queryExecution().optimizedPlan().numberedTreeString())
    assert size(3000) < size(3) + 500
    intents = lambda n: {str(i): intent(f"what implements Type{i}") for i in range(n)}
    few, many = (vectors.intent_table(spark, intents(n))._jdf.queryExecution().optimizedPlan().numberedTreeString() for n in (3, 3000))
    assert len(many) < len(few) + 500


def plain_hash_embedding(text, dimension):
    """Byte for byte as it's defined, in 64-bit arithmetic."""
    most = (1 << 64) - 1
    state = 14695981039346656037
    for b in text.encode():
        state = ((state ^ b) * 1099511628211) & most
    values = []
    for _ in range(dimension):
        state = state ^ ((state << 13) & most)
        state = state ^ (state >> 7)
        state = state ^ ((state << 17) & most)
        values.append(state / 9223372036854775808 - 1)
    norm = math.sqrt(sum(v * v for v in values))
    return [v / norm for v in values]


def test_hash_embeddings_query(spark):
    import hashlib

    import numpy as np
    from quarrylight import queries
    from quarrylight.sources import corpus

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    texts = {r["id"]: r["content"] for r in corpus.snippets(spark, folder).filter("content <> ''").collect()}
    got = queries.hash_embeddings(spark, folder).collect()
    assert len(got) == len(texts) and {r["dimension"] for r in got} == {384} and {r["norm"] for r in got} == {1.0}
    for r in got[:: max(1, len(got) // 200)]:
        want = np.float32(plain_hash_embedding(texts[r["id"]], 384)).astype(float)
        half_up = [int(math.floor(abs(x) * 1e6 + 0.5)) * (1 if x >= 0 else -1) for x in want]
        assert r["digest"] == hashlib.sha256(",".join(map(str, half_up)).encode()).hexdigest()


def test_conformance(mini):
    assert [r["protocol_name"] for r in ranking.conformance_index(mini).collect()] == ["Codable"]
    got = ranking.conforming_types(mini, {"q": "codable"}, 5).collect()
    assert [(r["id"], r["rank"], r["score"]) for r in got] == [("chunk3", 1, 5.0)]
    assert ranking.conforming_types(mini, {"q": "codable"}, 5, strict_reference=True).collect() == []


def test_hybrid_with_hops(spark, mini):
    v = spark.createDataFrame([("chunk1", [1.0, 0.0]), ("chunk2", [0.0, 1.0]), ("chunk3", [0.6, 0.8])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    got = search.hybrid_search(mini, v, {"q": "authenticate"}, q, SearchOptions(limit=2)).orderBy(F.desc("score")).collect()
    assert got[0]["chunk_id"] == "chunk1" and got[0]["bm25_rank"] == 1 and len(got) == 2 and got[0]["exact_symbol_match"]
    only = search.hybrid_search(mini, v.filter("id = 'chunk1'"), {"q": "authenticate"}, q, SearchOptions(limit=5, multi_hop=1)).collect()
    hops = {r["chunk_id"]: r for r in only}
    assert hops["chunk3"]["is_multi_hop"] and hops["chunk3"]["hop_depth"] == 1 and not hops["chunk1"]["is_multi_hop"]
    parts = search.research(search.hybrid_search(mini, v, {"q": "authenticate"}, q, SearchOptions(limit=3)), mini)
    assert {r["path"] for r in parts["files"].collect()} == {r["path"] for r in mini.collect()}


def test_term_counts(mini):
    assert {r["term"]: r["n"] for r in fulltext.term_counts(mini, ["user", "SESSION", "none"]).collect()} == {"user": 2, "SESSION": 1, "none": 0}
    assert fulltext.term_counts(mini, []).collect() == []


def test_index_life_cycle(spark, mini, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/index")
    v = spark.createDataFrame([(f"chunk{i}", [float(i), 1.0]) for i in (1, 2, 9)], schemas.VECTORS)
    assert s.read("chunks").count() == 0
    s.index(mini, v)
    with pytest.raises(ValueError):
        s.insert("chunks", mini.limit(1))
    with pytest.raises(ValueError):
        s.index(mini, spark.createDataFrame([("x", [1.0])], schemas.VECTORS))
    with pytest.raises(indexing.ReadOnlyError):
        store.Store(spark, s.root, read_only=True).clear()
    problems = {(r["id"], r["problem"]) for r in indexing.consistency(s.read("chunks"), s.read("vectors")).collect()}
    assert problems == {("chunk3", "missing_vector"), ("chunk9", "orphaned_vector")}
    assert indexing.repair(s.read("chunks"), s.read("vectors")).count() == 2
    s.delete("chunks", mini.filter("id = 'chunk1'"), "path")
    assert s.read("chunks").count() == 2
    other = store.Store(spark, f"file://{tmp_path}/other")
    store.push(s, other)
    assert indexing.delta(other.manifest(), s.manifest()).count() == 0
    assert store.open_remote(spark, f"file://{tmp_path}/nothing") is None
    one = indexing.statistics(s.read("chunks"), s.read("vectors")).first()
    assert (one["chunks"], one["vectors"], one["dimension"], one["consistent"]) == (2, 3, 2, False)


def test_reuse_by_content(spark):
    old = spark.createDataFrame([("a", "/f", "h1"), ("b", "/f", "h1"), ("c", "/g", "h2")], "id string, path string, content_hash string")
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "id string, embedding array<float>")
    new = spark.createDataFrame([("n1", "/f", "h1"), ("n2", "/f", "h2")], "id string, path string, content_hash string")
    got = {r["id"]: r["embedding"] for r in indexing.reuse_vectors(new, old, v).collect()}
    assert got == {"n1": [2.0], "n2": None}
    assert indexing.reuse_counts(indexing.reuse_vectors(new, old, v)).first()["reuse_percent"] == 50


def test_delta(spark):
    schema = "name string, checksum string"
    local = spark.createDataFrame([("chunks.db.zst", "aaa"), ("vectors.zst", "bbb")], schema)
    remote = spark.createDataFrame([("chunks.db.zst", "aaa"), ("vectors.zst", "ccc"), ("new", "d")], schema)
    assert {r["name"] for r in indexing.delta(local, remote).collect()} == {"vectors.zst", "new"}
    v = lambda *n: spark.createDataFrame([(i,) for i in n], "version int")
    assert [indexing.remote_status(v(*a), v(2)).first()[0] for a in ((1,), (2,), (3,), ())] == ["remote_newer", "equal", "local_newer", "no_local"]


def test_stream_applies_last_events(spark, tmp_path):
    events = [("a", "created", 1), ("a", "modified", 2), ("b", "created", 1), ("b", "deleted", 3), ("c.txt", "created", 1), ("x/.build/d", "created", 1)]
    spark.createDataFrame(events, "path string, event string, n int").select("path", "event", F.timestamp_seconds("n").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = watch.wanted(spark.readStream.schema("path string, event string, ts timestamp").parquet(f"{tmp_path}/in"), exclude=("/.build/",))
    seen = {}
    q = watch.run(stream, lambda rows, _: seen.update({r["path"]: r["event"] for r in rows.collect()}), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert seen == {"a": "modified", "b": "deleted", "c.txt": "created"}


def test_debounce(spark):
    events = [("a", "created", 0), ("b", "modified", 300), ("a", "deleted", 700), ("a", "created", 1300)]
    rows = spark.createDataFrame(events, "path string, event string, ms long").select("path", "event", F.timestamp_millis("ms").alias("ts"))
    got = {(r["session"], r["path"]): r["event"] for r in watch.debounce_batch(rows).collect()}
    assert got == {(0, "a"): "deleted", (0, "b"): "modified", (1, "a"): "created"}


def test_sessions_across_ranges_of_time(spark):
    import random

    r = random.Random(4)
    at, rows = 0, []
    for i in range(300):
        at += r.choice([1, 100, 499, 500, 501, 7000, 40_000])
        rows.append((r.choice("abc"), f"e{i}", at))
    number, last, want = 0, None, {}
    for path, event, ms in rows:
        number += last is not None and ms - last >= 500
        last = ms
        want[number, path] = event
    df = spark.createDataFrame(rows, "path string, event string, ms long").select("path", "event", F.timestamp_millis("ms").alias("ts"))
    for range_ms in (1000, 20_000, 3_600_000):
        assert {(x["session"], x["path"]): x["event"] for x in watch.debounce_batch(df, range_ms=range_ms).collect()} == want
    assert watch.debounce_batch(df.limit(0)).collect() == []


def test_debounced_stream(spark, tmp_path):
    """Batches as files, one at a time: bursts give one event each, once the watermark has passed their quiet time."""
    batches = [
        [("a", "created", 0), ("a", "modified", 200), ("b", "created", 100)],
        [("a", "modified", 450), ("b", "modified", 3000), ("c", "created", 3000), ("c", "deleted", 3100)],
        [("d", "created", 60_000)],
        [("d", "modified", 200_000)],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "path string, event string, ms long").select("path", "event", F.timestamp_millis("ms").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("part-*"):
            if not f.name.startswith("part-seen"):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
                f.rename(f.with_name(f"part-seen-{i}.parquet"))
    events = spark.readStream.schema("path string, event string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = watch.debounce_stream(events, 500, "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    stream.awaitTermination(180)
    got = [(r["path"], r["event"], r["ms"]) for r in spark.read.parquet(f"{tmp_path}/out").select("path", "event", F.unix_millis("ts").alias("ms")).collect()]
    assert sorted(got) == [("a", "modified", 450), ("b", "created", 100), ("b", "modified", 3000), ("c", "deleted", 3100), ("d", "created", 60_000)]


def plain_packing(content, most):
    """Line by line, as the format is defined."""
    if not content.strip():
        return []
    if len(content) <= most:
        return [(content, 1, content.count("\n") + 1)]
    out, body, first = [], "", 1
    lines = content.split("\n")
    for number, line in enumerate(lines, 1):
        line += "\n" * (number < len(lines))
        if number > first and len(body) + len(line) > most:
            out.append((body, first, number - 1))
            body, first = "", number
        body += line
    return out + ([(body, first, len(lines))] if body.strip() else [])


def test_plain_text_packing():
    import random

    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["\n", "ab", "c" * r.randint(0, 25), " \n", "\n\n"]) for _ in range(r.randint(0, 30)))
        for most in (5, 12, 40):
            assert [(c["content"], c["start_line"], c["end_line"]) for c in chunkers.plain_text("f.txt", text, most)] == plain_packing(text, most), text
    assert [c["start_line"] for c in chunkers.plain_text("f.txt", "aaaa\nbbbb\ncccc", 5, strict_reference=True)] == [1, 1, 2]


def test_index_life_cycle(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/index")
    table = lambda rows: spark.createDataFrame(rows, "path string, content string").withColumn("hash", F.sha2("content", 256))
    first = [("/p/a.swift", "func one() { }\nfunc two() { }"), ("/p/b.md", "# Top\ntext\n## Sub\nmore"), ("/p/c.md", "no heading"), ("/p/d.json", '{\n "key": 1\n}'), ("/p/e.txt", "")]
    one = s.index_files(table(first), dimension=8).first()
    assert (one["files"], one["removed"], one["reused"], one["errors"]) == (5, 0, 0, 1) and one["chunks"] == one["embedded"] == 6
    chunks = {r["id"]: r for r in s.read("chunks").collect()}
    snippets = s.read("info_snippets").collect()
    assert {(r["kind"], r["breadcrumb"]) for r in snippets} == {("markdownSection", "Top"), ("markdownSection", "Top > Sub"), ("documentation", None)}
    assert all(chunks[r["chunk_id"]]["content"] == r["content"] for r in snippets) and chunks[[r["chunk_id"] for r in snippets if r["breadcrumb"] is None][0]]["kind"] == "document"
    again = s.index_files(table(first), dimension=8).first()
    assert (again["files"], again["removed"], again["chunks"]) == (0, 0, 0)
    second = [("/p/a.swift", "func one() { }\nfunc three() { }"), first[1], first[3]]
    two = s.index_files(table(second), dimension=8).first()
    assert (two["files"], two["removed"], two["chunks"], two["reused"], two["embedded"]) == (1, 2, 2, 1, 1)
    assert {r["path"] for r in s.read("chunks").collect()} == {"/p/a.swift", "/p/b.md", "/p/d.json"} and "two" not in str(s.read("chunks").collect())
    assert indexing.consistency(s.read("chunks"), s.read("vectors")).count() == 0 and {r["path"] for r in s.read("file_hashes").collect()} == {"/p/a.swift", "/p/b.md", "/p/d.json"}


def test_manifest_is_of_bytes_and_copies_are_checked(spark, mini, tmp_path):
    s, other = (store.Store(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    s.index(mini, spark.createDataFrame([("chunk1", [1.0])], schemas.VECTORS))
    first = {r["name"]: r for r in s.manifest().collect()}
    size = sum(f.stat().st_size for f in (tmp_path / "one" / "chunks").glob("data-*/*.parquet"))
    assert first["chunks"]["size"] == size and first["chunks"]["version"] == 1 and len(first["chunks"]["checksum"]) == 64
    assert sorted(store.pull(other, s)) == ["chunks", "vectors"] and store.push(s, other) == [] and other.read("chunks").count() == 3
    s.replace("chunks", s.read("chunks").unionByName(s.read("chunks").limit(1)))  # a row added twice shows
    assert store.push(s, other) == ["chunks"] and other.read("chunks").count() == 4
    s.replace("chunks", mini, after=2)
    with pytest.raises(store.ConflictError):
        s.replace("chunks", mini.limit(0), after=2)
    assert s.read("chunks").count() == 3 and len(s.versions("chunks")) == 3
    s.vacuum(1)
    assert s.versions("chunks") == [3] and s.read("chunks").count() == 3
    edited = mini.filter("id = 'chunk1'").withColumn("id", F.lit("chunk1b"))
    s.index(edited, spark.createDataFrame([("chunk1b", [2.0])], schemas.VECTORS))
    assert {r["id"] for r in s.read("chunks").collect()} == {"chunk1b", "chunk2", "chunk3"} and {r["id"] for r in s.read("vectors").collect()} == {"chunk1b"}


def test_a_hidden_folder_above_the_root_hides_nothing(spark, tmp_path):
    for path in (".hidden/src/a.swift", ".hidden/src/.git/b.swift", ".hidden/src/.c.swift", ".hidden/src/sub/d.swift"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    got = store.scan_files(spark, str(tmp_path / ".hidden/src")).collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == ["a.swift", "d.swift"]


def test_multi_hop_is_the_plain_walk(spark):
    import random

    r = random.Random(5)
    names = [f"Name{chr(97 + i)}" for i in range(16)]
    rows = [{"id": f"c{i:02d}", "content": " ".join(r.choices(names, k=r.randint(2, 12))), "symbols": [], "references": r.sample(names, r.randint(0, 4))} for i in range(40)]
    chunks = chunk_table(spark, rows)
    refs = {x["id"]: x["references"] for x in rows}
    best = {n: [] for n in names}
    for x in fulltext.bm25(chunks, {n: prepared_match(n, False) for n in names}).collect():
        best[x["query_id"]].append((x["id"], x["score"]))
    order = lambda pairs: sorted(pairs, key=lambda p: (-round(p[1], 9), p[0]))
    starts = {q: [(f"c{i:02d}", r.random()) for i in r.sample(range(40), 9)] for q in ("q1", "q2")}
    want = set()
    for q, level in starts.items():
        for depth in (1, 2):
            asked = {n for i, _ in order(level)[:5] for n in refs[i]}
            seen, hit = {i for i, _ in level}, {}
            for n in asked:
                for i, score in order(best[n])[:3]:
                    if i not in seen:
                        hit[i] = max(score, hit.get(i, score))
            level = [(i, score * 0.7**depth) for i, score in hit.items()]
            want |= {(q, i, round(score, 9), depth) for i, score in level}
    start = spark.createDataFrame([(q, i, x, refs[i]) for q, level in starts.items() for i, x in level], "query_id string, id string, score double, references array<string>")
    got = search.multi_hop(chunks, start, SearchOptions(multi_hop=2)).collect()
    assert {(x["query_id"], x["id"], round(x["score"], 9), x["hop_depth"]) for x in got} == want and len(got) == len(want) > 8


def test_federated_search(spark, mini):
    vectors_ = spark.createDataFrame([(f"chunk{i}", [float(i), 1.0]) for i in (1, 2, 3)], schemas.VECTORS)
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<float>")
    remote = mini.withColumns({"id": F.concat(F.lit("r"), "id"), "path": F.regexp_replace("path", "login", "other")})
    rv = vectors_.withColumn("id", F.concat(F.lit("r"), "id"))
    got = {r["id"]: r["origin"] for r in search.federated_search((mini, vectors_), (remote, rv), {"q": "user"}, asked).collect()}
    assert got == {"chunk1": 0, "chunk2": 0, "chunk3": 0, "rchunk1": 1}
    assert {r["id"] for r in search.federated_search((mini, vectors_), None, {"q": "user"}, asked).collect()} == {"chunk1", "chunk2", "chunk3"}


SWIFT = """import Foundation

/// A store.
protocol Store { func get(id: String) -> Int }

public class Cache: Store, Codable {
    // not a class Fake {
    let size = "func no() {"
    init() { }
    func get(id: String) -> Int { return size }
    enum Kind { case a }
}

extension Cache: Equatable { }
extension Cache { static func make() -> Cache { Cache() } }

func free() { }
"""


def test_swift_chunks():
    got = chunkers.swift("/a.swift", SWIFT)
    kinds = {(c["kind"], c["symbols"][0], c["is_type_declaration"]) for c in got}
    assert {("protocol", "Store", False), ("protocol", "Store", True), ("class", "Cache", True), ("method", "Cache.get", False), ("enum", "Cache.Kind", True), ("extension", "Cache", True), ("function", "free", False), ("constant", "Cache.size", False), ("initializer", "Cache.init", False)} <= kinds
    cache = next(c for c in got if c["kind"] == "class" and not c["is_type_declaration"])
    assert cache["conformances"] == ["Store", "Codable"] and cache["signature"] == "public class Cache: Store, Codable" and cache["start_line"] == 6 and cache["end_line"] == 12
    assert next(c for c in got if c["kind"] == "protocol")["doc_comment"] == "A store."
    assert next(c for c in got if c["symbols"][0] == "Cache.get")["breadcrumb"] == "Cache"
    assert not any("Fake" in c["symbols"] or "no" in c["symbols"] for c in got) and len({c["id"] for c in got}) == len(got)


def test_other_chunkers():
    assert [c["kind"] for c in chunkers.parse("/a.m", "@implementation Foo\n- (void)bar {\n}\n@end\n")] == ["class", "method"]
    assert [c["symbols"] for c in chunkers.parse("/a.h", "typedef struct p {\n int x;\n} Point;\nint sum(int a);\n")] == [["sum"], ["Point"]]
    assert [(c["kind"], c["symbols"]) for c in chunkers.parse("/a.c", "// adds\nint add(int a) {\n return a;\n}\n")] == [("function", ["add"])]
    assert chunkers.parse("/a.c", "plain")[0]["kind"] == "document" and chunkers.parse("/a.c", "// adds\nint add(int a) {\n return a;\n}\n")[0]["doc_comment"] == "adds"
    assert chunkers.parse("/a.txt", "  ")[0]["error"] == "emptyContent"
    long = "".join(f"line {i}\n" for i in range(600))
    parts = chunkers.plain_text("/a.txt", long)
    assert "".join(p["content"] for p in parts) == long and all(len(p["content"]) <= 2000 for p in parts) and parts[1]["start_line"] == parts[0]["end_line"] + 1
    assert chunkers.plain_text("/a.txt", long, strict_reference=True)[1]["start_line"] == parts[1]["start_line"] - 1


def test_markdown_and_tree(spark):
    text = "intro\n# A\none\n### B\ntwo\n### C\nthree\n# D\n\n"
    got = chunkers.markdown_sections(spark.createDataFrame([("/r.md", text)], "path string, content string")).orderBy("section").collect()
    assert [(r["title"], r["breadcrumb"]) for r in got][:3] == [(None, None), ("A", "A"), ("B", "A > B")] and got[-1]["title"] == "D"
    tree = chunkers.syntax_tree(spark.createDataFrame([("/a.swift", SWIFT)], "path string, content string"))
    assert {(r["kind"], r["depth"]) for r in chunkers.tree_view(tree, most_depth=0).collect()} == {("protocol", 0), ("class", 0), ("extension", 0), ("function", 0)}
    kept = chunkers.tree_view(tree, kinds=("class", "enum")).collect()
    assert {(r["name"], r["depth"]) for r in kept} == {("Cache", 0), ("Kind", 1)}


def test_columns(spark):
    row = spark.createDataFrame([("/a/B.TAR.GZ", '["x", "y"]', "This code does it")], "p string, j string, d string").select(C.extension(F.col("p")).alias("e"), C.json_strings(F.col("j")).alias("j"), C.json_strings(F.col("p")).alias("bad"), C.clean_description(F.col("d")).alias("d"), C.snippet_percent(F.lit(12.5)).alias("s"), C.search_percent(F.lit(0.0082), F.lit(None)).alias("r"), C.search_percent(F.lit(0.0), F.lit(1.3)).alias("over")).first()
    assert (row["e"], row["j"], row["bad"], row["d"], row["s"], row["r"], row["over"]) == ("gz", ["x", "y"], [], "Does it.", 50, 50, 130)


def test_files_and_config(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    for name, text in (("a.swift", "x"), ("b.txt", "y"), (".hidden.swift", "z"), ("big.swift", "q" * 50)):
        (tmp_path / "src" / name).write_text(text)
    got = store.scan_files(spark, str(tmp_path / "src"), extensions=("swift",), most_bytes=20).collect()
    assert [r["content"] for r in got] == ["x"] and len(got[0]["hash"]) == 64
    (tmp_path / "c.toml").write_text("limit = 5\n[search]\nk = 1\nw = 2\n")
    monkeypatch.setenv("QUARRYLIGHT_LIMIT", "7")
    assert store.load_config(str(tmp_path / "c.toml"), limit=None)["limit"] == "7"
    assert store.merge_config({"a": {"b": 1}}, {"a": {"b": 2, "c": 3}}) == {"a": {"b": 1, "c": 3}}


SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def brute():
    """All pairs of every 20th vector and all vectors of sf0.1: {query_id: [(score, id)]}, best first."""
    rows = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [str(r["vec_id"]) for r in rows]
    return {f"q{i}": sorted(zip((-np.round(x @ v, 9)).tolist(), ids, strict=True))[:10] for i, v in zip(ids, x, strict=True) if int(i) % 20 == 0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("few, tall, wide", [(100, 10_000, 32_768), (5, 30, 300)])
def test_all_queries_in_blocks_are_brute_force(spark, brute, monkeypatch, few, tall, wide):
    for name, value in (("FEW_QUERIES", few), ("MOST_QUERIES", tall), ("MOST_VECTORS", wide)):
        monkeypatch.setattr(vectors, name, value)
    want = sorted((q, i, r + 1) for q, best in brute.items() for r, (_, i) in enumerate(best))
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in QUERIES["knn_cosine"](spark, SF).collect()) == want
    want = sorted((q, i) for q, best in brute.items() for s, i in best if -s >= 0.5)
    assert sorted((r["query_id"], r["id"]) for r in QUERIES["knn_threshold"](spark, SF).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bucketed_recall_on_the_whole_table(spark, brute):
    got = QUERIES["knn_bucketed"](spark, SF).select("query_id", "id").collect()
    want = {(q, i) for q, best in brute.items() for _, i in best}
    recall = len(want & {tuple(r) for r in got}) / len(want)
    print("recall@10", recall)
    assert recall >= 0.9


def test_best_pairs_break_ties_by_place():
    v = np.array([[1.0, 0], [0, 1], [1, 0], [1, 0], [0.6, 0.8]])
    row, column, _ = vectors.best_pairs(v[:2], v, 2, high=1, wide=2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 0), (0, 2), (1, 1), (1, 4)]
