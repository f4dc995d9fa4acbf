import re
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight import queries
from quarrylight.functions import chunkers
from quarrylight.functions import columns as C
from quarrylight.functions import segments
from quarrylight.operators import fulltext, search
from quarrylight.plans.query import SearchOptions, prepared_match
from quarrylight.sources import corpus

ODD = ["", "a", "Hello, World_wide  x1", "ΟΔΟΣ'Α ΣΑΣ β", "İstanbul ı", "日本 語\n\nǅ ²½Ⅷ", "x" * 50, "...", "𝒳𝒴 𐐀b", None, "áb c d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(str(i), t, ["One two", "İx"][: i % 3]) for i, t in enumerate(ODD * 3)]
    return spark.createDataFrame(rows, "id string, a string, b array<string>").repartition(3).cache()


def test_blocks_have_the_tokens_of_the_column(docs, monkeypatch):
    monkeypatch.setattr(segments, "PIECE", 20)
    rows = docs.select("a", C.tokens(F.col("a")).alias("t"), C.first_tokens(F.col("a"), 2).alias("f")).collect()
    values, counts = segments.split_tokens([r["a"] or "" for r in rows])
    assert counts.tolist() == [len(r["t"]) for r in rows] and values.to_pylist() == [t for r in rows for t in r["t"]]
    assert all(r["f"][:2] == r["t"][:2] for r in rows)


def test_small_blocks_give_the_same_rows(monkeypatch):
    table = pa.table({"id": [str(i) for i in range(40)], "f0": [f"de la{i % 3} of the {i}" for i in range(40)], "f1": ["the"] * 40})
    asked = [("p", 0, ("of", "the"), True, 1, True), ("d", 0, ("de",), False, 1, True), ("x", 0, ("zz",), True, 1, True)]
    run = lambda: sorted((q, i, f, dl) for b in map(pa.RecordBatch.to_pydict, partial(segments.frequencies_of, asked)(iter(table.to_batches(7)))) for q, i, f, dl in zip(b["query_id"], b["id"], b["f"], b["dl"]) if q)
    whole = run()
    assert len(whole) == 80 and {r[2:] for r in whole} == {(1, 6)}
    monkeypatch.setattr(segments, "BLOCK", 50)
    assert run() == whole


def test_search_of_texts_moves_no_tokens(spark, docs):
    """F8: one scan, whose tokens stay in it."""
    plan = fulltext.bm25(docs, {"q": prepared_match("hello world", False)}, ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan


def test_index_is_written_without_a_shuffle(spark, docs, tmp_path):
    """rows of postings are terms of a block, not tokens, and no task holds more than a block."""
    index = fulltext.write_index(docs, ("a", "b"), f"file://{tmp_path}/i", 3)
    plain = docs.select("id", F.posexplode(F.array(C.tokens(F.col("a")), C.tokens(F.concat_ws(" ", "b")))).alias("field", "t")).select("id", "field", F.posexplode("t").alias("pos", "term"))
    size = plain.groupBy("id").agg(F.count("*").alias("dl"))
    want = plain.join(size, "id").groupBy("term").agg(F.countDistinct("id"), F.count("*"), F.sum(F.col("pos") * (F.col("field") + 1)), F.max("dl"))
    assert sorted(fulltext.term_summary(index).collect()) == sorted(want.collect())
    assert index.segments.filter("term is not null").count() < index.postings.count()
    twice = fulltext.write_index(docs.withColumn("id", F.lit("1")), ("a", "b"), f"file://{tmp_path}/j", 3)
    assert {r["chunks"] for r in fulltext.term_summary(twice).collect()} == {1}


def test_boosts_need_no_index(spark, monkeypatch):
    """F2."""
    monkeypatch.setattr(corpus, "index", None)
    assert queries.rank_boosts(spark, "/root/testdata/sf0.001").count() > 0


def test_results_are_looked_up_without_a_shuffle_of_texts(spark):
    """what is found is broadcast to the chunks."""
    data = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.hybrid_search(corpus.chunks(spark, data), corpus.vectors(spark, data), queries.TEXTS, queries.query_vectors(spark, data), SearchOptions(limit=10))
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [a for a, b in zip(plan, plan[1:]) if re.search(r"Exchange hashpartitioning\(id#", a) and "content#" in b]


def test_markdown_is_cut_within_its_row(spark):
    """no line leaves its file, in the order that windows over lines gave."""
    text = "\n before \n### deep\nx\n# one \ny\n##two##\n\n#\n"
    files = spark.createDataFrame([("a.md", text), ("b.md", None), ("c.md", " \n\t"), ("d.md", "# only")], "path string, content string")
    found = chunkers.markdown_sections(files)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.orderBy("path", "section").collect()] == [
        ("a.md", 0, None, 0, None, "\n before ", 1, 2),
        ("a.md", 1, "deep", 3, "deep", "### deep\nx", 3, 4),
        ("a.md", 2, "one", 1, "one", "# one \ny", 5, 6),
        ("a.md", 3, "two##", 2, "one > two##", "##two##\n", 7, 8),
        ("a.md", 4, "", 1, "", "#\n", 9, 10),
        ("d.md", 1, "only", 1, "only", "# only", 1, 1),
    ]
