"""Boosts and conformance lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators import fulltext
from quarrylight.plans.query import STANDARD_PROTOCOLS, camel_terms, is_conceptual, query_terms

RARE = 10  # a term that fewer chunks have is rare


def query_table(chunks: DataFrame, queries: dict[str, str]) -> DataFrame:
    """A row for each query, to be broadcast: terms (low, rare) and camel (term, rare) in the query's order, and whether it's conceptual. A term that fewer than RARE chunks have is rare."""
    spark = chunks.sparkSession
    terms = [(q, i, t, t.lower()) for q, text in queries.items() for i, t in enumerate(query_terms(text))]
    camel = {q: camel_terms(text) for q, text in queries.items()}
    counts = fulltext.term_counts(chunks, [t for *_, t, _ in terms])
    rows = spark.createDataFrame(terms, "query_id string, place int, term string, low string").join(F.broadcast(counts), "term").withColumn("rare", F.col("n") < RARE)
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "term", "low", "rare"))).alias("terms"))
    each = spark.createDataFrame([(q, camel[q], is_conceptual(text)) for q, text in queries.items()], "query_id string, names array<string>, conceptual boolean").join(listed, "query_id", "left")
    none = F.array().cast("array<struct<place: int, term: string, low: string, rare: boolean>>")
    terms_ = F.coalesce("terms", none)
    return each.select("query_id", terms_.alias("terms"), F.filter(terms_, lambda t: F.array_contains("names", t["term"])).alias("camel"), "conceptual")


def _first_is_rare(terms: str, holds) -> Column:
    return F.coalesce(F.get(F.filter(terms, holds), F.lit(0))["rare"], F.lit(False))


def exact_symbol() -> Column:
    """The first of the query's terms that equals a symbol is rare."""
    return _first_is_rare("terms", lambda t: F.array_contains(F.transform("symbols", F.lower), t["low"]))


def exact_content() -> Column:
    return _first_is_rare("camel", lambda t: F.col("content").contains(t["term"]))


def standard_extension():
    return (F.col("kind") == "extension") & F.arrays_overlap("conformances", F.array(*map(F.lit, STANDARD_PROTOCOLS)))


def whole_term() -> Column:
    """A chunk has one of the query's camel-case terms whole; true if there are none."""
    held = F.exists("camel", lambda t: F.array_contains("symbols", t["term"]) | F.col("content").contains(t["term"]) | F.array_contains("references", t["term"]))
    return (F.size("camel") == 0) | F.coalesce(held, F.lit(False))


def path_boost():
    p = F.col("path")
    return (
        F.when(p.contains("/Sources/"), 1.25)
        .when(p.contains("/Tests/"), 0.8)
        .when(p.contains("/benchmarks/") | p.contains("/archive/"), 0.5)
        .when(p.contains("/docs/") | p.contains("/openspec/"), 0.9)
        .otherwise(1.0)
    )


def rank_boost() -> Column:
    """Product of a chunk's boosts, over rows that have the columns of a chunk and of query_table()."""
    out = F.when(exact_symbol(), 2.5).when(exact_content(), 2.0).otherwise(1.0) * path_boost()
    out = out * F.when(F.col("signature").startswith("public "), 1.1).otherwise(1.0)
    out = out * F.when(F.col("conceptual") & F.coalesce(standard_extension(), F.lit(False)), 0.5).otherwise(1.0)
    return out * F.when(whole_term(), 1.0).otherwise(0.3)


def conformance_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, protocol_name), without empty names."""
    return chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct("conformances")).alias("protocol_name")).filter("protocol_name <> ''")


def conforming_types(chunks: DataFrame, targets: dict[str, str], limit: int, strict_reference: bool = False) -> DataFrame:
    """(query_id, id, rank, score): type declarations with the protocol of each query, by path and line; scores fall from limit by one."""
    spark = chunks.sparkSession
    fold = (lambda c: c) if strict_reference else F.lower
    asked = spark.createDataFrame([(q, t) for q, t in targets.items()], "query_id string, target string")
    named = chunks.filter("is_type_declaration").select("id", "path", "start_line", F.explode(F.array_distinct("conformances")).alias("protocol")).filter("protocol <> ''")
    found = named.join(F.broadcast(asked), fold(F.col("protocol")) == fold(F.col("target"))).select("query_id", "id", "path", "start_line").distinct()
    order = Window.partitionBy("query_id").orderBy("path", "start_line", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "id", "rank", (F.lit(float(limit + 1)) - F.col("rank")).alias("score"))
