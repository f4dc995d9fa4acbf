"""Fusion of ranked lists (query_id, list_no, id, rank, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_score(k: int, rank: int) -> float:
    if k <= 0 or rank <= 0:
        raise ValueError("k and rank must be positive")
    return 1 / (k + rank)


def stack(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select("query_id", "id", "rank", F.col("score").cast("double").alias("score"), F.lit(i).alias("list_no")) for i, d in enumerate(lists)])


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score, ranks): sum of 1 / (k + rank), with the rank in each list."""
    if k <= 0:
        raise ValueError("k must be positive")
    ranks = F.transform(F.sort_array(F.collect_list(F.struct("list_no", "rank"))), lambda x: x["rank"])
    return lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), ranks.alias("ranks"))


def weighted(lists: DataFrame, weights: list[float], k: int = 60, alpha: float = 0.7, carry: dict[int, str] | None = None) -> DataFrame:
    """(query_id, id, score): sum of w (alpha / (k + rank) + (1 - alpha) score / best score of the list); a list whose best isn't positive counts as if it were 1.

    carry: names of lists whose own <name>_score and <name>_rank come along, null where the list hasn't the id. Each list is evaluated once."""
    if k <= 0 or not 0 <= alpha <= 1:
        raise ValueError("k must be positive and alpha within 0 and 1")
    w = F.array(*map(F.lit, map(float, weights)))[F.col("list_no")]
    best = F.max("score").over(Window.partitionBy("query_id", "list_no"))  # lists are cut at some top k already
    normal = F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)
    part = w * (alpha / (F.lit(k) + F.col("rank")) + (1 - alpha) * F.col("score") / normal)
    more = [F.max(F.when(F.col("list_no") == i, F.col(c))).alias(f"{name}_{c}") for i, name in (carry or {}).items() for c in ("score", "rank")]
    return lists.withColumn("best", best).withColumn("part", part).groupBy("query_id", "id").agg(F.sum("part").alias("fused"), *more).withColumnRenamed("fused", "score")


def simple_hybrid(bm25: DataFrame, semantic: DataFrame, semantic_weight: float = 0.7, k: int = 60) -> DataFrame:
    """(query_id, id, score): w / (k + rank) over the union of two lists."""
    part = lambda d, w, c: d.select("query_id", "id", (w / (F.lit(k) + F.col("rank"))).alias(c))
    both = part(bm25, 1 - semantic_weight, "b").join(part(semantic, semantic_weight, "s"), ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", (F.coalesce("b", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("score"))


def overlay(local: DataFrame, remote: DataFrame, k: int = 60, alpha: float = 0.7) -> DataFrame:
    """Local rows and those remote rows whose path no local row of the query has, in fused order (place), each with its own score. Both: query_id, id, path, score, rank."""
    kept = remote.join(local.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti")
    fused = weighted(stack([local, kept]), [1.0, 1.0], k, alpha).withColumnRenamed("score", "fused")
    rows = local.select("query_id", "id", "path", "score", F.lit(0).alias("origin")).unionByName(kept.select("query_id", "id", "path", "score", F.lit(1).alias("origin")))
    return rows.join(fused, ["query_id", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "id", "origin"))).drop("fused")
