"""Hybrid search, multi-hop expansion, overlay and research, batched by query.

The driver turns query strings into small tables that are broadcast, so that no expression grows with
the number of queries; everything on data is one lazy DataFrame. Chunks may be a table or a TextIndex,
from which full-text search reads postings instead of texts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.columns import has_extension, hop_score, matches_glob, search_percent
from quarrylight.operators import fulltext, fusion, ranking, vectors
from quarrylight.operators.fulltext import TextIndex
from quarrylight.plans.query import SearchOptions, conformance_target, intent, prepared_match
from quarrylight.session import stored

#: Rows of search results up to which they are broadcast to the chunks.
MOST_BROADCAST = 200_000

RESULT = ["query_id", "chunk_id", "path", "kind", "start_line", "end_line", "score", "bm25_score", "semantic_score", "bm25_rank", "semantic_rank", "is_multi_hop", "hop_depth", "exact_symbol_match"]


def _table(chunks: DataFrame | TextIndex) -> DataFrame:
    return chunks.docs if isinstance(chunks, TextIndex) else chunks


def _looked_up(best: DataFrame, chunks: DataFrame, most: int, *columns: str) -> DataFrame:
    """best with columns of its chunks. At most `most` rows; unless these are too many they are broadcast, so that the chunks are not shuffled."""
    return chunks.select("id", *columns).join(F.broadcast(best) if most <= MOST_BROADCAST else best, "id")


def bm25_search(chunks: DataFrame | TextIndex, queries: dict[str, str], options: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, id, score, rank): over-fetches twice the limit, then filters; rank is the place before the filters."""
    best = fulltext.top_k(fulltext.bm25(chunks, {q: prepared_match(t, options.strict_reference) for q, t in queries.items()}), 2 * options.limit)
    return _cut(_looked_up(best, _table(chunks), 2 * options.limit * len(queries), "path").filter(_filters(options)), options.limit).select("query_id", "id", "score", "rank")


def semantic_only(chunks: DataFrame, embeddings: DataFrame, query_vectors: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    best = vectors.nearest(embeddings, query_vectors, 2 * options.limit)
    return _cut(best.join(chunks.select("id", "path"), "id").filter(_filters(options)), options.limit).select("query_id", "id", "score", "rank")


def _filters(options: SearchOptions):
    path = matches_glob(F.col("path"), options.path_filter, options.strict_reference) if options.path_filter else F.lit(True)
    return path & has_extension(F.col("path"), options.extensions)


def _cut(rows: DataFrame, k: int, by: str = "score") -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), "id"))).filter(F.col("_n") <= k).drop("_n")


def _index(chunks: DataFrame | TextIndex, embeddings: DataFrame, queries: dict[str, str], query_vectors: DataFrame, options: SearchOptions, bm25_queries: dict[str, str] | None) -> DataFrame:
    fetch = max(options.fetch_factor * options.limit, options.result_factor * options.limit)
    text = bm25_queries or queries
    lexical = fulltext.top_k(fulltext.bm25(chunks, {q: prepared_match(t, options.strict_reference) for q, t in text.items()}), fetch)
    chunks = _table(chunks)
    semantic = vectors.semantic_search(chunks, embeddings, query_vectors, {q: intent(t) for q, t in queries.items()}, fetch)
    targets = {q: t for q, text in queries.items() if (t := conformance_target(text, options.strict_reference))}
    conforming = ranking.conforming_types(chunks, targets, fetch, options.strict_reference)
    lists = fusion.stack([lexical, semantic, conforming])
    weights = [1 - options.semantic_weight, options.semantic_weight, options.conformance_weight]
    rows = fusion.weighted(lists, weights, options.rrf_k, options.alpha, {0: "bm25", 1: "semantic", 2: "conforms"}).withColumnRenamed("score", "fused")
    rows = rows.withColumn("conforms", F.col("conforms_rank").isNotNull())
    rows = _looked_up(rows, chunks, 3 * fetch * len(queries), "path", "kind", "start_line", "end_line", "symbols", "references", "conformances", "content", "signature").filter(_filters(options))
    rows = _cut(rows, options.result_factor * options.limit, "fused")
    rows = rows.join(F.broadcast(ranking.query_table(chunks, queries)), "query_id")
    exact = ranking.exact_symbol() | ranking.exact_content()
    rows = rows.withColumns({"score": F.col("fused") * ranking.rank_boost(), "exact_symbol_match": exact | F.col("conforms")})
    return rows.withColumns({"is_multi_hop": F.lit(False), "hop_depth": F.lit(0), "chunk_id": F.col("id")})


def hybrid_search(chunks: DataFrame | TextIndex, embeddings: DataFrame, queries: dict[str, str], query_vectors: DataFrame, options: SearchOptions = SearchOptions(), bm25_queries: dict[str, str] | None = None) -> DataFrame:
    """RESULT columns and relevance_percent, the `limit` best of each query by score, ties by id.

    bm25_queries: other texts for the full-text leg, as an expanded search has them."""
    rows = _index(chunks, embeddings, queries, query_vectors, options, bm25_queries)
    if options.multi_hop:
        rows = stored(rows, "hits")  # at most result_factor * limit rows a query
        hops = multi_hop(chunks, rows.select("query_id", "id", "score", "references"), options)
        keep = rows.select(*RESULT)
        none = {c: F.lit(None).cast(t) for c, t in (("bm25_score", "double"), ("semantic_score", "double"), ("bm25_rank", "int"), ("semantic_rank", "int"))}
        extra = hops.join(_table(chunks).select("id", "path", "kind", "start_line", "end_line"), "id").withColumns(none | {"chunk_id": F.col("id"), "is_multi_hop": F.lit(True), "exact_symbol_match": F.lit(False)}).select(*RESULT)
        rows = keep.unionByName(extra).withColumn("id", F.col("chunk_id"))
        if not options.strict_reference:
            best = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "hop_depth")
            rows = rows.withColumn("_b", F.row_number().over(best)).filter("_b = 1").drop("_b")
    return _cut(rows, options.limit).select(*RESULT, search_percent(F.col("score"), F.col("semantic_score")).alias("relevance_percent"))


def multi_hop(chunks: DataFrame | TextIndex, start: DataFrame, options: SearchOptions, frontier: int = 5, fan: int = 3) -> DataFrame:
    """(query_id, id, score, hop_depth): from the best rows of each frontier (query_id, id, score, references), the best chunks for each reference, with scores that fall by 0.7 a hop.

    One full-text job for all references of a depth. The frontier is by score, then id; references are in alphabetical order.
    The names of one depth come to the driver, which parses them; more than fulltext.MOST_TOKENS are refused."""
    table = _table(chunks)
    spark = table.sparkSession
    found, level = None, start
    filters = replace(options, extensions=())
    for depth in range(1, options.multi_hop + 1):
        top = _cut(level, frontier)
        edges = top.select("query_id", F.explode(F.array_distinct("references")).alias("reference")).distinct()
        names = [r[0] for r in edges.select("reference").distinct().orderBy("reference").limit(fulltext.MOST_TOKENS + 1).collect()]
        if not names:
            break
        matches = {n: prepared_match(n, options.strict_reference) for n in names}
        best = fulltext.top_k(fulltext.bm25(chunks, matches), fan).select(F.col("query_id").alias("reference"), "id", "score")
        hops = edges.join(best, "reference").join(level.select("query_id", "id"), ["query_id", "id"], "left_anti")
        hops = hops.join(table.select("id", "path", "references"), "id").filter(_filters(filters))
        hops = hops.groupBy("query_id", "id").agg(F.max("score").alias("raw"), F.first("references").alias("references"))
        hops = stored(hops.select("query_id", "id", hop_score(F.col("raw"), depth).alias("score"), F.lit(depth).alias("hop_depth"), "references"), "hops")  # at most frontier * references * fan rows a query
        found = hops if found is None else found.unionByName(hops)
        level = hops.drop("hop_depth")
    if found is None:
        return spark.createDataFrame([], "query_id string, id string, score double, hop_depth int")
    return found.drop("references")


def overlaid_search(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Results of two indexes (RESULT columns): local files win; by score, ties by id."""
    ranked = lambda d: d.select("query_id", F.col("chunk_id").alias("id"), "path", "score", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).alias("rank"))
    return fusion.overlay(ranked(local), ranked(remote))


def federated_search(local: tuple[DataFrame | TextIndex, DataFrame], remote: tuple[DataFrame | TextIndex, DataFrame] | None, queries: dict[str, str], query_vectors: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """hybrid_search() over a local and, if there is one, a remote index (chunks, vectors), as overlaid_search() merges them, the `limit` best of each query. (query_id, id, path, score, origin, place)"""
    mine = hybrid_search(*local, queries, query_vectors, options)
    theirs = hybrid_search(*remote, queries, query_vectors, options) if remote else mine.limit(0)
    return overlaid_search(mine, theirs).filter(F.col("place") <= options.limit)


def research(results: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Summaries of search results (query_id, chunk_id, path, kind, score): kinds by number, files, symbols, related topics and the reference list."""
    rows = results.join(chunks.select(F.col("id").alias("chunk_id"), "symbols", "references"), "chunk_id")
    first = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "chunk_id")
    per_path = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    names = per_path.select("query_id", "path", "score", F.explode("symbols").alias("name"), F.lit("symbol").alias("role")).unionByName(per_path.select("query_id", "path", "score", F.explode("references").alias("name"), F.lit("reference").alias("role")))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", F.desc("role"), "name")
    limited = lambda d, order, n: d.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("n") <= n).drop("n")
    return {
        "kinds": results.groupBy("query_id", "kind").agg(F.count("*").alias("n")),
        "files": limited(results.select("query_id", "path").distinct(), ["path"], 10),
        "symbols": limited(rows.select("query_id", F.explode("symbols").alias("symbol")).distinct(), ["symbol"], 10),
        "topics": limited(rows.select("query_id", F.explode("references").alias("topic")).distinct(), ["topic"], 10),
        "references": names.withColumn("n", F.row_number().over(place)).filter("n <= 50").select("query_id", "n", "path", "name", "role"),
    }
