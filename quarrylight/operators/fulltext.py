"""BM25 over several text fields, for many queries in one job.

Documents are scanned once, a block at a time, and only the counts of the queries' phrases leave the
scan. There is no shuffle of the corpus's tokens: what is shuffled are matches, by query and document.
An index keeps the documents, their postings (a row for each term of each block, by term), and the
corpus's statistics, so that a search reads the pages that hold its terms and no text; there, query
phrases are a small table that is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import segments
from quarrylight.functions.columns import tokens
from quarrylight.plans.query import Match
from quarrylight.session import small_batches, stored

K1, B = 1.2, 0.75
CHUNK_FIELDS = ("content", "symbols", "doc_comment", "generated_description", "conformances")
SNIPPET_FIELDS = ("content", "breadcrumb")
#: Phrase tokens of one job. More are refused, so that what is broadcast is bounded.
MOST_TOKENS = 100_000

#: Ranges of terms that a filter names. Where queries have more, neighbours are joined and the join sorts out the rest.
MOST_RANGES = 64

_TERMS = "query_id string, phrase int, place int, key string, width int, tokens int, phrases int, every boolean"


def match_table(spark: SparkSession, queries: dict[str, Match]) -> DataFrame:
    """A row for each token of each phrase; width is 0 for a whole token, else the prefix's length."""
    rows = [
        (name, i, j, token, len(token) if phrase.prefix and j == len(phrase.tokens) - 1 else 0, len(phrase.tokens), len(match.phrases), match.every)
        for name, match in queries.items()
        for i, phrase in enumerate(match.phrases)
        for j, token in enumerate(phrase.tokens)
    ]
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"{len(rows)} phrase tokens; the most in one job are {MOST_TOKENS}")
    return spark.createDataFrame(rows, _TERMS)


def fielded(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """id, f (tokens of each field) and dl (tokens of all fields). Arrays of strings are taken as text."""
    kinds = dict(docs.dtypes)
    text = [F.concat_ws(" ", F.col(f"`{f}`")) if kinds[f].startswith("array") else F.col(f"`{f}`") for f in fields]
    return docs.select("id", F.array(*(tokens(t) for t in text)).alias("f")).withColumn("dl", F.aggregate("f", F.lit(0), lambda n, x: n + F.size(x)))


def corpus_stats(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row: n documents and avgdl."""
    return fielded(docs, fields).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _texts(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """id and a column of text for each field. Arrays of strings are taken as text."""
    kinds = dict(docs.dtypes)
    return docs.select("id", *((F.concat_ws(" ", F.col(f"`{f}`")) if kinds[f].startswith("array") else F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(fields)))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def postings(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """segments.POSTINGS: a row for each term of each block of documents. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    return _texts(docs, fields).mapInArrow(segments.postings_of, segments.POSTINGS.format(id=_id_type(docs)))


def frequencies(docs: DataFrame, queries: dict[str, Match], fields: tuple[str, ...]) -> DataFrame:
    """segments.FREQUENCIES of the queries' phrases from one scan of the texts."""
    small_batches(docs.sparkSession)
    asked = [(name, i, p.tokens, p.prefix, len(m.phrases), m.every) for name, m in queries.items() for i, p in enumerate(m.phrases)]
    return _texts(docs, fields).mapInArrow(partial(segments.frequencies_of, asked), segments.FREQUENCIES.format(id=_id_type(docs)))


@dataclass
class TextIndex:
    """Documents as stored, segments.POSTINGS (each block's sorted by term, one after the other) and corpus_stats()."""

    docs: DataFrame
    segments: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, id, field, pos, dl) of each token."""
        each = self.segments.select("term", F.explode(F.arrays_zip("ids", "fields", "places", "sizes")).alias("t"))
        return each.select("term", F.col("t.ids").alias("id"), F.col("t.fields").cast("int").alias("field"), F.col("t.places").alias("pos"), F.col("t.sizes").alias("dl"))


def write_index(docs: DataFrame, fields: tuple[str, ...], path: str, files: int) -> TextIndex:
    """Write the three tables below path. Postings are sorted by term within a block, so that minima and maxima of pages prune exact and prefix lookups.

    Documents stay where they are read; only if that gives fewer tasks than there are cores (and files), they are dealt anew."""
    spark = docs.sparkSession
    wanted = min(files, spark.sparkContext.defaultParallelism)
    dealt = docs.repartition(wanted) if docs.rdd.getNumPartitions() < wanted else docs
    dealt.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    kept = spark.read.schema(docs.schema).parquet(f"{path}/docs")
    postings(kept, fields).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.page.row.count.limit", 2000).parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/postings").filter("term is null").select(F.explode("lengths").alias("dl"))
    sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "stats")))


def term_summary(index: TextIndex) -> DataFrame:
    """(term, chunks, places, spread, longest): documents and tokens of each term, the sum of position times field + 1, tokens of the longest document."""
    if index.docs.groupBy("id").count().filter("count > 1").head():  # then a document may lie in two blocks
        return index.postings.groupBy("term").agg(F.countDistinct("id").alias("chunks"), F.count("*").alias("places"), F.sum(F.col("pos") * (F.col("field") + 1)).alias("spread"), F.max("dl").cast("long").alias("longest"))
    small_batches(index.docs.sparkSession)
    parts = index.segments.filter("term is not null").mapInArrow(segments.summary_of, segments.SUMMARY)
    return parts.groupBy("term").agg(F.sum("chunks").alias("chunks"), F.sum("places").alias("places"), F.sum("spread").alias("spread"), F.max("longest").alias("longest"))


def term_ranges(queries: dict[str, Match], most: int = MOST_RANGES) -> list[tuple[str, str]]:
    """Disjoint ascending ranges of terms, `most` at most, that hold all terms the queries can match."""
    asked = {(t, t + "\U0010ffff" if p.prefix and i == len(p.tokens) - 1 else t) for m in queries.values() for p in m.phrases for i, t in enumerate(p.tokens)}
    out: list[tuple[str, str]] = []
    for low, high in sorted(asked):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    each = -(-len(out) // most)
    return [(out[i][0], out[min(i + each, len(out)) - 1][1]) for i in range(0, len(out), each or 1)]


def _in_ranges(term: Column, queries: dict[str, Match]) -> Column:
    return reduce(lambda a, b: a | b, (term.between(low, high) for low, high in term_ranges(queries)), F.lit(False))


def bm25(docs: DataFrame | TextIndex, queries: dict[str, Match], fields: tuple[str, ...] = CHUNK_FIELDS) -> DataFrame:
    """(query_id, id, score) of all matches; higher is better. From an index no text is read.

    A phrase's idf is ln((n - d + 0.5) / (d + 0.5)), 1e-6 where that isn't positive, over all rows of docs; its frequency is summed over fields."""
    if not isinstance(docs, TextIndex):
        return _bm25_of_texts(docs, queries, fields)
    source = docs.postings
    terms = match_table(source.sparkSession, queries)
    widths = sorted({len(p.tokens[-1]) for m in queries.values() for p in m.phrases if p.prefix})
    keys = F.array(F.struct(F.lit(0).alias("width"), F.col("term").alias("key")), *(F.struct(F.lit(w).alias("width"), F.left("term", F.lit(w)).alias("key")) for w in widths))
    near = source.filter(_in_ranges(F.col("term"), queries))
    hits = near.select("id", "dl", "field", "pos", F.explode(keys).alias("k")).select("id", "dl", "field", "pos", "k.width", "k.key").join(F.broadcast(terms), ["width", "key"])
    kept = (F.first("dl").alias("dl"), F.first("phrases").alias("phrases"), F.first("every").alias("every"))
    same = ["query_id", "phrase", "id"]
    frequency = hits.filter("tokens = 1").groupBy(*same).agg(F.count("*").alias("f"), *kept)
    if any(len(p.tokens) > 1 for m in queries.values() for p in m.phrases):
        starts = hits.filter("tokens > 1").groupBy(*same, "field", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("found"), F.first("tokens").alias("tokens"), *kept)
        frequency = frequency.unionByName(starts.filter("found = tokens").groupBy(*same).agg(F.count("*").alias("f"), *kept))
    return _scores(frequency, docs.stats)


def _bm25_of_texts(docs: DataFrame, queries: dict[str, Match], fields: tuple[str, ...]) -> DataFrame:
    """bm25() without an index. What one scan finds is stored, since the weights of the phrases need all of it: a row for each document and phrase that it has."""
    match_table(docs.sparkSession, queries)  # refuses too many tokens
    found = stored(frequencies(docs, queries, fields), "frequencies")
    stats = found.filter("query_id is null").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n"), (F.sum("dl") / F.sum("f")).alias("avgdl"))
    frequency = found.filter("query_id is not null").groupBy("query_id", "phrase", "id").agg(F.sum("f").alias("f"), *(F.first(c).alias(c) for c in ("dl", "phrases", "every")))
    return _scores(frequency, stats)


def _scores(frequency: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, id, score) from (query_id, phrase, id, f, dl, phrases, every) and one row (n, avgdl)."""
    spread = frequency.groupBy("query_id", "phrase").agg(F.count("*").alias("d"))
    idf = F.log((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = frequency.join(F.broadcast(spread), ["query_id", "phrase"]).crossJoin(F.broadcast(stats)).withColumn("weight", weight)  # one row of statistics
    out = scored.groupBy("query_id", "id").agg(F.sum("weight").alias("score"), F.count("*").alias("matched"), F.first("phrases").alias("phrases"), F.first("every").alias("every"))
    return out.filter(~F.col("every") | (F.col("matched") == F.col("phrases"))).select("query_id", "id", "score")


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1; equal to nine digits is a tie, by id. Spark keeps only k rows of a query in each task before it shuffles."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), "id"))).filter(F.col("rank") <= k)


def term_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n): chunks that have the term as a symbol or anywhere in their text, whatever its case. One scan for all terms, which come as one broadcast row."""
    spark = chunks.sparkSession
    one = spark.createDataFrame([([(t, t.lower()) for t in dict.fromkeys(terms)],)], "terms array<struct<term: string, low: string>>")
    rows = chunks.select(F.lower("content").alias("content"), F.transform("symbols", F.lower).alias("symbols")).crossJoin(F.broadcast(one))  # one row
    held = F.filter("terms", lambda t: F.array_contains("symbols", t["low"]) | F.col("content").contains(t["low"]))
    found = rows.select(F.explode(held).alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("n"))
    return one.select(F.explode("terms.term").alias("term")).join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def search_snippets(snippets: DataFrame | TextIndex, queries: dict[str, Match], limit: int = 10, path_filter: str | None = None) -> DataFrame:
    """Documentation search: over-fetches twice the limit, filters by path, cuts. (query_id, id, path, score, relevance_percent)"""
    from quarrylight.functions.columns import matches_glob, snippet_percent

    best = top_k(bm25(snippets, queries, SNIPPET_FIELDS), 2 * limit)
    rows = best.join((snippets.docs if isinstance(snippets, TextIndex) else snippets).select("id", "path"), "id")
    if path_filter:
        rows = rows.filter(matches_glob(F.col("path"), path_filter))
    return top_k(rows.drop("rank"), limit).select("query_id", "id", "path", "score", snippet_percent(F.col("score")).alias("relevance_percent"))
