"""Cosine nearest neighbours and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.fulltext import top_k
from quarrylight.session import ship, stored

#: Query vectors that cosine_scores() broadcasts, and of one block; vectors of one block; queries up to which nearest() broadcasts them.
MOST_QUERIES, MOST_VECTORS, FEW_QUERIES = 10_000, 32_768, 100
#: Neighbours up to which semantic_search() broadcasts them to the chunks.
MOST_BROADCAST = 200_000


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def check_dimension(vectors: DataFrame, dimension: int) -> None:
    """Raise if a vector has another length."""
    bad = vectors.filter(F.size("embedding") != dimension).select("id").head()
    if bad:
        raise ValueError(f"vector {bad['id']} has not {dimension} components")


def cosine_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of each query (query_id, vector) and each vector of its length; zero vectors have none. Exact."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} query vectors in one job")
    asked = queries.select("query_id", F.col("vector").alias("q"), dot("vector", "vector").alias("qq")).filter("qq > 0")
    given = vectors.select("id", "embedding", dot("embedding", "embedding").alias("vv")).filter("vv > 0")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("embedding", "q") / F.sqrt(F.col("vv") * F.col("qq"))))  # one root, so that a vector is at exactly 1 from itself
    return given.join(F.broadcast(asked), F.size("embedding") == F.size("q")).select("query_id", "id", score.alias("score"))


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    """Rows scaled to length 1."""
    flat = rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(rows), -1) / rows.column("n").to_numpy()[:, None]


def best_pairs(queries: np.ndarray, vectors: np.ndarray, k: int, high: int = 1024, wide: int = 4096) -> tuple[np.ndarray, ...]:
    """(row of queries, row of vectors, score) of the k largest products of each query; equal to nine digits is a tie, by the row of vectors."""
    out = []
    for top in range(0, len(queries), high):
        part = queries[top : top + high]
        least = np.full(len(part), -np.inf)
        row, column, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(vectors), wide):
            found = part @ vectors[at : at + wide].T
            if at == 0 and found.shape[1] > k:
                least = np.partition(found, -k, axis=1)[:, -k]
            r, c = np.nonzero(~(found < (least - 2e-9)[:, None]))
            row, column, score = np.append(row, r), np.append(column, at + c), np.append(score, found[r, c])
            rounded = np.where(np.isnan(score), np.inf, np.round(score, 9))
            order = np.lexsort((column, -rounded, row))
            place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            kept = order[place < k]
            last = order[place == k - 1]
            least[row[last]] = np.maximum(least[row[last]], rounded[last])
            row, column, score = row[kept], column[kept], score[kept]
        out.append((top + row, column, score))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nearest_in_parts(vectors: DataFrame, queries: DataFrame, k: int, least: int = 1) -> DataFrame:
    """nearest() among the vectors (part, id, embedding) of the parts that a query (part, query_id, vector) names. Each block of queries meets each block of vectors in one task, which passes on k rows of a query; nothing is broadcast."""
    ship(vectors.sparkSession)
    given = vectors.select("part", "id", "embedding", F.size("embedding").alias("size"), F.sqrt(dot("embedding", "embedding")).alias("n")).filter("n > 0")
    asked = queries.select("part", "query_id", "vector", F.size("vector").alias("size"), F.sqrt(dot("vector", "vector")).alias("n")).filter("n > 0")
    n, m = vectors.count(), queries.count()
    tall, wide = max(1, -(-m // MOST_QUERIES)), max(-(-n // MOST_VECTORS), min(least, n // 1024), 1)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    given = given.withColumns({"v": F.pmod(F.xxhash64("id"), F.lit(wide)).cast("int"), "q": every(tall)})
    asked = asked.withColumns({"q": F.pmod(F.xxhash64("query_id"), F.lit(tall)).cast("int"), "v": every(wide)})
    key = ["part", "size", "q", "v"]

    def best(vs: pa.Table, qs: pa.Table) -> pa.Table:
        vs = vs.take(pc.sort_indices(vs.column("id"), null_placement="at_start"))
        if not len(vs) or not len(qs):
            row, column, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            row, column, score = best_pairs(_matrix(qs, "vector"), _matrix(vs, "embedding"), k)
        return pa.table({"query_id": qs.column("query_id").take(pa.array(row)), "id": vs.column("id").take(pa.array(column)), "score": pa.array(score)})

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    return top_k(given.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(best, kinds), k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest, for any number of queries; the threshold comes after the cut, so there may be fewer."""
    if queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        best = top_k(cosine_scores(vectors, queries), k)
    else:
        one = F.lit(0).alias("part")
        best = _nearest_in_parts(vectors.select(one, "id", "embedding"), queries.select(one, "query_id", "vector"), k, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def intent_table(spark, intents: dict) -> DataFrame:
    """A row for each query whose intent calls for boosts, to be broadcast."""
    rows = [(q, i.implementation, i.protocol, [t.lower() for t in i.types], i.kinds) for q, i in intents.items() if i.reranks]
    return spark.createDataFrame(rows, "query_id string, implementation boolean, protocol boolean, types array<string>, kinds array<string>")


def intent_boost() -> F.Column:
    """Product of the metadata boosts that an analysed query asks for, over rows that have the columns of a chunk and of intent_table()."""
    named = lambda c, t: F.exists(c, lambda x: F.lower(x).contains(t))
    types = F.aggregate("types", F.lit(1.0), lambda out, t: out * F.when(named("conformances", t), 1.5).when(named("symbols", t), 1.2).otherwise(1.0))
    out = F.when(F.col("implementation"), types).otherwise(1.0)
    out = out * F.when((F.size("kinds") > 0) & F.array_contains("kinds", F.col("kind")), 1.3).otherwise(1.0)
    out = out * F.when(F.col("protocol") & (F.col("kind") == "protocol"), 1.3).otherwise(1.0)
    return out * F.when(F.col("implementation") & (F.col("kind") != "protocol") & (F.size("conformances") > 0), 1.2).otherwise(1.0)


def semantic_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, intents: dict, limit: int) -> DataFrame:
    """(query_id, id, score, rank): over-fetches twice the limit, boosts queries whose intent is known, sorts again and cuts."""
    best = stored(nearest(vectors, queries, 2 * limit).drop("rank"), "nearest")  # 2 * limit rows a query
    ids = best.select("id").distinct()
    ids = F.broadcast(ids) if best.count() <= MOST_BROADCAST else ids
    rows = best.join(chunks.select("id", "kind", "symbols", "conformances").join(ids, "id", "left_semi"), "id", "left").join(F.broadcast(intent_table(chunks.sparkSession, intents)), "query_id", "left")
    boost = F.when(F.col("implementation").isNotNull(), F.coalesce(intent_boost(), F.lit(1.0))).otherwise(1.0)
    return top_k(rows.select("query_id", "id", (F.col("score") * boost).alias("score")), limit)


def hash_embedding(text: str, dimension: int) -> np.ndarray:
    """A unit vector that depends on the text alone: FNV-1a seeds xorshift64, whose numbers are spread over (-1, 1)."""
    seed = 0xCBF29CE484222325
    for b in text.encode():
        seed = (seed ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    out = np.empty(dimension)
    for i in range(dimension):
        seed ^= seed << 13 & 0xFFFFFFFFFFFFFFFF
        seed ^= seed >> 7
        seed ^= seed << 17 & 0xFFFFFFFFFFFFFFFF
        out[i] = seed / 2**63 - 1
    return out / np.linalg.norm(out)


def embed(rows: DataFrame, encode: Callable[[list[str]], list] | None = None, dimension: int = 384, text: str = "content") -> DataFrame:
    """rows with an embedding of text. encode takes a list of texts, so that a model sees batches; the default is hash_embedding. Empty texts raise."""
    encode = encode or (lambda batch: [hash_embedding(t, dimension) for t in batch])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if (batch.isna() | (batch == "")).any():
                raise ValueError("an empty text has no embedding")
            yield pd.Series([np.asarray(v, np.float32).tolist() for v in encode(batch.tolist())])

    return rows.withColumn("embedding", run(F.col(text)))


class ProviderChain:
    """The first available provider that works, and the same one from then on; if none does, all their errors."""

    def __init__(self, providers: dict[str, Callable[[list[str]], list]]) -> None:
        self.providers, self.active = providers, None

    def __call__(self, texts: list[str]) -> list:
        errors = {}
        for name in [self.active] if self.active else self.providers:
            try:
                out = self.providers[name](texts)
                self.active = name
                return out
            except Exception as e:  # noqa: BLE001  a provider may fail in any way
                errors[name] = str(e)
        if self.active:
            self.active = None
            return self(texts)
        raise RuntimeError(f"no provider works: {errors}")


def bucketed_nearest(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 16, probes: int | None = None, recall: float = 0.95, seed: int = 7, sample: int = 200) -> DataFrame:
    """Approximate neighbours: vectors go to the nearest of `cells` k-means centres, queries look into `probes` cells. Centres come from a fit over all vectors.

    Unless given, probes is the least number that finds `recall` of the exact neighbours of a sample of the queries."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.withColumn("n", F.sqrt(dot("embedding", "embedding"))).filter("n > 0").withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("n"))))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(unit)
    placed = model.transform(unit).select("id", "embedding", F.col("prediction").alias("part"))
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>").filter(dot("centre", "centre") > 0)
    asked = queries.filter(dot("vector", "vector") > 0).crossJoin(F.broadcast(centres)).withColumn("near", dot("vector", "centre") / F.sqrt(dot("centre", "centre")))
    cell_ranks = top_k(asked.withColumn("id", F.col("cell").cast("string")), cells, "near").select("query_id", "vector", F.col("cell").alias("part"), "rank")
    if probes is None:
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        one = F.lit(0).alias("part")
        exact = _nearest_in_parts(vectors.select(one, "id", "embedding"), some.select(one, "query_id", "vector"), k, 12).select("query_id", "id")
        hits = dict(exact.join(placed.select("id", "part"), "id").join(cell_ranks.select("query_id", "part", "rank"), ["query_id", "part"]).groupBy("rank").count().collect())
        found = np.cumsum([hits.get(i + 1, 0) for i in range(cells)])
        probes = 1 + int(np.argmax(found >= recall * found[-1])) if found[-1] else cells
    return _nearest_in_parts(placed, cell_ranks.filter(F.col("rank") <= probes).select("part", "query_id", "vector"), k)
