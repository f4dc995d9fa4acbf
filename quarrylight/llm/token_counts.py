"""Token counts through a cache of digests.

The cache is a Parquet folder of (digest, n_tokens); a digest is the SHA-256 of the
tokenizer's version (the digest of its file) and of the content. Scan tasks fold their own
equal texts together, stored counts are joined on, each digest that misses is encoded once,
and its count is appended to the cache. Counts then go back to the rows by digest, a join that
Spark splits where a digest is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarrylight.llm.common import prepare, spread, text_buffer, texts_only
from quarrylight.llm.tokens import piece_bpe

_CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> bytes:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def _digests(data: bytes, offsets: np.ndarray, version: bytes) -> list[bytes]:
    bounds = offsets.tolist()
    return [hashlib.sha256(version + data[a:b]).digest()[:16] for a, b in zip(bounds, bounds[1:])]


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; empty where there is no cache yet. A digest that two runs appended counts once."""
    try:
        return spark.read.schema(_CACHE).parquet(cache).dropDuplicates(["digest"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; null text is empty and has no token. New counts are appended to the cache.

    Each row has its count, also one that repeats or has no doc_id; each distinct text is encoded once. An empty table gives no rows and adds nothing. Columns other than doc_id and text are not read."""
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_version(tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(_digests(data, offsets, version), pa.binary())], ["doc_id", "n_bytes", "digest"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            digests = _digests(data, offsets, version)
            new = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
            if len(seen) > 1_000_000:
                seen.clear()
            bounds = offsets.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array([data[bounds[i] : bounds[i + 1]] for i in new], pa.binary())], ["digest", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = piece_bpe(tokenizer), None
        for batch in batches:  # sorted by digest, so equal ones are neighbours
            digests = batch.column("digest").to_pylist()
            new = [i for i, d in enumerate(digests) if d != (digests[i - 1] if i else last)]
            last = digests[-1] if digests else last
            chosen = batch.column("text").take(pa.array(new, pa.int64()))
            counts = np.diff(encoder.counts(*text_buffer(chosen)))
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    table = texts_only(docs)
    have = stored_counts(spark, cache)
    misses = table.mapInArrow(distinct, "digest binary, text binary")
    if have.head(1):
        misses = misses.join(have.select("digest"), "digest", "left_anti")
    misses.repartition(spread(table), "digest").sortWithinPartitions("digest").mapInArrow(encode, _CACHE).write.mode("append").parquet(cache)
    return table.mapInArrow(rows, "doc_id long, n_bytes long, digest binary").join(stored_counts(spark, cache), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
