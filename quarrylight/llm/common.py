"""Shared folder handling, Arrow text buffers and vectorised word hashing.

Every function on text takes null as the empty text. Arrays that come from Arrow
are read-only views on one batch, so memory is bounded by the Arrow batch.
"""

from __future__ import annotations

import gc
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarrylight.session import file_system, shared_dir, ship, until_exit

#: Rows and bytes of an Arrow batch, whichever is reached first. A row that alone has more bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b"\t\n\x0b\x0c\r "


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is ever written to it twice."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors. What isn't discarded before goes when the driver ends."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    until_exit(df.sparkSession, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = (table, path)
    return table


#: Materialised tables that weren't discarded, with their paths; in the order of writing.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def written() -> int:
    """How many tables there are, for sweep()."""
    return len(_WRITTEN)


def sweep(since: int, *keep: DataFrame) -> None:
    """Discard the tables that were written since written() gave this number, but those to keep: for a job whose steps are all done."""
    kept = set(map(id, keep))
    discard(*(table for table, _ in list(_WRITTEN.values())[since:] if id(table) not in kept))


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no plan will read again."""
    for table in tables:
        system, place = file_system(table.sparkSession, _WRITTEN.pop(id(table))[1])
        system.delete(place, True)


def prepare(spark: SparkSession) -> None:
    """What all operators need: the package on all workers, small Arrow batches and adaptive handling of skewed joins. These settings stay: plans made here run after the operator has returned."""
    shared_dir(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done and written: it does so once the JVM has collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(docs: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle of docs: as the session has them, or more where Spark's estimate of the size comes to more than `each` bytes in one."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), size // each if size < 1 << 55 else 0)


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named; whatever else the table has can't clash."""
    return docs.select("doc_id", "text", *more)


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """All texts of a column end to end in UTF-8, and n + 1 offsets into them. Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col) or col.buffers()[2] is None:
        return b"", np.zeros(len(col) + 1, np.int64)
    return memoryview(col.buffers()[2])[offsets[0] : offsets[-1]].tobytes(), offsets - offsets[0]


_RNG = np.random.default_rng(0x51A7)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums of a polynomial over the bytes."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER.take(data) * _powers(_P, len(data)), out=sums[1:])
    return sums


def sum_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of the bytes that running_sums() saw; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(_P_INV, len(sums))[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[starts[i]:ends[i]]."""
    return sum_hashes(running_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def words_of(lowered: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes other than ASCII white space), and for each text the index of its first word (n + 1)."""
    if not lowered:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.frombuffer(lowered.translate(_IN_WORD), np.bool_)
    first = np.zeros(len(lowered) + 1, np.bool_)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_IN_WORD = bytes(c not in SPACES for c in range(256))


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) ranges of texts that together hold some `most` bytes, so that work arrays stay in cache; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def quiet_threads() -> None:
    """One thread for each task: Spark already runs a task on every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
