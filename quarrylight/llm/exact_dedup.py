"""Exact dedup over an extendible-hash index in the shared folder.

1. Each scan task folds its own copies together: a page entry holds one text, the ids of
   the rows that have it, and a key of the leading bits of the text's SHA-256. Entries are
   written to the shared folder.
2. The directory starts at depth 0 and doubles until no bucket holds more than
   `bucket_bytes`. It's made from sums by key prefix, some sixteen times as many as there are full
   buckets in the input, and at most 2**max_depth of them; beyond that buckets grow, which an
   owner, who streams them, can bear.
3. Buckets go to owner tasks in key order. An owner reads its bucket sorted by key, chains
   the texts that share a key and compares them byte by byte, so that a collision never joins
   two texts. A text that a third of all rows hold arrives once from each scan task, not once
   from each row.
4. Owners answer by entry; entry ids are unique, so joining the answers back has no hot key.

Null texts count as empty. Rows whose doc_id is null take part (they are kept only where a
group has no other id). Where one doc_id comes in several equal rows, one of these rows is
kept. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import LOWER, discard, materialise, partitions, prepare, release, text_buffer, texts_only

KEY_BITS = 62
_ENTRY = pa.schema([("entry_id", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("max_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("text", pa.binary())])
_ENTRY_SQL = "entry_id long, key long, sha string, n long, max_id long, ids array<long>, n_bytes long, text binary"
_ANSWER = pa.schema([("entry_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_entry", pa.int64())])
_ANSWER_SQL = "entry_id long, keep_id long, group_size long, keep_entry long"


def _fold(key_bits: int, flush_bytes: int):
    """Scan side: entries of a task's distinct texts, given out whenever they come to flush_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        entries: dict[bytes, tuple[bytes, list]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            rows = [(int.from_bytes(sha[:8], "big") >> (64 - key_bits), sha.hex(), text, ids) for sha, (text, ids) in entries.items()]
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                top = [max((x for x in ids if x is not None), default=None) for *_, ids in part]
                yield pa.RecordBatch.from_arrays([pa.array(range(serial, serial + len(part)), pa.int64()), pa.array([k for k, *_ in part], pa.int64()), pa.array([s for _, s, *_ in part]), pa.array([len(ids) for *_, ids in part], pa.int64()), pa.array(top, pa.int64()), pa.array([ids for *_, ids in part], pa.list_(pa.int64())), pa.array([len(t) for *_, t, _ in part], pa.int64()), pa.array([t for *_, t, _ in part], pa.binary())], schema=_ENTRY)
                serial += len(part)
            entries.clear()

        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            data = data.translate(LOWER)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b]
                sha = hashlib.sha256(text).digest()
                had = entries.get(sha)
                if had is None:
                    entries[sha] = (text, [doc_id])
                    held += b - a + 200
                else:
                    had[1].append(doc_id)
                    held += 8
            if held > flush_bytes:
                yield from out()
                held = 0
        yield from out()

    return run


def directory(weights: np.ndarray, max_depth: int, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Extendible-hash directory over 2**max_depth prefix weights: (global depth, bucket of each slot, weight of each bucket).

    A bucket over capacity splits on its next bit; when its depth is the directory's own, the directory doubles."""
    depth, slots, local = 0, np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        sizes = np.bincount(slots, weights.reshape(1 << depth, -1).sum(1))
        full = (sizes > capacity) & (local < max_depth)
        if not full.any():
            return depth, slots, sizes
        if (local[full] == depth).any():
            depth, slots = depth + 1, np.repeat(slots, 2)
        # the slots of a bucket of local depth d are 2**(depth - d) neighbours, and the later half becomes a bucket of its own; numbers stay in key order
        later = np.arange(1 << depth) >> (depth - 1 - local[slots]).clip(0) & 1
        deeper = local[slots] + full[slots]
        _, first, slots = np.unique(slots * 2 + (full[slots] & (later == 1)), return_index=True, return_inverse=True)
        local = deeper[first]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side: rows come sorted by key. A chain has one link for each different text of the key."""
    key, chain = None, []
    rows: list[tuple] = []

    def close() -> None:
        for _, ids, n, top, keeper in chain:
            rows.extend((i, top, n, keeper) for i in ids)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, schema=_ANSWER)
        rows.clear()
        return batch

    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for entry, k, n, top, a, b in zip(*(batch.column(c).to_pylist() for c in ("entry_id", "key", "n", "max_id")), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if k != key:
                close()
                key, chain = k, []
            text = data[a:b]
            for link in chain:
                if link[0] == text:
                    link[1].append(entry)
                    link[2] += n
                    if top is not None and (link[3] is None or (top, -entry) > (link[3], -link[4])):
                        link[3], link[4] = top, entry
                    break
            else:
                chain.append([text, [entry], n, top, entry])
        if len(rows) > 20_000:
            yield out()
    close()
    yield out()


def exact_dedup(docs: DataFrame, key_bits: int = KEY_BITS, bucket_bytes: int = 4 << 20, max_depth: int = 20, flush_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, keep_id (largest doc_id among equal texts), group_size, kept, text_sha256; a row for each row of docs.

    key_bits: fewer make keys collide (for tests). max_depth bounds what comes to the driver: 2**max_depth sums."""
    spark = docs.sparkSession
    prepare(spark)
    entries = materialise(texts_only(docs).mapInArrow(_fold(key_bits, flush_bytes), _ENTRY_SQL), "dedup-entries")
    size = F.sum(F.col("n_bytes") + 64)
    max_depth = min(max_depth, key_bits, 4 + math.ceil(math.log2(max(1, (entries.agg(size).first()[0] or 0) / bucket_bytes))))
    weights = np.zeros(1 << max_depth)
    found = entries.groupBy(F.shiftright("key", key_bits - max_depth).alias("slot")).agg(size.alias("w")).toArrow()
    weights[found.column("slot").to_numpy()] = found.column("w").to_numpy()
    depth, slots, sizes = directory(weights, max_depth, bucket_bytes)
    owners = max(1, partitions(spark), int(sizes.sum() // (128 << 20)))
    owner_of = np.minimum((np.cumsum(sizes) - sizes / 2) / max(sizes.sum(), 1) * owners, owners - 1).astype(int)
    table = spark.createDataFrame([(int(s), int(b), int(owner_of[b])) for s, b in enumerate(slots)], "slot long, bucket long, owner int")
    paged = entries.drop("ids", "sha", "n_bytes").withColumn("slot", F.shiftright("key", key_bits - depth)).join(F.broadcast(table), "slot")
    answers = paged.repartitionById(owners, "owner").sortWithinPartitions("bucket", "key").select("entry_id", "key", "n", "max_id", "text").mapInArrow(_own, _ANSWER_SQL)
    kept = (F.col("entry_id") == F.col("keep_entry")) & (F.col("at") == F.when(F.col("keep_id").isNull(), 0).otherwise(F.array_position("ids", F.col("keep_id")) - 1))
    members = entries.select("entry_id", "sha", "ids").join(answers, "entry_id").select("*", F.posexplode("ids").alias("at", "doc_id"))
    result = materialise(members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")), "dedup-result")
    discard(entries)
    release(spark)
    return result
