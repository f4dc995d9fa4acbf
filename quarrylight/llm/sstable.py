"""Token ids in sorted-string-table shards.

A shard is one file, a run of sections that each end in a newline byte (the line end of
Spark's text sink, through which the files reach any store that Spark writes to):

    data block   entries in key order: varints for the bytes that the key shares with the one
                 before it, the bytes that follow, and the bytes of the value; then the
                 key's rest and the value. The first key of a block is whole.
    block index  for each block: its last key, place and length
    Bloom filter over the keys
    footer       of FOOTER.size bytes: places of index and filter, shard, documents, ids, width of an id

A key is nine bytes: 0 and zeros for a null doc_id, else 1 and the id as a big-endian word
with its sign flipped, so that byte order is numeric order. Values are ids of `width` bytes,
little-endian. Equal ids stand next to each other in one shard. Shards hold ascending ranges
of doc_id; `spark.read.format("binaryFile")` reads them back.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import materialise, mix, prepare, shared_path, spread, text_buffer, texts_only
from quarrylight.llm.tokens import Encoder

FOOTER = struct.Struct("<8sQQQQQQQBB")
MAGIC = b"QLSST\x00\x011"
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Places in the Bloom filter, PROBES for each key, by double hashing."""
    x = np.frombuffer(b"".join(k[1:] for k in keys), ">u8").astype(np.uint64) + np.frombuffer(bytes(k[0] for k in keys), np.uint8)
    a, b = mix(x), mix(x + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Sections of one shard. add() gives a section whenever a block is full; finish() gives the rest."""

    def __init__(self, shard: int, width: int, block_bytes: int = 64 << 10) -> None:
        self.shard, self.width, self.block_bytes = shard, width, block_bytes
        self.place, self.ids, self.block, self.last = 0, 0, [], b""
        self.size, self.index, self.keys = 0, [], []

    def _section(self, body: bytes) -> bytes:
        self.place += len(body) + 1
        return body

    def _close(self) -> bytes:
        body = b"".join(self.block)
        self.index.append(self.last + struct.pack("<QQ", self.place, len(body)))
        self.block, self.size, self.last = [], 0, b""
        return self._section(body)

    def add(self, key: bytes, value: bytes) -> bytes | None:
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        return self._close() if self.size >= self.block_bytes else None

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._close()
        index_at, index = self.place, b"".join(self.index)
        yield self._section(index)
        bits = max(64, len(self.keys) * BITS_PER_KEY) // 8 * 8
        bloom = np.zeros(bits, np.bool_)
        for i in range(0, len(self.keys), 4096):
            bloom[_probes(self.keys[i : i + 4096], bits)] = True
        bloom_at, packed = self.place, np.packbits(bloom).tobytes()
        yield self._section(packed)
        yield FOOTER.pack(MAGIC, index_at, len(index), bloom_at, len(packed), self.shard, len(self.keys), self.ids, self.width, len(self.keys) > 0)


class Reader:
    """One shard's bytes: lookup by Bloom filter, binary search of the block index and a scan of one block; or all entries in order."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        magic, index_at, index_len, bloom_at, bloom_len, self.shard, self.documents, self.n_ids, self.width, _ = FOOTER.unpack(data[-FOOTER.size - 1 : -1])
        if magic != MAGIC or data[-1:] != b"\n":
            raise ValueError("not a whole shard")
        index = data[index_at : index_at + index_len]
        self.lasts = [index[i : i + 9] for i in range(0, len(index), 25)]
        self.blocks = [struct.unpack("<QQ", index[i + 9 : i + 25]) for i in range(0, len(index), 25)]
        self.bloom, self.bits = data[bloom_at : bloom_at + bloom_len], bloom_len * 8

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] & (128 >> (p & 7)) for p in _probes([key], self.bits)[0].tolist())

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size = self.blocks[i]
        data, end, key = self.data, at + size, b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry with this key, or None."""
        key = key_of(doc_id)
        if not self.documents or not self.may_hold(key):
            return None
        i = bisect.bisect_left(self.lasts, key)
        if i == len(self.lasts):
            return None
        return next((np.frombuffer(value, f"<u{self.width}") for k, value in self.block(i) if k == key), None)


def shard_of(bounds: list[int], doc_id) -> F.Column:
    """How many bounds lie below doc_id (null: none), by binary search in the JVM."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    kept = F.array(*map(F.lit, bounds)) if n <= 64 else F.from_json(F.lit(str(bounds)), "array<long>")
    step = lambda at, s: F.when((at + s <= n) & (F.get(kept, at + s - 1) < doc_id), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def range_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Bounds of doc_id between ranges of near equal numbers of rows; only the id column is read."""
    if shards < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], max(10_000, 50 * shards))).first()[0]
    return sorted(set(found or []))


def write_shards(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int, vocabulary: int, shards: int, block_bytes: int = 64 << 10) -> str:
    """Encode all texts, end each with end_id, and write shards in ascending doc_id order; the folder's path.

    Ids take two bytes where the vocabulary allows it, else four. Where a doc_id comes more than once, its rows stand in order of their texts."""
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    bounds = range_bounds(docs, shards)
    dealt = texts_only(docs).repartitionById(len(bounds) + 1, shard_of(bounds, F.col("doc_id"))).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, encode, out, held = Writer(TaskContext.get().partitionId(), width, block_bytes), encoder(), [], 0
        for batch in batches:
            flat, first = encode.ids(*text_buffer(batch.column("text")))
            ends = np.empty(len(flat) + batch.num_rows, f"<u{width}")
            place = np.arange(len(flat)) + np.repeat(np.arange(batch.num_rows), np.diff(first))
            ends[first[1:] + np.arange(batch.num_rows)] = end_id
            ends[place] = flat
            values, stops = ends.tobytes(), (first + np.arange(batch.num_rows + 1)) * width
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                if (block := writer.add(key_of(doc_id), values[a:b])) is not None:
                    out.append(block)
                    held += len(block)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["section"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([*out, *writer.finish()], pa.binary())], ["section"])

    path = shared_path(spark, "sstable")
    dealt.mapInArrow(write, "section binary").select(F.col("section").cast("string").alias("value")).write.option("compression", "none").text(path)
    return path


_ROWS = "shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, local_start, n_tokens, ids_crc32 of each document, from the files. The checksum is that of the ids as 32-bit words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if not (data := content.as_py()):
                    continue
                reader, rows, at = Reader(data), [], 0
                for key, value in reader:
                    ids = np.frombuffer(value, f"<u{reader.width}")
                    rows.append((reader.shard, id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4"))))
                    at += len(ids)
                assert len(rows) == reader.documents and at == reader.n_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.read.schema(kind).format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(read, _ROWS)


#: Shards whose sums are broadcast; those of more are joined by a shuffle.
MOST_BROADCAST = 200_000


def token_table(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int, vocabulary: int, shards: int | None = None) -> DataFrame:
    """Write all documents to shards and read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null texts are empty, and a document has its end id at least. Rows with a null doc_id come first; rows that repeat, or share a doc_id, are documents of their own, one after
    the other in any order. An empty table gives no rows. Columns other than doc_id and text are not read. The sums before a shard come from one row a shard."""
    spark = docs.sparkSession
    prepare(spark)
    shards = shards or spread(docs)
    rows = materialise(read_shards(spark, write_shards(docs, encoder, end_id, vocabulary, shards)), "sstable-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    small = F.broadcast(base) if shards <= MOST_BROADCAST else base
    return rows.join(small, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
