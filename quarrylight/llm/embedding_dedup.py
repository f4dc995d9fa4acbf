"""Near-duplicate vectors by p-stable hashing in Euclidean space.

Cosine c of normalised vectors is distance sqrt(2 - 2 c). A table's hash is k quantised random
projections floor((a.v + b) / w) with Gaussian a; vectors of one label with the same k numbers
share a bucket. k balances what a table costs against the strangers in a bucket, whose distances
are measured on a sample of the vectors, and the number of tables follows from the chance that a
pair just at the threshold shares one bucket at least.

1. Equal vectors of one label are one class. Each class gives one small row for each table: its
   bucket and a sketch, the signs of BITS further projections. No vector is shuffled here.
2. In a bucket, classes whose sketches differ in few bits are candidates. The number of bits follows
   from the chance that a linked pair differs in more. Only a tree is passed on for each group of
   candidates. A class close to an earlier one of its bucket is attached to that one, by scan tasks
   before the shuffle and by the bucket's owner after it, and the window of that one grows by the
   distance (Hamming distance is a metric, so no candidate is lost); what a bucket holds in memory
   are those that nothing was close to. A bucket of thousands of near copies so costs one row for
   each scan batch.
3. Connected candidates meet once, with their vectors, whatever number of tables brought them
   together. Every pair among them is checked by its exact cosine in double precision, and gives
   the numbers of links and the components. More than `most` are checked in pairs of blocks. That
   is the square of a group of near copies, as counting its links takes, but once, as matrix products.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import discard, materialise, mix, prepare, release, spread
from quarrylight.llm.graph import components

#: Bits of a sketch; how many of them may differ from an earlier class of the bucket that a class is attached to; classes of a bucket whose bits are compared at a time, and that share a table of what is near.
BITS, CLOSE, CHUNK, WIDE = 256, 20, 512, 2048
#: Vectors whose distances to each other stand for those of strangers.
SAMPLE = 2000


def collision(distance: float, w: float) -> float:
    """Chance that one projection of width w puts two vectors at this distance together."""
    t = w / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(vectors: int, cosine: float, recall: float, strangers: np.ndarray | None = None) -> tuple[float, int, int]:
    """(w, k, tables) for so many vectors of one label. strangers: distances of some pairs that don't link; orthogonal ones unless given.

    A table costs a row to write and sort, some time for each projection, and a comparison with each stranger in the bucket."""
    near = math.sqrt(2 - 2 * cosine)
    w = 4 * near
    close, far = collision(near, w), np.array([collision(max(d, near), w) for d in (strangers if strangers is not None and len(strangers) else [math.sqrt(2)])])

    def tables(k: int) -> int:
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - close**k)))

    k = min(range(1, 41), key=lambda k: tables(k) * (1 + 0.02 * k + 0.01 * vectors * float((far**k).mean())))
    return w, k, tables(k)


def most_bits(cosine: float, lost: float) -> int:
    """So many bits that linked vectors' sketches differ in more with a chance below `lost`."""
    share, chance, total = math.acos(cosine) / math.pi, 0.0, 0
    for n in range(BITS + 1):
        chance += math.exp(math.lgamma(BITS + 1) - math.lgamma(n + 1) - math.lgamma(BITS - n + 1) + n * math.log(share) + (BITS - n) * math.log1p(-share))
        total = n
        if 1 - chance <= lost:
            break
    return total


class Hasher:
    """Bucket numbers of vectors in all tables, and sketches."""

    def __init__(self, dim: int, w: float, k: int, tables: int, seed: int = 77) -> None:
        rng = np.random.default_rng(seed + dim)
        self.w, self.k, self.tables = w, k, tables
        self.directions, self.shift = rng.standard_normal((dim, tables * k)), rng.uniform(0, w, tables * k)
        self.signs = rng.standard_normal((dim, BITS))

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.floor((unit @ self.directions + self.shift) / self.w).astype(np.int64).reshape(len(unit), self.tables, self.k)
        out = np.repeat(np.arange(self.tables, dtype=np.uint64)[None], len(unit), 0)
        for i in range(self.k):
            out = mix(out * np.uint64(31) + codes[:, :, i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return out, np.packbits(unit @ self.signs > 0, axis=1).view(np.uint64)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches (.., words) differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


_ROWS = "vec_id long, label long, class binary, vector binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes and a digest of label and vector; both null where the vector can't be compared."""
    for batch in batches:
        rows = []
        for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = np.array(values, np.float64) if label is not None and values and None not in values else np.zeros(0)
            with np.errstate(over="ignore"):
                norm = float((x * x).sum()) if len(x) else 0.0
            if not np.isfinite(norm) and np.isfinite(x).all():  # too long to square: only the direction matters
                x = x / np.abs(x).max()
                norm = 1.0
            if len(x) and norm == 0 and x.any():
                x = x / np.abs(x).max()
                norm = 1.0
            good = norm > 0 and np.isfinite(norm)
            raw = x.tobytes() if good else None
            rows.append((label, hashlib.blake2b(f"{label}:".encode() + raw, digest_size=16).digest() if good else None, raw))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["vec_id", "label", "class", "vector"])


_ENTRY = "bucket long, cid long, other long, reach int, sketch binary"
_ENTRY_NAMES = ["bucket", "cid", "other", "reach", "sketch"]


def _buckets(w: float, k: int, tables: int):
    """A row for each class and table: bucket, class, and what it needs to meet others; or, if an earlier one of the batch in the same bucket is close, that one as `other`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            vectors, labels = batch.column("vector").to_pylist(), batch.column("label").to_numpy().astype(np.uint64)
            cids = batch.column("cid").to_numpy()
            sizes = np.array([len(v) // 8 for v in vectors], np.int64)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                codes, sketches = hashers.setdefault(dim, Hasher(dim, w, k, tables))(_unit([vectors[i] for i in mine.tolist()]))
                keys = mix(codes + mix(labels[mine] * np.uint64(1_000_003) + np.uint64(dim))[:, None]).view(np.int64).reshape(-1)
                row = np.repeat(np.arange(len(mine)), tables)
                order = np.argsort(keys, kind="stable")
                keys, row = keys[order], row[order]
                fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
                head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                away = _differ(sketches[row], sketches[row[head]])
                attached = ~fresh & (away <= CLOSE)
                reach = np.zeros(len(keys), np.int32)
                np.maximum.at(reach, head[attached], away[attached])
                cid = cids[mine]
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(mine), [None, pa.py_buffer(np.ascontiguousarray(sketches).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cid[row]), pa.array(cid[row[head]], mask=~attached), pa.array(reach), raw.take(pa.array(row, mask=attached))], _ENTRY_NAMES)

    return run


def reached(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index that each node is connected with."""
    least = np.arange(len(adjacent))
    todo = adjacent.any(1)
    while todo.any():
        start = int(todo.argmax())
        inside, edge = np.zeros(len(adjacent), np.bool_), np.zeros(len(adjacent), np.bool_)
        inside[start] = edge[start] = True
        while edge.any():
            edge = adjacent[edge].any(0) & ~inside
            inside |= edge
        least[inside] = start
        todo &= ~inside
    return least


def _candidates(bits: int):
    """Rows come sorted by bucket; gives trees (u, v) of candidates. Held are the classes of one bucket that nothing earlier was close to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, heads, reach, sketches = None, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, BITS // 64), np.uint64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def add(cid: np.ndarray, far: np.ndarray, sketch: np.ndarray) -> None:
            nonlocal heads, reach, sketches
            for at in range(0, len(cid), CHUNK):
                c, f, x = cid[at : at + CHUNK], far[at : at + CHUNK], sketch[at : at + CHUNK]
                if len(heads):
                    away = np.concatenate([_differ(x[:, None], sketches[i : i + CHUNK]) for i in range(0, len(heads), CHUNK)], axis=1)
                    to = away.argmin(1)
                    d = away[np.arange(len(c)), to]
                    near = d <= CLOSE
                    out.append((heads[to[near]], c[near]))
                    np.maximum.at(reach, to[near], d[near] + f[near])
                    c, f, x = c[~near], f[~near], x[~near]
                heads, reach, sketches = np.append(heads, c), np.append(reach, f), np.concatenate([sketches, x])

        def close() -> None:
            nonlocal heads, reach, sketches
            halves = [np.arange(i, min(i + WIDE, len(heads))) for i in range(0, len(heads), WIDE)]
            for some in halves if len(halves) == 1 else map(np.concatenate, itertools.combinations(halves, 2)):  # all in one square, or each two halves in one
                adjacent = np.zeros((len(some), len(some)), np.bool_)
                for i, j in itertools.product(range(0, len(some), CHUNK), repeat=2):
                    x, y = some[i : i + CHUNK], some[j : j + CHUNK]
                    adjacent[i : i + CHUNK, j : j + CHUNK] = _differ(sketches[x, None], sketches[y]) <= bits + reach[x, None] + reach[y]
                np.fill_diagonal(adjacent, False)
                least = reached(adjacent)
                tied = np.flatnonzero(least != np.arange(len(some)))
                out.append((heads[some[least[tied]]], heads[some[tied]]))
            heads, reach, sketches = heads[:0], reach[:0], sketches[:0]

        def give() -> pa.RecordBatch:
            u, v = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            attached = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
            if attached.any():
                some = batch.filter(pa.array(attached))
                out.append((some.column("other").to_numpy(), some.column("cid").to_numpy()))
                batch = batch.filter(pa.array(~attached))
            if not batch.num_rows:
                continue
            keys, cids, far = (batch.column(c).to_numpy() for c in ("bucket", "cid", "reach"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(keys), -1)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if keys[a] != bucket:
                    close()
                    bucket = keys[a]
                add(cids[a:b], far[a:b], sketch[a:b])
            if len(out) > 1000:
                yield give()
        close()
        yield give()

    return run


_CHECKED = "cid long, least long, links long, split boolean"


def _check(cosine: float, tile: int = 1024):
    """Rows come sorted by (component, label, size, part, other); one group is held at a time. Gives for each class of it the links (rows) and the smallest class that it's connected with here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            if len(rows) < 2:
                return
            unit, n, side = _unit([r[2] for r in rows]), np.array([r[1] for r in rows], np.float64), np.array([r[3] for r in rows])
            crossed = key[3] != key[4]  # a pair of blocks, of which one may be empty here
            adjacent = np.zeros((len(rows), len(rows)), np.bool_)
            for a in range(0, len(rows), tile):
                adjacent[a : a + tile] = unit[a : a + tile] @ unit.T >= cosine
            adjacent |= adjacent.T
            np.fill_diagonal(adjacent, False)
            if crossed:
                adjacent &= side[:, None] != side
            links = (adjacent.astype(np.float64) @ n).astype(np.int64)
            least = reached(adjacent)
            cids = np.array([r[0] for r in rows], np.int64)
            smallest = cids.copy()
            np.minimum.at(smallest, least, cids)
            keep = links > 0
            out.append((cids[keep], smallest[least][keep], links[keep], np.full(int(keep.sum()), rows[0][4])))

        def give() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.bool_)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cid", "least", "links", "split"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("component", "label", "size", "part", "other", "cid", "n", "vector", "side", "split"))
            for component, label, size, part, other, *row in zip(*columns, strict=True):
                if (here := (component, label, size, part, other)) != key:
                    close()
                    key, rows = here, []
                rows.append(row)
            if len(out) > 1000:
                yield give()
        close()
        yield give()

    return run


def _strangers(classes: DataFrame, cosine: float) -> np.ndarray:
    """Distances of pairs of one label, in a sample of all classes, that don't link."""
    rows = classes.select("label", "vector", F.xxhash64("class").alias("h")).orderBy("h").limit(SAMPLE).collect()
    groups: dict[tuple[int, int], list[bytes]] = {}
    for r in rows:
        groups.setdefault((r["label"], len(r["vector"])), []).append(bytes(r["vector"]))
    found = []
    for raw in groups.values():
        unit = _unit(raw[:200])
        products = (unit @ unit.T)[np.triu_indices(len(unit), 1)]
        found.append(np.sqrt(np.maximum(2 - 2 * products[products < cosine], 0)))
    pairs = np.concatenate(found) if found else np.zeros(0)
    return pairs[:: max(1, len(pairs) // 5000)]


def embedding_dedup(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.995, most: int = 2048) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept of each row.

    Only vectors of one label and length are compared. A vector that is null, zero, or holds null or non-finite components, or whose label is null, links with nothing.
    recall is the chance, at least, that a pair exactly at the threshold is found; closer pairs are found more surely. Rows with equal vec_id are vectors of their own.
    A null vec_id is none to be smallest, unless no other is there. An empty table gives no rows. Columns other than vec_id, label and embedding are not read."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = materialise(vectors.select("vec_id", "label", "embedding").mapInArrow(_read, _ROWS), "vectors")
    grouped = rows.filter("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    lost = 1 - recall
    w, k, tables = plan(largest, cosine, 1 - 0.9 * lost, _strangers(classes, cosine))
    entries = classes.select("label", "cid", "vector").mapInArrow(_buckets(w, k, tables), _ENTRY)
    dealt = entries.repartition(spread(vectors), "bucket").sortWithinPartitions("bucket")
    pairs = materialise(dealt.mapInArrow(_candidates(most_bits(cosine, 0.1 * lost)), "u long, v long"), "vector-pairs")
    release(spark)
    members = classes.join(components(pairs).withColumnRenamed("node", "cid"), "cid").select("component", "label", F.length("vector").alias("size"), "cid", "n", "vector")
    sizes = members.groupBy("component", "label", "size").agg(F.count("*").alias("count")).filter("count > 1")
    blocks = F.ceil(F.col("count") * 2 / most).cast("int")
    met = members.join(sizes, ["component", "label", "size"]).withColumns({"split": F.col("count") > most, "side": F.when(F.col("count") > most, F.pmod(F.xxhash64("cid"), blocks).cast("int")).otherwise(0)})
    met = met.withColumn("o", F.explode(F.when(F.col("split"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))))
    met = met.withColumns({"part": F.least("side", "o"), "other": F.greatest("side", "o")})
    key = ["component", "label", "size", "part", "other"]
    checked = met.select(*key, "cid", "n", "vector", "side", "split").repartition(spread(vectors), *key).sortWithinPartitions(*key)
    found = materialise(checked.mapInArrow(_check(cosine), _CHECKED), "vector-links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"), F.min("least").alias("near"), F.max("split").alias("split"))
    across = found.filter("split")
    tables_used = [classes, found, pairs]
    if across.head(1):
        joined = components(across.select(F.col("cid").alias("u"), F.col("least").alias("v"))).withColumnRenamed("node", "cid")
        counts = counts.join(joined, "cid", "left").withColumn("near", F.coalesce("component", "near")).drop("component")
    each = classes.select("cid", "class", "n", "least").join(counts, "cid", "left").withColumn("component", F.coalesce("near", "cid"))
    smallest = each.groupBy("component").agg(F.min("least").alias("component_id"))
    each = materialise(each.join(smallest, "component").select("class", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-answers")
    discard(*tables_used)
    release(spark)
    result = rows.select("vec_id", "class").join(each, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
