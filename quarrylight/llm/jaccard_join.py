"""Exact Jaccard join of documents over word n-grams, as a join in a metric space.

Jaccard distance is a metric; two documents link at distance r = 1 - similarity or less.

1. Cells. A shingle is the pivot of a cell, and a document lies in the cells of its first
   n - ceil(similarity * n) + m shingles in one order for all (rarer ones first). Two linked
   documents share m of these cells at least (with m that of the smaller document). Documents with
   equal shingles count once from here on. Cells that hold one document are dropped, then documents
   that are left with fewer than m cells, and so on: a shared passage alone brings no two together.
2. Families. Linked documents also have sizes within the similarity of each other, so a cell is cut
   in overlapping bands of sizes. The document of a band that shares most cells with others is its
   pivot document. Bands with the same pivot document are one family, so that near copies, which
   meet in dozens of cells, are brought together once. Every linked pair shares a family.
3. Voronoi regions. Each family, of two documents or of millions, is split by the same step. Pivots
   are chosen among its documents and the distance of every document to every pivot is measured.
   What lies within r of a pivot is linked to it. A document goes to the region of its nearest
   pivot, and to each region whose pivot is within 2 r more than the nearest: a linked document
   across the border is at most r nearer, so by the triangle inequality the pair meets there. Of a
   region's documents those within r of its pivot are one component already; they go on only if
   they lie within r of the ring in which the others are. Pivots go no further, nor do regions
   whose documents are all connected. Regions are split again by the same step until none is left;
   regions that share so many documents that splitting would multiply the work (more than OVERLAP
   of the whole) go on as one.
4. A family of up to `most` bytes is split inside one task, where distances come from counts of shared
   shingles. A larger one is split by the same step as a job over all tasks, until its regions fit.
   Documents that no pivot separates (strangers to each other, all at distance near 1) stay one
   region; after `levels` such steps it is dealt as pairs of blocks that fit, each split as above.
   All pairs of blocks meet, so that costs the square of the group, but no link is lost.
5. A region gives out a tree of links, not all pairs. Components of the links, over shingle sets,
   give the component of each document.

Only the order of shingles comes to the driver: the `heavy` commonest, a fixed number, which
decides how fast this is and never what it finds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import LOWER, blocks, discard, materialise, mix, prepare, release, span_hashes, spread, text_buffer, texts_only, words_of
from quarrylight.llm.graph import components

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 65, dtype=np.uint64) * _STEP  # one for each word of a shingle


def shingles(data: bytes, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles, in text order. A text of fewer words is one shingle, one without words none."""
    data = data.translate(LOWER)
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words_of(part, offsets[i : j + 1] - offsets[i])
        words = span_hashes(np.frombuffer(part, np.uint8), starts, ends)
        runs = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            runs = mix(runs * np.uint64(3) + words[k : len(words) - n + 1 + k] + _STEPS[k])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                found = np.sort(runs[a : b - n + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mix(short * np.uint64(5) + words[k : k + 1] + _STEP)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _sig(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


_SCAN = "doc_id long, n long, sig binary, token long, times long"


def _scan(n: int, often: int = 4, held: int = 4 << 20):
    """A row for each document, and the shingles that `often` or more distinct documents of a stretch of the task have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        stretch: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(stretch), return_counts=True) if stretch else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = times >= often
            tokens, times = tokens[keep].view(np.int64), times[keep]
            none = pa.nulls(len(tokens), pa.int64())
            stretch.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(tokens), pa.binary()), pa.array(tokens), pa.array(times)], ["doc_id", "n", "sig", "token", "times"])

        for batch in batches:
            sizes, sigs = [], []
            for found in shingles(*text_buffer(batch.column("text")), n):
                sizes.append(len(found))
                sigs.append(_sig(found) if len(found) else None)
                if len(found) and sigs[-1] not in seen:
                    seen.add(sigs[-1])
                    stretch.append(found)
                    size += len(found)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), none, none], ["doc_id", "n", "sig", "token", "times"])
            if size > held:
                yield common()
                size = 0
        yield common()

    return run


def common_cells(n: int) -> int:
    """How many cells a document of n shingles must share with a linked one of as many or more shingles: a tenth of its size."""
    return max(1, n // 10)


def prefix_length(n: int, num: int, den: int) -> int:
    """How many shingles of n may all be missing from a linked document, and the cells to share."""
    return min(n, n - -(-num * n // den) + common_cells(n))


def _entries(n: int, num: int, den: int, heavy: np.ndarray, weight: np.ndarray):
    """(token, sig, n) for the first shingles of each distinct set of a task. Sets so small that a link needs equality have no entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            tokens, sigs, sizes, whole = [], [], [], []
            for found in shingles(*text_buffer(batch.column("text")), n):
                if len(found) * (den - num) < num:
                    continue
                sig = _sig(found)
                if sig in seen:
                    continue
                seen.add(sig)
                most = prefix_length(len(found), num, den)
                place = np.searchsorted(heavy, found)
                place[place == len(heavy)] = 0
                common = heavy[place] == found if len(heavy) else np.zeros(len(found), np.bool_)
                rare = found[~common]
                if len(rare) < most:
                    late = found[common]
                    rare = np.concatenate([rare, late[np.lexsort((late, weight[place[common]]))]])
                tokens.append(rare[:most])
                sigs.append(sig)
                sizes.append(len(tokens[-1]))
                whole.append(len(found))
            if len(seen) > 500_000:
                seen.clear()
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            owner = pa.array(np.repeat(np.arange(len(sigs)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(sigs, pa.binary()).take(owner), pa.array(whole, pa.int32()).take(owner)], ["token", "sig", "n"])

    return run


def _pruned(cells: DataFrame, num: int, den: int, rounds: int = 3) -> DataFrame:
    """Cells (token, sig, n) without those of one document and documents with too few cells for any link."""
    smaller = F.ceil(F.col("n") * num / den - 1e-9)  # a linked document has so many shingles at least
    need = F.greatest(F.lit(1), F.floor(smaller / 10))
    table = cells
    for _ in range(rounds):
        shared = cells.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token")
        cells = cells.join(shared, "token")
        enough = cells.groupBy("sig").agg(F.count("*").alias("held"), F.first(need).alias("need")).filter("held >= need").select("sig")
        before, cells = table, materialise(cells.join(enough, "sig").select("token", "sig", "n"), "jaccard-cells")
        table = cells
        discard(before)
    return cells


#: Regions whose documents add up to more than so many times the region that they split are one region.
OVERLAP = 1.25
#: Against rounding in the windows; links themselves are decided in whole numbers.
_EDGE = 1e-9


def _overlap(x: np.ndarray, pivot: np.ndarray) -> int:
    place = np.searchsorted(pivot, x)
    place[place == len(pivot)] = 0
    return int((pivot[place] == x).sum())


def region_links(sets: list[np.ndarray], num: int, den: int, fan: int = 8, overlap: float = OVERLAP, seen: list | None = None) -> list[tuple[int, int]]:
    """A tree of links for each component of these sets, by Voronoi regions around pivots. seen, if given, gets (documents, regions, documents of the regions) of each split."""
    k, r = len(sets), 1 - num / den
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(k), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(flat)))
    common = lengths[group] > 1  # a shingle of one set alone adds to no overlap
    by_owner = np.argsort(owner[common], kind="stable")
    mine, at = group[common][by_owner], np.searchsorted(owner[common][by_owner], np.arange(k + 1))
    weight = np.bincount(owner, lengths[group], minlength=k) / sizes
    parent, links = list(range(k)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def shared(i: int) -> np.ndarray:
        """Shingles that set i has in common with each set."""
        groups = mine[at[i] : at[i + 1]]
        n = lengths[groups]
        places = np.repeat(starts[groups] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[places], minlength=k)

    regions = [np.arange(k)]
    while regions:
        region = regions.pop()
        pivots, away, linked = [], [], []
        nearest = np.full(len(region), np.inf)
        pivot = int(weight[region].argmax())
        while True:
            i = int(region[pivot])
            both = shared(i)[region]
            both[pivot] = sizes[i]
            union = sizes[i] + sizes[region] - both
            pivots.append(pivot)
            away.append(1 - both / union)
            linked.append(den * both >= num * union)
            for j in region[linked[-1]].tolist():
                if (a := root(i)) != (b := root(j)):
                    parent[b] = a
                    links.append((i, j))
            nearest = np.minimum(nearest, away[-1])
            pivot = int(nearest.argmax())
            if len(pivots) == min(fan, len(region)) or nearest[pivot] <= r + _EDGE:
                break
        rest = np.ones(len(region), np.bool_)
        rest[pivots] = False
        parts = []
        for far, near in zip(away, linked, strict=True):
            inside = rest & (far <= nearest + 2 * r + _EDGE)
            if (inside & ~near).any():
                part = inside & (far >= far[inside & ~near].min() - r - _EDGE)
                if len({root(j) for j in region[part].tolist()}) > 1:
                    parts.append(part)
        if len(parts) > 1 and sum(int(part.sum()) for part in parts) > overlap * len(region):
            parts = [np.logical_or.reduce(parts)]
        if seen is not None:
            seen.append((len(region), len(parts), sum(int(part.sum()) for part in parts)))
        regions += [region[part] for part in parts]
    return links


def _solve(num: int, den: int):
    """Rows come sorted by family; one family is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, members, out = None, {}, []

        def close() -> None:
            if len(members) > 1:
                sigs = list(members)
                out.extend((sigs[i], sigs[j]) for i, j in region_links([np.frombuffer(s, np.uint64) for s in members.values()], num, den))

        for batch in batches:
            for f, sig, grams in zip(*(batch.column(c).to_pylist() for c in ("family", "sig", "grams")), strict=True):
                if f != family:
                    close()
                    family, members = f, {}
                members[sig] = grams
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["u", "v"])
                out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["u", "v"])

    return run


_MEASURED = "family binary, sig binary, grams binary, away array<double>, mask long, linked array<binary>"


def _measure(num: int, den: int):
    """Members of large families with their families' pivots: the distance to each pivot, and which pivots they link with. A pivot itself is left with its links alone (mask -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for family, sig, grams, pivots in zip(*(batch.column(c).to_pylist() for c in ("family", "sig", "grams", "pivots")), strict=True):
                x, away, mask, linked = np.frombuffer(grams, np.uint64), [], 0, []
                for q, pivot in enumerate(pivots):
                    y = np.frombuffer(pivot["grams"], np.uint64)
                    both = _overlap(x, y)
                    union = len(x) + len(y) - both
                    away.append(1 - both / union)
                    if den * both >= num * union:
                        mask |= 1 << q
                        linked.append(pivot["sig"])
                out.append((family, sig, grams, away, -1 if sig in [p["sig"] for p in pivots] else mask, linked))
            types = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(types)], ["family", "sig", "grams", "away", "mask", "linked"])

    return run


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each family the smallest pivot that each pivot is connected with, by the masks of its documents: those that link with two pivots connect them."""
    for batch in batches:
        groups = []
        for masks, count in zip(batch.column("masks").to_pylist(), batch.column("count").to_pylist(), strict=True):
            least = list(range(count))
            for mask in masks:
                held = [q for q in range(count) if mask >> q & 1]
                roots = {least[q] for q in held}
                least = [min(roots) if x in roots else x for x in least]
            groups.append(least)
        yield pa.RecordBatch.from_arrays([batch.column("family"), pa.array(groups, pa.list_(pa.int32()))], ["family", "groups"])


def _split(hot: DataFrame, num: int, den: int, fan: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of the regions that are left, links found, table that both read) of families (family, sig, grams): the step of region_links() as a job over all tasks."""
    r = 1 - num / den
    slot = F.pmod(F.xxhash64("sig", F.lit(level)), F.lit(fan))
    one = F.min_by(F.struct("sig", "grams"), F.xxhash64("sig", F.lit(level + 99)))
    pivots = hot.groupBy("family", slot.alias("slot")).agg(one.alias("pivot")).groupBy("family").agg(F.collect_list("pivot").alias("pivots"))  # fan at most
    measured = materialise(hot.join(pivots, "family").mapInArrow(_measure(num, den), _MEASURED), "regions-measured")
    links = measured.select(F.col("sig").alias("u"), F.explode("linked").alias("v")).filter("u <> v")
    masks = measured.filter("mask > 0").groupBy("family").agg(F.collect_set("mask").alias("masks"), F.max(F.size("away")).alias("count"))  # 2**fan at most
    groups = masks.mapInArrow(_connected, "family binary, groups array<int>")
    sizes = measured.groupBy("family").agg(F.count("*").alias("size"))
    rows = measured.filter("mask >= 0").join(groups, "family", "left").join(sizes, "family")
    low = F.length(F.regexp_extract(F.reverse(F.bin("mask")), "^(0*)1", 1))  # the lowest pivot that the document links with
    rows = rows.withColumn("tag", F.when(F.col("mask") > 0, F.get("groups", low)).otherwise(F.lit(-1)))
    near = rows.select("family", "sig", "grams", "size", "tag", "mask", F.array_min("away").alias("nearest"), F.posexplode("away").alias("q", "far")).filter(F.col("far") <= F.col("nearest") + 2 * r + _EDGE)
    outer = F.expr("shiftright(mask, q) % 2 = 0")
    rings = near.groupBy("family", "q").agg(F.min(F.when(outer, F.col("far"))).alias("ring"), F.min("tag").alias("a"), F.max("tag").alias("b")).filter("ring is not null and (a < 0 or a < b)").select("family", "q", "ring")
    parts = near.join(rings, ["family", "q"]).filter(F.col("far") >= F.col("ring") - r - _EDGE)
    totals = parts.groupBy("family").agg(F.count("*").alias("total"))
    joined = parts.join(totals, "family").withColumn("part", F.when(F.col("total") > OVERLAP * F.col("size"), F.lit(-1)).otherwise(F.col("q")))
    name = F.unhex(F.md5(F.concat("family", F.encode(F.concat_ws(":", F.lit(level), "part"), "UTF-8"))))
    return joined.select(name.alias("family"), "sig", "grams").dropDuplicates(["family", "sig"]), links, measured


def _regions(members: DataFrame, num: int, den: int, most: int, fan: int, levels: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(members (family, sig, grams) of families that fit into a task, links found on the way, tables that they are read from); see the module's text."""
    done, links, tables = [], [], []
    for level in range(levels + 1):
        sizes = members.groupBy("family").agg(F.sum(F.length("grams")).alias("size"), F.count("*").alias("n"))
        large = sizes.filter((F.col("size") > most) & (F.col("n") > 2)).select("family", "size")
        if not large.head(1):
            break
        hot = members.join(large, "family")
        done.append(members.join(large, "family", "left_anti"))
        if level < levels:
            members, found, table = _split(hot.select("family", "sig", "grams"), num, den, fan, level)
            links.append(found)
            tables.append(table)
        else:
            count = F.ceil(F.col("size") * 2 / most).cast("int")
            block = F.pmod(F.xxhash64("sig", F.lit(level)), count).cast("int")
            with_block = hot.select("family", "sig", "grams", block.alias("b"), F.explode(F.sequence(F.lit(0), count - 1)).alias("o"))
            key = F.unhex(F.md5(F.concat("family", F.encode(F.concat_ws(":", F.least("b", "o"), F.greatest("b", "o")), "UTF-8"))))
            members = with_block.select(key.alias("family"), "sig", "grams")
        members = materialise(members, "regions")
        tables.append(members)
    for d in done:
        members = members.unionByName(d)
    return members, links, tables


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, heavy: int = 1 << 19, most: int = 32 << 20, fan: int = 8, levels: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and set_sha, a digest of the shingles (null without words), for each row.

    Texts link when den * |intersection| >= num * |union| over their distinct n-word shingles; equal sets always do.
    Null and wordless texts link with nothing and are their own components. Rows of one doc_id are one node only if their sets are equal.
    Rows whose doc_id is null link like others; the component_id is the smallest id that there is in the component, null if none has one.
    An empty table gives no rows. Columns other than doc_id and text are not read."""
    spark = docs.sparkSession
    prepare(spark)
    texts = texts_only(docs)
    scan = materialise(texts.mapInArrow(_scan(n), _SCAN), "jaccard-scan")
    rows = scan.filter("n is not null").select("doc_id", "n", "sig")
    top = scan.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(heavy).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    weight = np.log2(top.column("times").to_numpy()[order]).astype(np.int8)
    entries = materialise(texts.mapInArrow(_entries(n, num, den, tokens[order], weight), "token long, sig binary, n int"), "jaccard-entries")
    shared = entries.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1").select("token")
    cells = materialise(entries.join(shared, "token").distinct(), "jaccard-cells")
    discard(entries)
    release(spark)
    cells = _pruned(cells, num, den)
    release(spark)
    times = cells.groupBy("token").agg(F.count("*").alias("times"))
    central = cells.join(times, "token").groupBy("sig").agg(F.sum("times").alias("weight"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("int")
    banded = cells.join(central, "sig").select("token", "sig", "weight", F.explode(F.array(band, band + 1)).alias("band"))
    pivots = banded.groupBy("token", "band").agg(F.max(F.struct("weight", "sig")).getField("sig").alias("pivot"), F.min("sig").alias("least"), F.max("sig").alias("most")).filter("least < most").select("token", "band", "pivot")
    family = F.concat("pivot", F.encode(F.col("band").cast("string"), "UTF-8")).alias("family")
    families = materialise(banded.join(pivots, ["token", "band"]).select(family, "sig").distinct(), "jaccard-families")
    discard(cells)
    active = families.select("sig").distinct()
    chosen = rows.filter("doc_id is not null").join(active, "sig").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    grams = materialise(texts.join(chosen, "doc_id").select("sig", "text").mapInArrow(_checked_sets(n), "sig binary, grams binary"), "jaccard-sets")
    tables = [families, grams]
    if rows.filter("doc_id is null and sig is not null").head(1):  # sets that only rows without an id have are found by the set itself
        alone = texts.filter("doc_id is null").select("text").mapInArrow(_all_sets(n), "sig binary, grams binary")
        missing = active.join(grams.select("sig"), "sig", "left_anti")
        tables.append(materialise(alone.join(missing, "sig").groupBy("sig").agg(F.first("grams").alias("grams")), "jaccard-sets"))
        grams = grams.unionByName(tables[-1])
    release(spark)
    members, found, more = _regions(families.join(grams, "sig").select("family", "sig", "grams"), num, den, most, fan, levels)
    links = members.repartition(spread(docs), "family").sortWithinPartitions("family").mapInArrow(_solve(num, den), "u binary, v binary")
    for f in found:
        links = links.unionByName(f)
    reached = components(links)
    discard(*tables, *more)
    release(spark)
    named = rows.join(reached, rows["sig"] == reached["node"], "left").select("doc_id", "n", "sig", F.coalesce("component", "sig").alias("component"))
    least = named.filter("sig is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.hex("sig").alias("set_sha"))


def _all_sets(n: int):
    """The sets of texts by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g for g in shingles(*text_buffer(batch.column("text")), n) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([_sig(g) for g in found], pa.binary()), pa.array([g.tobytes() for g in found], pa.binary())], ["sig", "grams"])

    return run


def _checked_sets(n: int):
    """Sets of the texts that have the signature asked for; a doc_id that stands for several texts brings others too, which are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, g) for s, g in zip(batch.column("sig").to_pylist(), shingles(*text_buffer(batch.column("text")), n), strict=True) if len(g) and _sig(g) == s]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.binary()), pa.array([g.tobytes() for _, g in found], pa.binary())], ["sig", "grams"])

    return run
