"""Packing of token pieces into sequences by the configuration linear program.

The program has a variable for each pattern (a multiset of lengths that fit one sequence) and
a row for each length: cover all pieces of the length with the fewest sequences. Its dual
prices come from multiplicative weights: each round prices the lengths by how far they are
from covered and finds the most valuable patterns by knapsack dynamic programming; the best
prices seen give a lower bound on the number of sequences. Up to FEW lengths the simplex method
finds the optimal prices and amounts instead.

Rounding takes whole numbers only. Where the simplex method gave amounts, their whole parts are
taken first. The rest is priced again and again: by the dual prices, times multiplicative weights
of what is still uncovered, over no more pieces than are left. The pattern of the largest length
left is taken as often as its pieces last, since what can fill the room beside it only gets
scarcer. This goes on to the last piece, so that every sequence is a pattern that the knapsack
priced. The best of two roundings, by the prices found and by the lengths, is kept.

The driver sees only the histogram, `capacity` numbers at most, and patterns with multiples, a
number that doesn't grow with the corpus. Pieces find their places alone: a piece's rank among
those of its length comes from counts by scan task and length, and its sequence and offset
from its rank by arithmetic over the patterns. No group of pieces meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise, prepare, text_buffer, texts_only
from quarrylight.llm.tokens import Encoder

Pattern = list[tuple[int, int]]

#: Lengths up to which the program is solved to its optimum as well.
FEW = 64


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to capacity the value of the best multiset of lengths (ascending) that fits, each as often as one likes, and the place of a length in it (-1: one less room is as good)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            gain = best[c - lengths[:n]] + values[:n]
            if gain[i := int(gain.argmax())] > best[c]:
                best[c], took[c] = gain[i], i
    return best, took


def _unfold(took: np.ndarray, lengths: np.ndarray, room: int, first: int) -> dict[int, int]:
    """The multiset of places: first, and the best for the room."""
    pattern = {first: 1}
    while room > 0:
        i = int(took[room])
        if i < 0:
            room -= 1
        else:
            pattern[i] = pattern.get(i, 0) + 1
            room -= int(lengths[i])
    return pattern


def dual(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 300, eta: float = 8.0, step: float = 0.02, slack: float = 0.01, columns: int = 48, check: int = 15) -> tuple[np.ndarray, float]:
    """The best dual prices that multiplicative weights come to, and the lower bound on the number of sequences that they give.

    Prices start equal and fall by the exponential of what is covered. Each round finds patterns by one dynamic program, the best for
    each length that comes within `slack` of the optimum, and covers some of the least covered lengths by them. Every `check` rounds
    the mean of all prices so far, later ones counting more, is tried as well; the lengths themselves are prices too."""
    found, bound = lengths.astype(float), float((lengths * counts).sum()) / capacity
    covered, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    for k in range(1, rounds + 1):
        prices = np.exp(-eta * (covered - covered.min()))
        prices /= (prices * counts).sum()
        total += k * prices
        best, took = knapsack(prices, lengths, capacity)
        tried = [(prices, best[capacity])]
        if k % check == 0:
            mean = total / (total * counts).sum()
            tried.append((mean, knapsack(mean, lengths, capacity)[0][capacity]))
        for p, most in tried:
            if 1 / most > bound:
                found, bound = p / most, 1 / most
        worth = prices + best[capacity - lengths]
        good = np.flatnonzero(worth >= (1 - slack) * best[capacity])
        for first in good[np.argsort(covered[good], kind="stable")][:columns].tolist():
            if covered[first] > covered.min() + 4 * step:
                break
            pattern = _unfold(took, lengths, capacity - int(lengths[first]), first)
            places, often = np.array(list(pattern)), np.array(list(pattern.values()))
            covered[places] += float((step * counts[places] / often).min()) * often / counts[places]
    return found, bound


def exact(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[float, Pattern]], np.ndarray, float]:
    """(amount, pattern of places in lengths), dual prices and bound at the optimum, by the simplex method with columns from the knapsack; its basis is a square of the number of lengths, so for few lengths."""
    per = capacity // lengths
    basis, amounts = np.diag(per).astype(float), counts / per
    bound = float((lengths * counts).sum()) / capacity
    for _ in range(100 + 20 * len(lengths)):
        prices = np.maximum(np.linalg.solve(basis.T, np.ones(len(lengths))), 0)
        best, took = knapsack(prices, lengths, capacity)
        bound = max(bound, float((prices * counts).sum()) / best[capacity])
        if best[capacity] <= 1 + 1e-9:
            break
        room = int(np.flatnonzero(took >= 0)[-1])
        first = int(took[room])
        column = np.zeros(len(lengths))
        for i, n in _unfold(took, lengths, room - int(lengths[first]), first).items():
            column[i] = n
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        amounts = np.maximum(amounts - amount * change, 0)
        amounts[out], basis[:, out] = amount, column
    return [(float(a), [(int(i), int(column[i])) for i in np.flatnonzero(column)]) for a, column in zip(amounts, basis.T, strict=True)], prices, bound


def _bounded(values: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Knapsack over no more pieces than are left: for each run of pieces of one length (place, number, size) the rooms in which it improves the best value."""
    best, runs, improves = np.zeros(capacity + 1), [], []
    for i, (size, value, n) in enumerate(zip(lengths.tolist(), values.tolist(), np.minimum(left, capacity // lengths).tolist(), strict=True)):
        run = 1
        while n > 0:
            run = min(run, n)
            wide = size * run
            with_run = best[:-wide] + value * run
            better = np.zeros(capacity + 1, np.bool_)
            better[wide:] = with_run > best[wide:]
            best = np.append(best[:wide], np.maximum(best[wide:], with_run))
            runs.append((i, run, wide))
            improves.append(better)
            n, run = n - run, 2 * run
    return np.array(improves).reshape(len(runs), capacity + 1), runs


def _bounded_pattern(improves: np.ndarray, runs: list[tuple[int, int, int]], room: int, first: int) -> dict[int, int]:
    pattern, last = {first: 1}, len(runs)
    while len(better := np.flatnonzero(improves[:last, room])):
        last = int(better[-1])
        i, n, wide = runs[last]
        pattern[i] = pattern.get(i, 0) + n
        room -= wide
    return pattern


def whole(prices: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int, few: float = 0.1, even: float = 0.005, eta: float = 1.0) -> list[tuple[int, Pattern]]:
    """Whole numbers of priced patterns that use up the counts.

    Each dynamic program serves the largest lengths that are left, one for each FEW that there are. few: how much more a token of a whole sequence's length is worth than
    one of a short piece, so that of patterns alike in price the one of fewer pieces is taken; even: the share of multiplicative weights, by
    which lengths that lag behind come first."""
    left, out = counts.copy(), []
    while left.any():
        live = np.flatnonzero(left)
        sizes = lengths[live]
        weight = np.exp(-eta * (1 - left[live] / counts[live]))
        values = prices[live] * (1 + few * sizes / capacity + even * weight)
        improves, runs = _bounded(values, sizes, left[live], capacity)
        each = max(1, len(live) // FEW)
        for taken, first in enumerate(range(len(live) - 1, max(-1, len(live) - 1 - each), -1)):
            if not left[live[first]]:
                continue
            pattern = _bounded_pattern(improves, runs, capacity - int(sizes[first]), first)
            if any(left[live[i]] < n for i, n in pattern.items()):
                if taken:
                    break
                others = left[live] - (np.arange(len(live)) == first)
                pattern = _bounded_pattern(*_bounded(values, sizes, others, capacity), capacity - int(sizes[first]), first)
            places, often = live[list(pattern)], np.array(list(pattern.values()))
            times = int((left[places] // often).min())
            left[places] -= times * often
            out.append((times, [(int(lengths[i]), int(n)) for i, n in sorted(zip(places.tolist(), often.tolist(), strict=True), reverse=True)]))
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], float]:
    """(how often, [(length, number in the sequence)]) patterns that place every piece exactly once, and a lower bound on the number of sequences."""
    left = {n: c for n, c in sorted(histogram.items()) if c}
    out: list[tuple[int, Pattern]] = []
    full = left.pop(capacity, 0)
    if full:
        out.append((full, [(capacity, 1)]))
    if not left:
        return out, float(full)
    lengths, counts = np.array(list(left), np.int64), np.array(list(left.values()), np.int64)
    prices, bound = dual(lengths, counts, capacity)
    rounded = [whole(p, lengths, counts, capacity) for p in ([prices] if (prices == lengths).all() else [prices, lengths.astype(float)])]
    if len(lengths) <= FEW:
        amounts, prices, best = exact(lengths, counts, capacity)
        bound = max(bound, best)
        parts = [(int(a + 1e-9), [(int(lengths[i]), n) for i, n in pattern]) for a, pattern in amounts if a + 1e-9 >= 1]
        rest = counts - sum(times * np.bincount(np.searchsorted(lengths, [s for s, _ in items]), [n for _, n in items], len(lengths)).astype(np.int64) for times, items in parts)
        more = rest > 0
        rounded.append(parts + whole(prices[more], lengths[more], rest[more], capacity))
    return out + min(rounded, key=lambda r: sum(times for times, _ in r)), full + bound


def _places(patterns: list[tuple[int, Pattern]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, number in a sequence and offset of each run of patterns that hold it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, items in patterns:
        offset = 0
        for size, n in items:
            runs.setdefault(size, []).append((ranks.get(size, 0), sequence, n, offset))
            ranks[size] = ranks.get(size, 0) + times * n
            offset += size * n
        assert offset <= capacity
        sequence += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for size, r in runs.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _cut(encoder: Callable[[], Encoder], end_id: int, capacity: int):
    """Scan side: the pieces of each text, the first shorter where the ids don't divide, and each one's rank among those of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            flat, first = encode.ids(*text_buffer(batch.column("text")))
            n = np.diff(first) + 1
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * capacity
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            raw, end = flat.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
            a = (first[row] + start) * 4
            b = a + 4 * length
            last = piece == pieces[row] - 1
            crcs = [zlib.crc32(raw[i : j - 4] + end if z else raw[i:j]) for i, j, z in zip(a.tolist(), b.tolist(), last.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            place = np.empty(len(row), np.int64)
            ordered = length[order]
            place[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(place)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return run


def pack(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    A null or empty text is a piece of its end id alone. Each row is a document of its own: rows that repeat, or share a doc_id
    or have none, are all packed and keep their doc_id. An empty table gives no rows. Columns other than doc_id and text are not read."""
    prepare(docs.sparkSession)
    pieces = materialise(texts_only(docs).mapInArrow(_cut(encoder, end_id, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, capacity)[0], capacity)
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for length in np.unique(size).tolist():
                mine = size == length
                first, start, often, at = places[length]
                run = np.searchsorted(first, rank[mine], "right") - 1
                over = rank[mine] - first[run]
                sequence[mine] = start[run] + over // often[run]
                offset[mine] = at[run] + over % often[run] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(put, _PACKED)
