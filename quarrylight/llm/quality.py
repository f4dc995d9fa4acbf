"""Quality by regularised quadratic discriminants over statistics of the whole text.

Each text gives FEATURES transformed statistics. The classes' moments (count, sum, sum of
products: some hundred numbers a class) are added up over all labelled rows of the learning
part, on the executors. Covariances are shrunk towards their mean and its diagonal, their
Cholesky factors are computed once, and a score is the logistic of the difference of the
classes' log densities with their priors: Mahalanobis distances by triangular factors and log
determinants. Neither labels nor lang, source or doc_id enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import LOWER, blocks, materialise, prepare, span_hashes, text_buffer, words_of

FEATURES = ("words", "word_length", "upper", "shouted", "odd_ends", "bars", "stutter", "distinct", "same_lines", "digits", "symbols", "foreign", "line_words", "pairs", "unended", "capitals")
_UPPER, _LETTER, _DIGIT, _MARK, _HIGH, _STOP = 1, 2, 4, 8, 16, 32


def _kind(c: int) -> int:
    if c >= 128:
        return _HIGH | _LETTER
    x = chr(c)
    if x.isalpha():
        return _LETTER | (_UPPER if x.isupper() else 0)
    if x.isdigit():
        return _DIGIT
    return _MARK | (_STOP if x in ".,;:?'\")" else 0) if 32 < c < 127 else 0


_KINDS = bytes(map(_kind, range(256)))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct values of each group; groups ascend."""
    if not len(group):
        return np.zeros(groups)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(g[new], minlength=groups)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log of a share, smoothed so that a short text without the thing is no outlier."""
    return np.log((part + 0.3) / (whole + 30))


def _block(data: bytes, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kind = np.frombuffer(data.translate(_KINDS), np.uint8)
    kind = kind.copy()
    pair = np.frombuffer(data, np.uint8)
    kind[:-1][(pair[:-1] == 0xC3) & (pair[1:] >= 0x80) & (pair[1:] < 0x9F)] |= _UPPER  # accented Latin capitals
    sums = {bit: _sums((kind & bit) != 0) for bit in (_UPPER, _LETTER, _DIGIT, _MARK, _HIGH)}
    per = lambda s, at=offsets: s[at[1:]] - s[at[:-1]]
    starts, ends, first = words_of(data, offsets)
    hashes = span_hashes(np.frombuffer(data.translate(LOWER), np.uint8), starts, ends)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    letters = sums[_LETTER][ends] - sums[_LETTER][starts]
    capital = sums[_UPPER][ends] - sums[_UPPER][starts]
    shouted = (letters > 1) & (capital * 2 > letters)
    last = kind[ends - 1] if len(ends) else kind[:0]
    odd = (letters > 0) & ((last & (_MARK | _STOP)) == _MARK)
    bar = (ends - starts == 1) & (letters == 0)
    again = np.zeros(len(hashes), np.bool_)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    add = lambda x: np.bincount(text, x, minlength=n) if len(text) else np.zeros(n)
    pair = np.zeros(len(hashes), np.uint64)
    pair[1:] = hashes[1:] * np.uint64(3) + hashes[:-1]
    pair[first[:-1][words > 0]] = 0  # a text's first word has none before it
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    edges = np.unique(np.concatenate([offsets, breaks + 1]))
    line_from, line_to = edges[:-1], edges[1:]
    line_text = np.searchsorted(offsets, line_from, "right") - 1
    solid = line_to - line_from > 1
    line_text, line_hash = line_text[solid], span_hashes(np.frombuffer(data, np.uint8), line_from[solid], line_to[solid])
    lines = np.bincount(line_text, minlength=n)
    stops = add((last & _STOP) != 0)
    size = np.diff(offsets)
    return np.column_stack([
        np.log1p(words),
        np.log1p(per(sums[_LETTER]) / np.maximum(words, 1)),
        _share(per(sums[_UPPER]), per(sums[_LETTER])),
        _share(add(shouted), words),
        _share(add(odd), words),
        _share(add(bar), words),
        _share(add(again), words),
        _share(words - _distinct(text, hashes, n), words),
        _share(lines - _distinct(line_text, line_hash, n), lines),
        _share(per(sums[_DIGIT]), size),
        _share(per(sums[_MARK]), size),
        per(sums[_HIGH]) / np.maximum(size, 1),
        np.log1p(words / np.maximum(lines, 1)),
        _share(words - _distinct(text, pair, n), words),
        _share(stops, words),
        _share(add(capital > 0), words),
    ])


def features(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; finite for empty ones too."""
    parts = [_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, products: np.ndarray, to_mean: float = 0.4, to_diagonal: float = 0.1, least: float = 0.02) -> Discriminant:
        """count [2], total [2, d], products [2, d, d]. A class without rows has the other's moments and a prior of half a row."""
        d = total.shape[1]
        if not count.sum():
            return cls(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
        pooled_mean = total.sum(0) / count.sum()
        mean = np.array([t / c if c else pooled_mean for t, c in zip(total, count)])
        own = [p / c - np.outer(m, m) if c > 1 else None for p, c, m in zip(products, count, mean)]
        pooled = sum(c * s for c, s in zip(count, own) if s is not None) / max(1.0, sum(c for c, s in zip(count, own) if s is not None)) + np.zeros((d, d))
        factor, constant = [], []
        for s, c in zip(own, count):
            s = (1 - to_mean) * (pooled if s is None else s) + to_mean * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + least * np.eye(d)
            low = np.linalg.cholesky((s + s.T) / 2)
            factor.append(np.linalg.inv(low))
            constant.append(np.log((c + 0.5) / (count.sum() + 1)) - np.log(np.diag(low)).sum())
        return cls(mean, np.stack(factor), np.array(constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, strictly within 0 and 1."""
        density = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


_MOMENTS = "quality int, n double, total array<double>, products array<double>"


def learn(table: DataFrame, labels: DataFrame, fold: int = 3, left_out: int = 1) -> Discriminant:
    """Fit on the rows of table (doc_id, x) that have one label and whose crc32(doc_id as text) mod fold isn't left_out. All of them are used."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    rows = table.filter(F.crc32(F.col("doc_id").cast("string")) % fold != left_out).join(known, "doc_id")
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, d)
            y = batch.column("quality").to_numpy()
            for k in (0, 1):
                mine = x[y == k]
                n[k] += len(mine)
                total[k] += mine.sum(0)
                products[k] += mine.T @ mine
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(products.reshape(2, -1).tolist(), pa.list_(pa.float64()))], ["quality", "n", "total", "products"])

    each = rows.select("quality", "x").mapInArrow(add, _MOMENTS)
    added = lambda c, size: F.array(*(F.sum(F.col(c)[i]) for i in range(size))).alias(c)
    n, total, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in each.groupBy("quality").agg(F.sum("n").alias("n"), added("total", d), added("products", d * d)).collect():
        n[r["quality"]], total[r["quality"]], products[r["quality"]] = r["n"], r["total"], np.reshape(r["products"], (d, d))
    return Discriminant.fit(n, total, products)


def feature_table(docs: DataFrame, *columns: str) -> DataFrame:
    """columns and x, the features of text."""
    from pyspark.sql import types as T

    kept = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = T.StructType([*(f for f in kept.schema if f.name in columns), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*text_buffer(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema[:-1]), lists], [f.name for f in schema])

    return kept.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 3, left_out: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted of each row; null and empty texts are scored by their statistics too.

    A doc_id with both labels teaches nothing; a null doc_id is not held out. Rows that repeat are scored each, and teach each.
    Without labels all scores are 0.5. An empty table gives no rows. Other columns of docs and labels are not read."""
    prepare(docs.sparkSession)
    table = materialise(feature_table(docs, "doc_id"), "quality-features")
    model = learn(table, labels.select("doc_id", "quality"), fold, left_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == left_out, F.lit(False))
    return table.withColumn("held_out", held_out).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, fold: int = 3, left_out: int = 1) -> DataFrame:
    """The documents that aren't predicted 0, all columns of documents kept. Statistics are computed once and kept without the text; rows are told apart by doc_id and a hash of the text.

    Null and empty texts are judged by their statistics; rows that repeat, or have no doc_id, each for itself. Without labels, or with those of one class only, the model
    is as good as the prior: all rows stay, or all are of that class. The labels' other columns are not read."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("hash", F.xxhash64("text"))
    table = materialise(feature_table(rows, "doc_id", "hash"), "quality-features")
    model = learn(table.select("doc_id", "x"), labels.select("doc_id", "quality"), fold, left_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.asarray(batch.column("x").flatten(), np.float64).reshape(-1, len(FEATURES)))
            yield batch.select(["doc_id", "hash"]).filter(pa.array(score < 0.5))

    bad = table.mapInArrow(run, table.drop("x").schema).select(F.col("doc_id").alias("bad_id"), F.col("hash").alias("bad_hash"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti").drop("hash")
