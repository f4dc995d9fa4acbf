"""Tokens, postings and phrase counts of whole blocks of texts, as numpy and Arrow arrays in Python workers.

The tokens are those of columns.tokens(): lower-case runs of letters and digits. A block's texts are laid end to end, so that
no work is done token by token.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of one block, longer texts stand alone; texts that are laid end to end at once.
BLOCK, PIECE = 24 << 20, 4 << 20


@cache
def _word_table() -> np.ndarray:
    """Whether a code point is a letter or a number."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def split_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts in order, the number of tokens of each text)."""
    word, values, counts = _word_table(), [], []
    for start, end in _pieces(texts):
        low = [t.lower() for t in texts[start:end]]
        points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
        held = word[points]
        first = held.copy()
        first[1:] &= ~held[:-1]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
        counts.append(np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0))
        kept, opens = points[held], first[held]
        width = 1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
        at = np.cumsum(width) - width
        data = kept.tobytes().decode("utf-32-le").encode()
        offsets = np.append(at[opens], len(data)).astype(np.int32)
        values.append(pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)))
    return pa.concat_arrays(values or [pa.array([], pa.string())]), np.concatenate(counts or [np.zeros(0, np.int64)])


class Block:
    """Rows (id, one column of text a field) with their tokens: rank (the place of its term among the sorted terms), row, field and pos of each token, size of each row."""

    def __init__(self, rows: pa.Table) -> None:
        fields = rows.num_columns - 1
        self.ids = rows.column(0).combine_chunks()
        columns = [rows.column(1 + f).to_pylist() for f in range(fields)]
        values, counts = split_tokens([t or "" for row in zip(*columns, strict=True) for t in row])
        coded = values.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.terms = coded.dictionary.take(order)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        self.rank = place[coded.indices.to_numpy()] if len(values) else np.zeros(0, np.int32)
        text = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        self.row, self.field = (text // fields).astype(np.int32), (text % fields).astype(np.int8)
        self.pos = (np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        self.sizes = counts.reshape(-1, fields).sum(axis=1).astype(np.int32)
        self.order = np.argsort(self.rank, kind="stable")
        self.starts = np.searchsorted(self.rank[self.order], np.arange(len(self.terms) + 1))

    def places(self, key: str, prefix: bool) -> np.ndarray:
        """Where in the block the tokens are that equal the key or begin with it."""
        low, high = self._place(key), self._place(key + "\U0010ffff") if prefix else None
        if high is None:
            high = low + (low < len(self.terms) and self.terms[low].as_py() == key)
        return self.order[self.starts[low] : self.starts[high]]

    def _place(self, key: str) -> int:
        low, high, wanted = 0, len(self.terms), key.encode()
        while low < high:
            middle = (low + high) // 2
            if self.terms[middle].as_py().encode() < wanted:
                low = middle + 1
            else:
                high = middle
        return low

    def phrase(self, tokens: tuple[str, ...], prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, how often each has the tokens next to each other in one field)."""
        last = len(tokens) - 1
        found = None
        for i, token in enumerate(tokens):
            at = self.places(token, prefix and i == last) - i
            found = at if found is None else np.intersect1d(found, at, assume_unique=True)
            if not len(found):
                break
        if last and len(found):
            found = found[(found >= 0) & (found + last < len(self.row))]
            found = found[(self.row[found] == self.row[found + last]) & (self.field[found] == self.field[found + last])]
        return np.unique(self.row[found], return_counts=True)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the rows of Arrow batches; whole rows, so that all of a row's tokens are in one block."""
    waiting, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, batch.num_columns))
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > BLOCK:
                if i > start:
                    waiting.append(batch.slice(start, i - start))
                yield Block(pa.Table.from_batches(waiting))
                waiting, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            waiting.append(batch.slice(start))
    if waiting:
        yield Block(pa.Table.from_batches(waiting))


POSTINGS = "term string, ids array<{id}>, fields array<tinyint>, places array<int>, sizes array<int>, lengths array<int>"


def postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTINGS of each block, by term: a row for each term with the id, field, position and row size of each of its tokens, and one of a null term whose lengths are the sizes of all rows."""
    for b in blocks(batches):
        row = b.row[b.order]
        step = np.arange(0, len(b.terms), 65_536)
        yield pa.record_batch([pa.nulls(1, pa.string()), *(_empty(kind, 1) for kind in (b.ids.type, pa.int8(), pa.int32(), pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(b.sizes)], pa.int32()), pa.array(b.sizes))], _NAMES)
        for low in step.tolist():
            high = min(low + 65_536, len(b.terms))
            start, end = b.starts[low], b.starts[high]
            offsets = pa.array((b.starts[low : high + 1] - start).astype(np.int32))
            at = b.order[start:end]
            columns = (b.ids.take(pa.array(row[start:end])), pa.array(b.field[at]), pa.array(b.pos[at]), pa.array(b.sizes[row[start:end]]))
            yield pa.record_batch([b.terms.slice(low, high - low), *(pa.ListArray.from_arrays(offsets, c) for c in columns), _empty(pa.int32(), high - low)], _NAMES)


_NAMES = ["term", "ids", "fields", "places", "sizes", "lengths"]


def _empty(kind: pa.DataType, n: int) -> pa.Array:
    """n empty lists."""
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind))


FREQUENCIES = "query_id string, phrase int, id {id}, f long, dl long, phrases int, every boolean"


def frequencies_of(matches: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FREQUENCIES of the phrases (query_id, phrase, tokens, prefix, phrases, every) in each block, and for each block a row of null query_id with its number of rows as f and their sizes as dl."""
    for b in blocks(batches):
        yield _frequency(None, None, pa.nulls(1, b.ids.type), np.array([len(b.ids)]), np.array([b.sizes.sum(dtype=np.int64)]), None, None)
        for query_id, phrase, tokens, prefix, phrases, every in matches:
            rows, f = b.phrase(tokens, prefix)
            if len(rows):
                yield _frequency(query_id, phrase, b.ids.take(pa.array(rows)), f, b.sizes[rows].astype(np.int64), phrases, every)


def _frequency(query_id, phrase, ids, f, dl, phrases, every) -> pa.RecordBatch:
    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(ids))
    return pa.record_batch([same(query_id, pa.string()), same(phrase, pa.int32()), ids, pa.array(f.astype(np.int64)), pa.array(dl), same(phrases, pa.int32()), same(every, pa.bool_())], ["query_id", "phrase", "id", "f", "dl", "phrases", "every"])


SUMMARY = "term string, chunks long, places long, spread long, longest long"


def summary_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMMARY of each row of POSTINGS: the ids and tokens of the term, the sum of position times field + 1, and the size of the longest row."""
    for batch in batches:
        columns = [batch.column(i) for i in range(1, 5)]
        ids, fields, places, sizes = (c.flatten() for c in columns)
        counts = pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(ids):
            continue
        starts, code = np.cumsum(counts) - counts, ids.dictionary_encode().indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        pairs = np.unique(owner * (len(code) + 1) + code)
        chunks = np.bincount(pairs // (len(code) + 1), minlength=len(counts))
        spread = np.add.reduceat(places.to_numpy().astype(np.int64) * (fields.to_numpy().astype(np.int64) + 1), starts)
        longest = np.maximum.reduceat(sizes.to_numpy().astype(np.int64), starts)
        yield pa.record_batch([batch.column(0), pa.array(chunks.astype(np.int64)), pa.array(counts), pa.array(spread), pa.array(longest)], ["term", "chunks", "places", "spread", "longest"])
