"""BPE by a segment tree over the ranks of adjacent pairs, and decoding.

The root of the tree holds the lowest rank and, of equal ranks, the leftmost place; a merge
changes three leaves at most and so takes logarithmic time. A word of any length takes
n log n. Words are encoded once for each Python worker while the cache lasts (see tokens.py).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarrylight.llm.common import prepare, text_buffer, texts_only
from quarrylight.llm.tokens import Encoder, byte_letters, split_words

_NONE = 1 << 62
_SHIFT = 32


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to symbols until no pair is left in pairs, which gives (rank, merged symbol) of a pair: each time the lowest rank, and of equal ones the leftmost."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    get, symbols = pairs.get, list(symbols)
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if found := get((symbols[i], symbols[i + 1])):
            tree[size + i] = found[0] << _SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        at = size + place
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    while (best := tree[1]) != _NONE:
        i = best & ((1 << _SHIFT) - 1)
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            found = get((symbols[i], symbols[k]))
            put(i, found[0] << _SHIFT | i if found else _NONE)
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            found = get((symbols[h], symbols[i]))
            put(h, found[0] << _SHIFT | h if found else _NONE)
    return [s for s in symbols if s >= 0]


#: White space of the pattern language that the tokenizer file is written for, and the file's own word pattern.
_BLANK = r"[\t-\r \x85\xa0  -     　]"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK[1:-1]}\p{{L}}\p{{N}}]+")


class WordBpe:
    """Encoding and decoding by a file of a BPE with word ends, lower case and byte letters."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.letters = [self.ids[c] for c in byte_letters()]
        self.last = [self.ids[c + self.end] for c in byte_letters()]
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}

    def word(self, word: bytes) -> list[int]:
        symbols = [self.letters[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        return merge(symbols, self.pairs)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                part = part.lower()
            else:
                part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
            for word in _WORD.findall(part):
                out += self.word(word.encode())
        return out

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.encode, texts))

    def decode(self, ids: list[int]) -> str:
        """Tokens, specials too, with a space between each two: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


@cache
def _bpe(path: str) -> tuple[WordBpe, Encoder, np.ndarray]:
    bpe = WordBpe(path)
    names = np.empty(max(bpe.tokens) + 1, object)
    for i, t in bpe.tokens.items():
        names[i] = t.encode() + b" "
    return bpe, Encoder(split_words, bpe.encode_many, lower=True, words=300_000), names


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text. No rows are moved; a null text is empty (no ids, empty decoded text).

    Each row has its result, also one that repeats or has no doc_id. An empty table gives no rows. Columns other than doc_id and text are not read."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, names = _bpe(path)
        for batch in batches:
            flat, first = encoder.ids(*text_buffer(batch.column("text")))
            raw = flat.astype("<u4").tobytes()
            bounds = first.tolist()
            decoded = names[flat].tolist()
            shas = [(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(b"".join(decoded[a:b])[:-1]).hexdigest()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(first)), pa.array([a for a, _ in shas], pa.string()), pa.array([b for _, b in shas], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_only(docs).mapInArrow(run, _OUT)
