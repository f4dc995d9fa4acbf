"""Encoding of whole texts with public tokenizers, by way of their distinct chunks.

A splitter cuts a batch of texts at byte positions that no token of the tokenizer can span;
the ids of a text are then the ids of its chunks end to end. Arrow's dictionary encoding finds
the distinct chunks, the tokenizer sees each of them once, and a cache that lives as long as
the Python worker keeps them for later batches. The cache is emptied when it's full, so memory
is bounded whatever the corpus. Texts in which a special token's string may stand aren't cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

from quarrylight.llm.common import LOWER, quiet_threads

#: Bits of a byte's class.
_SPACE, _WHITE, _ALNUM, _PUNCT, _LEAD = 1, 2, 4, 8, 16


def _class(c: int) -> int:
    if c in b"\t\n\x0b\x0c\r ":
        return _WHITE | (c == 32) * _SPACE
    if c < 128 and chr(c).isalnum():
        return _ALNUM
    return _PUNCT if 32 < c < 127 else _LEAD if c in (0xC2, 0xE1, 0xE2, 0xE3) else 0


_CLASSES = bytes(map(_class, range(256)))


def _where(data: bytes) -> np.ndarray:
    return np.frombuffer(data.translate(_CLASSES), np.uint8)


def split_words(data: bytes) -> np.ndarray:
    """Cuts for tokenizers whose tokens hold no white space and never both a letter and punctuation after it: before white space, and between an ASCII letter or digit and ASCII punctuation."""
    kind = _where(data)
    cut = np.zeros(len(kind), np.bool_)
    a, b = kind[:-1], kind[1:]
    cut[1:] = ((b & _WHITE) > (a & _WHITE)) | (((a & _ALNUM) << 1) & (b & _PUNCT)).view(np.bool_)
    return cut


def split_byte_level(data: bytes) -> np.ndarray:
    """Cuts for the byte-level pattern that ties one space to what follows it: before a space that something solid follows, before other white space after something solid, after a lone such, and between an ASCII letter or digit and ASCII punctuation.

    Lead bytes that could begin white space outside ASCII count as not solid."""
    kind = _where(data)
    n = len(kind)
    solid = (kind & (_ALNUM | _PUNCT)) != 0
    cut = np.zeros(n, np.bool_)
    space = (kind & _SPACE) != 0
    other = (kind & (_WHITE | _SPACE)) == _WHITE
    cut[:-1] = space[:-1] & ((kind[1:] & (_WHITE | _LEAD)) == 0)
    cut[1:] |= other[1:] & solid[:-1]
    cut[2:] |= solid[2:] & other[1:-1] & solid[:-2]
    cut[1:] |= (((kind[:-1] & _ALNUM) << 1) & (kind[1:] & _PUNCT)) != 0
    return cut


def _ranges(texts: int, offsets: np.ndarray, data: bytes, mark: bytes) -> list[int]:
    """The texts that hold the mark."""
    found, at = [], data.find(mark)
    while at >= 0:
        i = int(np.searchsorted(offsets, at, "right")) - 1
        found.append(i)
        at = data.find(mark, int(offsets[i + 1]))
    return [i for i in found if i < texts]


class Encoder:
    """Ids of texts by way of a cache of chunks. encode_many gives the ids of each chunk in a list of strings."""

    def __init__(self, split: Callable[[bytes], np.ndarray], encode_many: Callable[[list[str]], list[list[int]]], mark: bytes = b"<|", lower: bool = False, prefix: bytes = b"", words: int = 400_000) -> None:
        self.split, self.encode_many, self.mark, self.lower, self.prefix, self.words = split, encode_many, mark, lower, prefix, words
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.first, self.length, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        ids = self.encode_many(words)
        n, sizes = len(self.slot), np.fromiter(map(len, ids), np.int64, len(ids))
        while len(self.first) < n + len(words):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
        while len(self.pool) < self.used + sizes.sum():
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.first[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(words)] = sizes
        self.pool[self.used : self.used + sizes.sum()] = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
        self.used += int(sizes.sum())
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def chunks(self, data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Slots of the distinct chunks, the distinct chunk of each chunk, and the first chunk of each text (n + 1)."""
        if self.prefix and len(data):
            full = np.flatnonzero(np.diff(offsets))
            parts = np.insert(np.frombuffer(data, np.uint8), offsets[full], self.prefix[0])
            data, offsets = parts.tobytes(), offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        if not data:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        whole = _ranges(len(offsets) - 1, offsets, data, self.mark)
        if self.lower:
            low = data.translate(LOWER)
            if whole:
                low = bytearray(low)
                for i in whole:
                    low[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
                low = bytes(low)
            data = low
        cut = self.split(data)
        for i in whole:
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.searchsorted(starts, offsets)
        array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        words = array.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) + len(words) > self.words:
            self.clear()
        get = self.slot.get
        slots = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if (new := np.flatnonzero(slots < 0)).size:
            n = len(self.slot)
            self._learn([words[i] for i in new.tolist()])
            slots[new] = np.arange(n, n + len(new))
        return slots, array.indices.to_numpy(), bounds

    def counts(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        slots, which, bounds = self.chunks(data, offsets)
        return np.concatenate([[0], np.cumsum(self.length[slots][which], dtype=np.int64)])[bounds]

    def ids(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the first id of each text (n + 1)."""
        slots, which, bounds = self.chunks(data, offsets)
        sizes = self.length[slots][which]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.first[slots][which] - (ends - sizes), sizes)
        shift += np.arange(total)
        return self.pool[shift], np.concatenate([[0], ends])[bounds]


def byte_letters() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_LETTERS = {i: c for i, c in enumerate(byte_letters())}
#: Below this code point the letters' properties are the same in all versions of Unicode that the libraries hold, and are composed.
_SETTLED = "ɐ"


def _plain(word: str) -> bool:
    return word.isalpha() and (word.isascii() or max(word) < _SETTLED)


@cache
def _library(path: str):
    quiet_threads()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _by_library(path: str, words: bool) -> Callable[[list[str]], list[list[int]]]:
    """The tokenizers library: its BPE model directly for a chunk that is one run of plain letters, and all its steps for others."""
    tokenizer = _library(path)
    tokenize = tokenizer.model.tokenize

    def encode(chunks: list[str]) -> list[list[int]]:
        out: list = [None] * len(chunks)
        rest = []
        for i, chunk in enumerate(chunks):
            core = chunk.strip(" \n") if words else chunk[1:] if chunk[:1] == " " else chunk
            if _plain(core) and not (words and core != core.lower()):
                text = core if words else chunk
                out[i] = [t.id for t in tokenize(text if words and text.isascii() else text.encode().decode("latin-1").translate(_LETTERS))]
            else:
                rest.append(i)
        for i, e in zip(rest, tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return encode


@cache
def word_bpe(path: str) -> Encoder:
    return Encoder(split_words, _by_library(path, True), lower=True)


@cache
def byte_bpe(path: str) -> Encoder:
    return Encoder(split_byte_level, _by_library(path, False))


@cache
def piece_bpe(path: str) -> Encoder:
    """sentencepiece without its leading space, which is put before each text instead; cut wherever no piece of the vocabulary holds the two neighbouring bytes."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    assert model.normalizer_spec.name == "identity" and model.normalizer_spec.add_dummy_prefix and not model.normalizer_spec.remove_extra_whitespaces
    inside = np.zeros((256, 256), np.bool_)
    for piece in model.pieces:
        if piece.type in (proto.ModelProto.SentencePiece.NORMAL, proto.ModelProto.SentencePiece.USER_DEFINED):
            text = np.frombuffer(piece.piece.replace("▁", " ").encode(), np.uint8)
            inside[text[:-1], text[1:]] = True
    inside[:, 0x80:0xC0] = True
    apart = ~inside.reshape(-1)
    model.normalizer_spec.add_dummy_prefix = False
    processor = SentencePieceProcessor()
    processor.LoadFromSerializedProto(model.SerializeToString())

    def split(data: bytes) -> np.ndarray:
        at = np.frombuffer(data, np.uint8)
        pair = at[:-1].astype(np.uint16)
        pair <<= 8
        pair |= at[1:]
        cut = np.zeros(len(at), np.bool_)
        np.take(apart, pair, out=cut[1:])
        return cut

    return Encoder(split, lambda chunks: processor.encode(chunks, num_threads=1), mark="▁".encode(), prefix=b" ")
