"""Language proportions of each document by expectation-maximisation over its words.

The model of a language is the counts of byte trigrams of the learning documents, where all but
letters are spaces: log p(c | a b) by additive smoothing, over the bytes of words and the space after
each. It has 2**16 hashed trigrams and
2**16 contexts for each language, whatever the corpus, added up on the executors.

A document is a mixture: each word comes from one language. EM finds the proportions. Then the
rarest language is taken out as long as the log likelihood falls by less than the penalty (half
the log of the number of words, as in BIC); the most frequent one of the set that is left is
the prediction, and the score is its proportion among all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import blocks, prepare, text_buffer, texts_only

BUCKETS = 1 << 16
UNKNOWN = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _places(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram and context of each place in a word and just after it, whether it's a word's first, and its byte."""
    low = np.frombuffer(data.translate(_FOLD), np.uint8).copy()
    low[1:][(low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] < 0x9F)] += 32  # accented Latin capitals
    n = len(low)
    one = np.full(n + 1, 32, np.uint32)
    one[1:] = low
    two = np.full(n + 2, 32, np.uint32)
    two[2:] = low
    edge = offsets[(offsets > 0) & (offsets < n)]
    one, two = one[:n], two[:n]
    one[edge] = 32
    two[edge] = 32
    two[np.minimum(edge + 1, n - 1)[edge + 1 < n]] = 32
    here = low.astype(np.uint32)
    places = np.flatnonzero((here != 32) | (one != 32))
    one, two, here = one[places], two[places], here[places]
    context = two << 8 | one
    trigram = (context << 8 | here) * np.uint32(2654435761) >> np.uint32(16)
    return trigram, context, one == 32, places


_COUNTS = "lang string, kind int, bucket int, n long"


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, kind 0 trigram or 1 context, bucket, n), one row for each task, language and bucket seen, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, j in blocks(offsets):
                part, begin = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not part:
                    continue
                trigram, context, _, places = _places(part, begin)
                text = np.searchsorted(begin, places, "right") - 1
                for lang in set(langs[i:j]):
                    mine = (langs[i:j] == lang)[text]
                    have = seen.setdefault(lang, np.zeros((2, BUCKETS), np.int64))
                    have[0] += np.bincount(trigram[mine], minlength=BUCKETS)
                    have[1] += np.bincount(context[mine], minlength=BUCKETS)
        for lang, have in seen.items():
            for kind in (0, 1):
                found = np.flatnonzero(have[kind])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), kind, np.int32)), pa.array(found.astype(np.int32)), pa.array(have[kind][found])], ["lang", "kind", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, _COUNTS).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Languages, and the tables whose difference is a trigram's log probability in each."""

    def __init__(self, counts: pa.Table, smooth: float = 0.2, fan: int = 64) -> None:
        lang, kind, bucket, n = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "kind", "bucket", "n"))
        self.languages = sorted(set(lang))
        table = np.zeros((2, BUCKETS, max(1, len(self.languages))))
        for k, name in enumerate(self.languages):
            mine = lang == name
            table[kind[mine], bucket[mine], k] = n[mine]
        self.up = np.log(table[0] + smooth).astype(np.float32)
        self.down = np.log(table[1] + smooth * fan).astype(np.float32)

    def words(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word in each language, and the word's text."""
        trigram, context, first, places = _places(data, offsets)
        if not len(places):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)
        starts = np.flatnonzero(first)
        return np.add.reduceat(self.up[trigram] - self.down[context], starts, axis=0), np.searchsorted(offsets, places[starts], "right") - 1

    def mix(self, data: bytes, offsets: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, proportions within the selected set; 0 outside it) of each text."""
        n, langs = len(offsets) - 1, len(self.languages)
        logs, text = self.words(data, offsets) if data else (np.zeros((0, langs), np.float32), np.zeros(0, np.int64))
        count = np.bincount(text, minlength=n)
        top = logs.max(1, initial=-np.inf, keepdims=True) if len(logs) else logs[:, :1]
        like = np.exp(logs - top)
        full = count > 0
        begin = np.cumsum(count)[full] - count[full]

        def per_text(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, *x.shape[1:]))
            if len(x):
                out[full] = np.add.reduceat(x, begin, axis=0)
            return out

        def em(part: np.ndarray, times: int) -> np.ndarray:
            for _ in range(times):
                share = like * part[text]
                share /= share.sum(1, keepdims=True) + 1e-30
                part = per_text(share) / np.maximum(count, 1)[:, None]
            return part

        def fit(part: np.ndarray) -> np.ndarray:
            return per_text(np.log((like * part[text]).sum(1) + 1e-30))

        everything = em(np.full((n, langs), 1 / max(langs, 1)), rounds)
        chosen = everything.copy()
        penalty = 0.5 * np.log(np.maximum(count, 2))
        open_ = full.copy()
        for _ in range(langs - 1):
            several = open_ & ((chosen > 0).sum(1) > 1)
            if not several.any():
                break
            rarest = np.where(chosen > 0, chosen, np.inf).argmin(1)
            without = chosen.copy()
            without[several, rarest[several]] = 0
            total = without.sum(1, keepdims=True)
            without = np.where(total > 0, without / np.maximum(total, 1e-30), chosen)
            without = em(without, 4)
            accept = several & (fit(without) >= fit(chosen) - penalty)
            chosen[accept] = without[accept]
            open_ &= accept
        return everything, chosen

    def predict(self, data: bytes, offsets: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]]]:
        """Language, score and selected set of each text."""
        names, scores, sets = [], np.zeros(len(offsets) - 1), []
        if not self.languages:
            return [UNKNOWN] * len(scores), scores, [[]] * len(scores)
        most = max(1 << 14, (1 << 22) // max(1, len(self.languages)))
        for i, j in blocks(offsets, most):
            part, begin = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            everything, chosen = self.mix(part, begin)
            best = chosen.argmax(1)
            for k in range(j - i):
                text = part[begin[k] : begin[k + 1]]
                if not has_letter(text):
                    names.append(UNKNOWN)
                    sets.append([])
                    continue
                names.append(self.languages[best[k]])
                scores[i + k] = min(1.0, everything[k, best[k]]) if chosen[k].any() else 1 / len(self.languages)
                sets.append([self.languages[x] for x in np.flatnonzero(chosen[k])])
        return names, scores, sets


_ASCII_LETTER = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes) -> bool:
    return len(text) > len(text.translate(None, _ASCII_LETTER)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def language_ids(docs: DataFrame, fold: int = 4, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the selected set) of each row.

    Learns from text and lang of the rows whose lang isn't null and whose crc32(doc_id as text) mod fold isn't left_out; all of them are used.
    A text that is null or has no letter is `und` with score 0, as are all texts if there is nothing to learn from. A null doc_id is not held out, and teaches nothing.
    Rows that repeat are predicted each, and teach each. An empty table gives no rows. Columns other than doc_id, text and lang are not read.
    2**17 counts for each distinct lang come to the driver."""
    prepare(docs.sparkSession)
    part = F.crc32(F.col("doc_id").cast("string")) % fold
    model = Mixture(count_trigrams(docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (part != left_out))).toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sets = model.predict(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores), pa.array(sets, pa.list_(pa.string()))], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    table = texts_only(docs).withColumn("held_out", F.coalesce(part == left_out, F.lit(False)))
    return table.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")
