"""Documents that hold the awkward cases: nulls, empty texts, ties, repeated rows, long words, odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, sha string, length int, part int, n long, slot long, bucket long"

ODD = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'s", "'LL", "1", "٣", "ß", "İ", "Σ", " ", " ", "́", "|", "!", "<|endoftext|>", "<|startoftext|>", "<|", "▁", "中", "word", "Word", "😀", "\x1c", "\x85", "ﬁ", "\r\n", "...", "don't"]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)]


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    near = [t.replace(" ", "  ", 1) for t in base[:10]] + [" ".join(t.split()[:-1] + ["zzz"]) for t in base[10:20]]
    return base + near + base[:7] + [base[0].upper()] * 5 + ["", " \n ", None, None, "x" * 30_000, "word " * 5000, base[3] + "\n" + base[4]] + odd_texts(40, seed)


def documents(spark, rows):
    """rows: texts, or (doc_id, text)."""
    pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", "k", "s", 1, 2, 3, 4, 5) for i, t in pairs], SCHEMA)


def many(spark):
    """All awkward cases in one table, with a null doc_id and a repeated row."""
    rows = list(enumerate(texts()))
    return [*rows, (None, "no id"), rows[5], (10_000, "tail")]
