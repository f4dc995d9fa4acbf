import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import language_id, quality
from quarrylight.llm.common import text_buffer
from tests.llm.rows import documents, many, texts

DATA = "/root/testdata/sf0.01"
have_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def held_out(doc_id, fold, rest):
    return zlib.crc32(str(doc_id).encode()) % fold == rest


def test_features_are_those_of_each_text_alone():
    rows = texts()
    together = quality.features(*text_buffer(pa.array(rows, pa.string())))
    assert together.shape == (len(rows), len(quality.FEATURES)) and np.isfinite(together).all()
    for i in range(0, len(rows), 7):
        alone = quality.features(*text_buffer(pa.array([rows[i]], pa.string())))
        assert np.allclose(alone[0], together[i])


def test_features_do_not_depend_on_the_text_before():
    rows = ["x a", "b a b a b", "c b", "b a b a b"]
    got = quality.features(*text_buffer(pa.array(rows)))
    assert (got[1] == got[3]).all() and (got[1] == quality.features(*text_buffer(pa.array(rows[1:2])))[0]).all()


def plain_features(text):
    """From the definitions, byte by byte."""
    data = (text or "").encode()
    upper = [65 <= c <= 90 or (c == 0xC3 and i + 1 < len(data) and 0x80 <= data[i + 1] < 0x9F) for i, c in enumerate(data)]
    letter = [c >= 128 or chr(c).isalpha() for c in data]
    digit = [48 <= c <= 57 for c in data]
    mark = [32 < c < 127 and not chr(c).isalnum() for c in data]
    spans, at = [], None
    for i in range(len(data) + 1):
        if i < len(data) and data[i] not in b" \t\n\x0b\x0c\r":
            at = i if at is None else at
        elif at is not None:
            spans.append((at, i))
            at = None
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in data[a:b]) for a, b in spans]
    letters, capitals = [sum(letter[a:b]) for a, b in spans], [sum(upper[a:b]) for a, b in spans]
    lines = [x for x in data.replace(b"\n", b"\n\0").split(b"\0") if len(x) > 1] if b"\0" not in data else None
    n, share = len(spans), lambda x, y: math.log((x + 0.3) / (y + 30))
    stop = [data[b - 1] in b".,;:?'\")" for _, b in spans]
    pairs = [(None, lower[0])] + list(zip(lower, lower[1:])) if n else []
    return [
        math.log1p(n),
        math.log1p(sum(letter) / max(n, 1)),
        share(sum(upper), sum(letter)),
        share(sum(x > 1 and 2 * c > x for x, c in zip(letters, capitals)), n),
        share(sum(x > 0 and mark[b - 1] and not s for x, (_, b), s in zip(letters, spans, stop)), n),
        share(sum(b - a == 1 and x == 0 for x, (a, b) in zip(letters, spans)), n),
        share(sum(x == y for x, y in zip(lower, lower[1:])), n),
        share(n - len(set(lower)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(digit), len(data)),
        share(sum(mark), len(data)),
        sum(c >= 128 for c in data) / max(len(data), 1),
        math.log1p(n / max(len(lines), 1)),
        share(n - len(set(pairs)), n),
        share(sum(stop), n),
        share(sum(c > 0 for c in capitals), n),
    ]


def real_texts():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist() if os.path.isdir("/root/testdata/sf0.001") else []


def test_features_are_the_plain_ones():
    rows = texts() + real_texts()
    got = quality.features(*text_buffer(pa.array(rows, pa.string())))
    assert np.allclose(got, np.array([plain_features(t) for t in rows]), atol=1e-9)


def test_scores_are_those_of_the_plain_formula(spark):
    """All rows against shrunk covariances written out, with the registered shrinkage."""
    rows = list(enumerate((texts() + real_texts())[:300]))
    r = random.Random(3)
    label = {i: int(r.random() < 0.7) for i, _ in rows if i % 5}
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, y, 0, "clash", 9) for i, y in label.items()], "doc_id long, quality int, toxic int, text string, n_chars int")
    got = {x["doc_id"]: x for x in quality.quality_scores(docs, labels).collect()}
    x = np.array([plain_features(t) for _, t in rows])
    learned = [i for i, _ in rows if i in label and not held_out(i, 3, 1)]
    classes = [x[[i for i in learned if label[i] == y]] for y in (0, 1)]
    own = [(c - c.mean(0)).T @ (c - c.mean(0)) / len(c) for c in classes]
    pooled = sum(len(c) * s for c, s in zip(classes, own)) / len(learned)
    density = []
    for c, s in zip(classes, own):
        s = 0.6 * s + 0.4 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.02 * np.eye(len(s))
        away = x - c.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away) - 0.5 * np.linalg.slogdet(s)[1] + np.log((len(c) + 0.5) / (len(learned) + 1)))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))
    assert np.allclose([got[i]["score"] for i, _ in rows], want, atol=1e-6)
    assert all(got[i]["predicted"] == int(got[i]["score"] >= 0.5) and got[i]["held_out"] == held_out(i, 3, 1) for i, _ in rows)


def test_keep_good_keeps_what_is_predicted_good(spark):
    rows = [*many(spark), (None, None), (3, "x" * 50_000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "clash") for i in range(0, 60)], "doc_id long, quality int, toxic int, text string")
    scored = quality.quality_scores(docs, labels).collect()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in scored if r["predicted"])


def test_discriminant_is_the_gaussian_ratio():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))
    d = quality.Discriminant.fit(np.array([400, 300]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]), 0, 0, 0)

    def density(x, s):
        c = np.cov(s.T, bias=True)
        return -0.5 * np.einsum("ij,jk,ik->i", x - s.mean(0), np.linalg.inv(c), x - s.mean(0)) - 0.5 * np.linalg.slogdet(c)[1]

    x = rng.normal(0.5, 1, (50, 3))
    want = density(x, b) - density(x, a) + np.log(300.5 / 400.5)
    assert np.allclose(np.log(d.score(x) / (1 - d.score(x))), want)


def test_fit_without_a_class():
    for count in ((0, 0), (5, 0), (0, 1)):
        d = quality.Discriminant.fit(np.array(count), np.ones((2, 2)) * np.array(count)[:, None], np.stack([(np.eye(2) + 1) * c for c in count]))
        assert ((d.score(np.zeros((3, 2))) >= 0) & (d.score(np.zeros((3, 2))) <= 1)).all()


@have_data
def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.quality_scores(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == docs.count() and all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in got)
    test = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) >= 0.95 * len(test)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_takes_odd_rows(spark):
    docs = documents(spark, many(spark))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 1), (3, 7, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert len(quality.quality_scores(docs, labels.limit(0)).collect()) == docs.count()


@have_data
def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.language_ids(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    test = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == held_out(r["doc_id"], 4, 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in test) >= 0.97 * len(test) and all(0 <= r["score"] <= 1 for r in got)


@have_data
def test_mixtures_have_the_proportions_of_their_parts(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").collect()
    by = {}
    for r in rows:
        if len(r["text"]) > 1500:
            by.setdefault(r["lang"], []).append(r["text"][:1500])
    model = language_id.Mixture(language_id.count_trigrams(spark.read.parquet(f"{DATA}/documents.parquet")).toArrow())
    r = random.Random(2)
    names = sorted(by)
    mixed = []
    for _ in range(20):
        a, b = r.sample(names, 2)
        mixed.append((a, b, f"{r.choice(by[a])} {r.choice(by[a])} {r.choice(by[b])}"))
    data, offsets = text_buffer(pa.array([t for *_, t in mixed]))
    names_, scores, sets = model.predict(data, offsets)
    good = [n == a and {a, b} == set(s) and 0.5 < x < 0.85 for (a, b, _), n, x, s in zip(mixed, names_, scores, sets, strict=True)]
    assert sum(good) >= 16


def test_languages_take_odd_rows(spark):
    rows = [*many(spark), (70_000, "123 !? 4"), (70_001, "中文"), (70_002, None)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in language_id.language_ids(docs).collect()}
    assert [got[i]["lang_pred"] for i in (70_000, 70_001, 70_002)] == ["und", "en", "und"] and got[70_002]["score"] == 0
    nothing = language_id.language_ids(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(rows)
    assert language_id.language_ids(docs.limit(0)).collect() == []


def folded(text):
    """The trigrams (hash, context) of each word: A-Z and accented Latin capitals in lower case, spaces for all that isn't a letter, the space after a word as its end."""
    data = (text or "").encode()
    low = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in data]
    low = [32, 32] + [c + 32 if i and low[i - 1] == 0xC3 and 0x80 <= c < 0x9F else c for i, c in enumerate(low)]
    out = []
    for i in range(2, len(low)):
        if low[i] != 32 or low[i - 1] != 32:
            if low[i - 1] == 32:
                out.append([])
            out[-1].append(((low[i - 2] << 16 | low[i - 1] << 8 | low[i]) * 2654435761 % 2**32 >> 16, low[i - 2] << 8 | low[i - 1]))
    return out


def plain_mixture(words, langs, rounds=12):
    """EM over the log likelihoods of words, then the rarest language out as long as the likelihood falls by no more than half the log of the number of words."""
    like = [[math.exp(x - max(w)) for x in w] for w in words]

    def em(part, times):
        for _ in range(times):
            new = [0.0] * langs
            for row in like:
                total = sum(a * b for a, b in zip(row, part)) + 1e-30
                for k in range(langs):
                    new[k] += row[k] * part[k] / total
            part = [x / len(like) for x in new]
        return part

    def fit(part):
        return sum(math.log(sum(a * b for a, b in zip(row, part)) + 1e-30) for row in like)

    everything = em([1 / langs] * langs, rounds)
    chosen, penalty = list(everything), 0.5 * math.log(max(len(like), 2))
    while sum(x > 0 for x in chosen) > 1:
        rarest = min((x, k) for k, x in enumerate(chosen) if x > 0)[1]
        rest = [0.0 if k == rarest else x for k, x in enumerate(chosen)]
        without = em([x / max(sum(rest), 1e-30) for x in rest], 4) if sum(rest) > 0 else chosen
        if fit(without) < fit(chosen) - penalty:
            break
        chosen = without
    return everything, chosen


@have_data
def test_languages_are_those_of_a_plain_em(spark):
    """Counts, proportions, selected sets and predictions of all rows against a version word by word."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    rows = [(r["doc_id"], (r["text"] or "")[:1500], r["lang"]) for r in rows] + [(9000 + i, t, None) for i, t in enumerate(texts()[60:]) if t is None or len(t) < 3000]
    docs = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, lang string, kind int, bucket string, n long")
    names = sorted({lang for _, _, lang in rows if lang})
    tri, ctx = {n: Counter() for n in names}, {n: Counter() for n in names}
    for i, text, lang in rows:
        if lang and text is not None and not held_out(i, 4, 2):
            for t, c in (p for w in folded(text) for p in w):
                tri[lang][t] += 1
                ctx[lang][c] += 1
    got = {r["doc_id"]: r for r in language_id.language_ids(docs).collect()}
    close = 0
    for i, text, _ in rows:
        words = [[sum(math.log(tri[n][t] + 0.2) - math.log(ctx[n][c] + 0.2 * 64) for t, c in w) for n in names] for w in folded(text)]
        if not any(ch.isalpha() for ch in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0, [])
            continue
        everything, chosen = plain_mixture(words, len(names))
        best = max(range(len(names)), key=lambda k: (chosen[k], -k))
        assert abs(got[i]["score"] - min(1, everything[best])) < 1e-3 and got[i]["lang_pred"] == names[best]
        close += got[i]["languages"] == [n for n, x in zip(names, chosen) if x > 0]
    assert close >= len(rows) - 12  # numbers of 32 bits may tip a likelihood that lies on the penalty
