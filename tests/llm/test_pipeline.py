"""Each stage against a plain version on a small table."""

import corpus_pipeline
from quarrylight.llm import quality
from quarrylight.llm.common import text_buffer
from tests.llm.rows import documents, texts
from tests.llm.test_dedup import LOWER, brute_components, families, passages
from tests.llm.test_tokens import BYTE, check_packing, library

import numpy as np
import pyarrow as pa


def table(spark, tmp_path):
    rows = list(enumerate([t for t in texts(2, 30) if t is None or len(t) < 20_000] + families(3, 40) + passages(6)))
    folder = f"{tmp_path}/sf"
    documents(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_do_what_plain_versions_do(spark, tmp_path):
    folder, rows = table(spark, tmp_path)
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    given = dict(rows)
    ids = lambda df: {r["doc_id"] for r in df.collect()}

    docs = read("documents")
    kept = stages["quality classifier"](spark, docs, folder)
    scored = {r["doc_id"] for r in quality.quality_scores(docs, read("labels")).collect() if r["predicted"] == 1}
    assert ids(kept) == scored and kept.columns == corpus_pipeline.COLUMNS

    kept = stages["exact dedup"](spark, docs, folder)
    last = {}
    for i, t in rows:
        last[(t or "").translate(LOWER)] = i
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(last.values())

    near = stages["n-gram Jaccard join"](spark, kept, folder)
    left = sorted((i, given[i]) for i in last.values())
    assert ids(near) == {i for i, _, c in brute_components(left, 5, 80, 100) if i == c}

    clean = stages["suffix-array dedup"](spark, near, folder)
    seen, want = set(), {}
    for i, t in [r for r in left if r[0] in ids(near)]:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = True
            seen.add(b[p : p + 100])
        text = bytes(np.frombuffer(b, np.uint8)[~mark]).decode("utf-8", "ignore")
        if not mark.any() or text.strip():
            want[i] = None if t is None else text
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want

    packed = stages["best-fit packing"](spark, clean, folder)
    order = sorted(want.items())
    check_packing(packed.collect(), order, 1024, [x + [2] for x in library(BYTE, [t for _, t in order])])


def test_run(spark, tmp_path):
    folder, _ = table(spark, tmp_path)
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert quality.features(*text_buffer(pa.array([""]))).shape[0] == 1


def test_repeated_rows_and_rows_without_id(spark, tmp_path):
    folder, _ = table(spark, tmp_path)
    docs = documents(spark, [(1, "A b"), (1, "A b"), (1, "other"), (None, "x y"), (None, None)])
    got = corpus_pipeline.exact_copies(spark, docs, folder).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", "A b"), ("1", "other"), ("None", "None"), ("None", "x y")]
    assert len(corpus_pipeline.near_copies(spark, docs, folder).collect()) >= 3


def test_no_documents(spark, tmp_path):
    folder = f"{tmp_path}/none"
    documents(spark, []).select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_odd_rows_and_very_long_texts(spark, tmp_path):
    """Rows of more bytes than an Arrow batch holds, with repeated rows, rows without id and clashing columns, go through all stages; only the last table is left."""
    import os

    from quarrylight.llm import common

    long = [" ".join(f"w{i * 7919 % 1000003}x{k}" for i in range(600_000)) for k in (1, 2)]
    assert len(long[0]) > 4 << 20
    rows = [*enumerate(texts(4, 20)), (100, long[0]), (101, long[0]), (102, long[1] + " tail"), (102, long[1] + " tail"), (None, "no id here"), (None, None), (7, "")]
    folder = f"{tmp_path}/odd"
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0, "x") for i in range(50)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    shared = common.shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(shared))
    was = common.BATCH_BYTES
    common.BATCH_BYTES = 1 << 20
    try:
        got = corpus_pipeline.run(spark, folder)
        ids = {r["doc_id"] for r in got.collect()}
    finally:
        common.BATCH_BYTES = was
    assert {101, 102} <= ids and 100 not in ids and None in ids
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(shared)) - there} == {"stage-best-fit-packing"}
