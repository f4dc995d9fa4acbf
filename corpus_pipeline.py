"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Stages but the last return the columns of documents; other columns of the table are left out. Each
stage's table is written to the shared folder and read again, so a lost executor costs no more than
its own stage; what a stage needed is deleted when its table is written. Every stage takes null and
empty texts, repeated rows, rows without a doc_id, texts of any length and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import tokens
from quarrylight.llm.common import discard, materialise, release, sweep, written
from quarrylight.llm.exact_dedup import exact_dedup
from quarrylight.llm.jaccard_join import jaccard_classes
from quarrylight.llm.packing import pack
from quarrylight.llm.quality import keep_good
from quarrylight.llm.queries import END_ID, tokenizer_path
from quarrylight.llm.suffix_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant predicts 0 go. Null and empty texts are judged by their statistics like others; each of equal rows is judged, alike."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays; of equal rows one."""
    result = materialise(exact_dedup(docs), "pipeline-copies")
    kept = result.filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), 256)
    rows = docs.select(*COLUMNS, sha.alias("sha")).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    if result.groupBy("doc_id", "text_sha256").count().filter("count > 1").head(1):
        rows = rows.dropDuplicates(["doc_id", "sha"])
    return rows.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over 5-word shingles, directly or through others, the one with the smallest doc_id stays. Rows without a doc_id stay, and connect others. Null texts and texts without words link with nothing."""
    classes = materialise(jaccard_classes(docs, n=5, num=80, den=100), "pipeline-classes")
    gone = classes.filter("doc_id <> component_id").select("doc_id").join(classes.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_anti").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that stand earlier in the corpus go from the texts; texts of which only white space is left go. Null texts stay null; equal rows are one document and stay alike."""
    return without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, with their places in sequences. Null and empty texts are a piece of the end id alone; each row is packed, also one that repeats or has no doc_id."""
    path = tokenizer_path("byte_bpe_50k.json")
    return pack(docs, lambda: tokens.byte_bpe(path), END_ID, capacity=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the tokenizer can't be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        since = written()
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        sweep(since, docs)
        discard(*before)
        before = [docs]
        release(spark)
    return docs
