"""The driver's tables as chunks, snippets, vectors and queries. Every column follows from the row alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.columns import first_tokens
from quarrylight.operators import fulltext
from quarrylight.session import shared_dir, until_exit

FOLDERS = ("Sources", "Tests", "docs", "archive")
EXTENSIONS = ("swift", "md", "json")
KINDS = ("class", "function", "protocol", "extension", "section")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as code chunks."""
    n, t = F.col("doc_id"), F.col("tokens")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("content")).withColumn("tokens", first_tokens(F.col("content"), 4))
    word = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit(""))
    conforms = F.when(n % 6 == 0, F.array(F.lit("Codable"), F.lit("ChunkStore"))).when(n % 6 == 3, F.array(F.concat(F.lit("Store"), (n % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        n.cast("string").alias("id"),
        F.concat(F.lit("/project/"), _pick(FOLDERS, n), F.lit("/"), "source", F.lit("/doc"), n.cast("string"), F.lit("."), _pick(EXTENSIONS, n)).alias("path"),
        "content",
        F.lit(1).alias("start_line"),
        (F.size(F.split("content", "\n", -1))).alias("end_line"),
        _pick(KINDS, n).alias("kind"),
        F.slice(t, 1, 2).alias("symbols"),
        F.slice(t, 3, 2).alias("references"),
        F.sha2("content", 256).alias("file_hash"),
        F.lit(None).cast("string").alias("doc_comment"),
        F.concat(F.when(n % 3 == 0, F.lit("public ")).otherwise(F.lit("")), word(0)).alias("signature"),
        F.sha2("content", 256).alias("content_hash"),
        F.lit(None).cast("string").alias("generated_description"),
        conforms.alias("conformances"),
        (n % 2 == 0).alias("is_type_declaration"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as documentation snippets."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("/docs/c"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, ".md").otherwise(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce("role", F.lit("")).alias("breadcrumb"))


_INDEXES: dict[tuple[str, str], fulltext.TextIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> fulltext.TextIndex:
    """chunks() with postings and statistics in the shared folder; built once for each application and folder of tables, by the first query that searches."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}"
        _INDEXES[key] = fulltext.write_index(chunks(spark, sf_dir), fulltext.CHUNK_FIELDS, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
        until_exit(spark, path)
    return _INDEXES[key]
