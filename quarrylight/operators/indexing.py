"""Incremental index maintenance as joins; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ReadOnlyError(RuntimeError):
    pass


def changed_files(files: DataFrame, file_hashes: DataFrame) -> DataFrame:
    """Files (path, hash) that have no stored hash or another."""
    stored = file_hashes.select("path", F.col("hash").alias("stored"))
    return files.join(stored, "path", "left").filter(F.col("stored").isNull() | (F.col("stored") != F.col("hash"))).drop("stored")


def reuse_vectors(new_chunks: DataFrame, old_chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """New chunks with the embedding of an old chunk of the same path and content, null where there is none. Of several old ones the largest id counts."""
    old = old_chunks.select("path", "content_hash", "id").join(vectors.select("id", "embedding"), "id")
    best = old.groupBy("path", "content_hash").agg(F.max_by("embedding", "id").alias("embedding"))
    return new_chunks.join(best, ["path", "content_hash"], "left")


def reuse_counts(reused: DataFrame) -> DataFrame:
    """One row: chunks, reused, embedded, reuse_percent."""
    n, kept = F.count("*"), F.count("embedding")
    return reused.agg(n.alias("chunks"), kept.alias("reused"), (n - kept).alias("embedded"), F.when(n > 0, kept * 100.0 / n).otherwise(0.0).alias("reuse_percent"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """existing without the keys of new, and new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(existing: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def prune(table: DataFrame, paths_on_disk: DataFrame) -> DataFrame:
    """Rows whose file still exists. Takes chunks, snippets and hashes alike."""
    return table.join(paths_on_disk.select("path").distinct(), "path", "left_semi")


def consistency(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, problem): chunks without vector, and vectors without chunk."""
    missing = chunks.select("id").join(vectors.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing_vector"))
    return missing.unionByName(vectors.select("id").join(chunks.select("id"), "id", "left_anti").withColumn("problem", F.lit("orphaned_vector")))


def repair(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors without the orphaned ones."""
    return vectors.join(chunks.select("id"), "id", "left_semi")


def statistics(chunks: DataFrame, vectors: DataFrame, snippets: DataFrame | None = None) -> DataFrame:
    """One row: chunks, files, vectors, dimension, snippets, consistent."""
    a = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"))
    b = vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
    c = snippets.agg(F.count("*").alias("snippets")) if snippets is not None else chunks.sparkSession.range(1).select(F.lit(0).cast("long").alias("snippets"))
    return a.crossJoin(b).crossJoin(c).withColumn("consistent", F.col("chunks") == F.col("vectors"))  # one row each


def by_content_hash(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """For each asked content_hash that exists, the chunk with the largest id."""
    rows = chunks.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("content_hash").orderBy(F.desc("id")))).filter("n = 1").drop("n")


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def by_path(table: DataFrame, path: str) -> DataFrame:
    return table.filter(F.col("path") == path).orderBy("start_line", "id")


def delta(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files of the remote manifest (name, size, compressed_size, checksum) that are missing locally or differ."""
    have = local.select("name", F.col("checksum").alias("have"))
    return remote.join(have, "name", "left").filter(F.col("have").isNull() | (F.col("have") != F.col("checksum"))).drop("have")


def remote_status(local_version: DataFrame, remote_version: DataFrame) -> DataFrame:
    """One row (status): remote_newer, equal, local_newer or no_local, from one-row tables (version)."""
    both = remote_version.select(F.col("version").alias("r")).crossJoin(local_version.agg(F.max("version").alias("l")))
    return both.select(F.when(F.col("l").isNull(), "no_local").when(F.col("r") > F.col("l"), "remote_newer").when(F.col("r") == F.col("l"), "equal").otherwise("local_newer").alias("status"))
