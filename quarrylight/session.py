"""Session settings, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Give the package's source to all Python workers, wherever they run; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quarrylight_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quarrylight-")
    path = os.path.join(folder, "quarrylight.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(os.path.join(_ROOT, "quarrylight")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    context.addPyFile(path)
    context._quarrylight_shipped = True


def small_batches(spark: SparkSession) -> None:
    """What operators in Python workers need: the package on all workers and Arrow batches of 32 MB at most. The settings stay, since plans are run later."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a path deleted when the driver ends, for tables that lazy results still read."""
    system, place = file_system(spark, path)
    system.deleteOnExit(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for tables that several plans read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build(app: str = "quarrylight", **options: str) -> SparkSession:
    """A session with the settings that the engine expects; options win."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | options
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
