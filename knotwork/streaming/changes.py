"""Streams of statements and events. The batch operators define the results; these keep them up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.statements import upsert


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_per_id(statements: DataFrame, time: str = "last_seen", late: str = "1 day") -> DataFrame:
    """Each statement id once within the time that rows may come late."""
    return statements.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late).dropDuplicatesWithinWatermark(["id"]).drop("_time")


def seen_windows(events: DataFrame, time: str, key: str, *, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, key, n, first_seen, last_seen) per window of event time; windows are closed when the watermark passes them."""
    rows = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    window = F.window("_time", width, slide) if slide else F.window("_time", width)
    out = rows.groupBy(window.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("_time").alias("first_seen"), F.max("_time").alias("last_seen"))
    return out.select(F.col("w.start").alias("start"), "key", "n", "first_seen", "last_seen")


def sessions(events: DataFrame, time: str, key: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events of a key without a gap."""
    rows = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = rows.groupBy(F.session_window("_time", gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_into(path: str):
    """A function for ``foreachBatch`` that brings batches of statements into a Parquet table.

    Each batch is written as a new generation beside the old one, and a small pointer file names the current one, so a
    failed batch leaves the table as it was and a repeated batch gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path)
        after = batch if before is None else upsert(before, batch)
        after.write.mode("overwrite").parquet(f"{path}/generation={number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer")

    return write


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upsert_into`` keeps, or None before the first batch."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    number = spark.read.parquet(f"{path}/pointer").head().number
    return spark.read.parquet(f"{path}/generation={number}")
