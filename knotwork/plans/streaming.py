"""Streams over the event and statement tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.plans.registry import Registry
from knotwork.session import Scratch
from knotwork.sources.tables import table
from knotwork.streaming import changes as C

REGISTRY = Registry()


def _run(spark: SparkSession, stream: DataFrame, mode: str, label: str) -> DataFrame:
    """A bounded stream run through to a Parquet table."""
    scratch = Scratch(spark, label)
    sink = f"{scratch.base}/out"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{scratch.base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).option("checkpointLocation", f"{scratch.base}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; a table of one file is read through a glob of its name."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@REGISTRY.query("str_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS key, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, C.seen_windows(_source(spark, sf_dir, "events"), "ts", "event_type"), "complete", "windows")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("start", "first_seen", "last_seen") else c for c in out.columns])


@REGISTRY.query(
    "str_sessions",
    """WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT key, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY key, k""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, C.sessions(_source(spark, sf_dir, "events"), "ts", "user_id"), "complete", "sessions")
    return out.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@REGISTRY.query("str_once", "SELECT DISTINCT id FROM statements WHERE id IS NOT NULL AND last_seen IS NOT NULL")
def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, "statements").where("id IS NOT NULL AND last_seen IS NOT NULL")
    return _run(spark, C.once_per_id(rows).select("id"), "append", "once")


@REGISTRY.query("str_upsert", "SELECT count(DISTINCT id) AS n FROM statements WHERE id IS NOT NULL")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements brought into a table by micro-batches."""
    scratch = Scratch(spark, "upsert")
    path = f"{scratch.base}/table"
    query = _source(spark, sf_dir, "statements").writeStream.foreachBatch(C.upsert_into(path)).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return C.current(spark, path).agg(F.countDistinct("id").alias("n"))
