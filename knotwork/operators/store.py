"""Versioned statement storage and the lookup cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.operators.statements import latest


class VersionedStore:
    """Statements in Parquet, partitioned by dataset and version, with a small table of released versions.

    A version becomes visible when it is released; readers take the latest released version of each dataset and apply a
    linker while reading, so stored ids stay as they came.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def write(self, dataset: str, version: str, statements: DataFrame, *, keep_first_seen: bool = True) -> None:
        """Statements under a dataset and version, each id once; a statement of the latest version keeps its first sight."""
        rows = latest(statements.withColumn("dataset", F.lit(dataset)))
        before = self.latest(dataset)
        if keep_first_seen and before is not None:
            rows = carry_first_seen(rows, self.read(dataset, before))
        rows.drop("dataset").write.mode("overwrite").parquet(f"{self.path}/data/dataset={dataset}/version={version}")

    def release(self, dataset: str, version: str) -> None:
        seq = len(self.history(dataset))
        row = self.spark.createDataFrame([(dataset, version, seq)], "dataset string, version string, seq int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def _versions(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/versions") if self._exists(f"{self.path}/versions") else None

    def history(self, dataset: str) -> list[str]:
        """Released versions, oldest first."""
        table = self._versions()
        return [] if table is None else [r.version for r in table.where(F.col("dataset") == dataset).orderBy("seq").collect()]

    def latest(self, dataset: str) -> str | None:
        found = self.history(dataset)
        return found[-1] if found else None

    def has_version(self, dataset: str, version: str) -> bool:
        return version in self.history(dataset)

    def drop(self, dataset: str, version: str) -> None:
        table = self._versions()
        if table is not None:
            rest = [tuple(r) for r in table.where(~((F.col("dataset") == dataset) & (F.col("version") == version))).collect()]
            kept = self.spark.createDataFrame(rest, "dataset string, version string, seq int")
            kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions")
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/dataset={dataset}/version={version}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def read(self, dataset: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/dataset={dataset}/version={version}").withColumn("dataset", F.lit(dataset))

    def view(self, datasets: list[str]) -> DataFrame | None:
        """Statements of the latest released versions of some datasets."""
        out: DataFrame | None = None
        for dataset in datasets:
            version = self.latest(dataset)
            if version is not None:
                rows = self.read(dataset, version)
                out = rows if out is None else out.unionByName(rows)
        return out


def carry_first_seen(rows: DataFrame, before: DataFrame) -> DataFrame:
    """Statements with the first sight of the same id in an earlier version."""
    old = before.groupBy("id").agg(F.min("first_seen").alias("_first"))
    return rows.join(old, "id", "left").select(*[F.coalesce("_first", "first_seen").alias(c) if c == "first_seen" else F.col(c) for c in rows.columns])


def first_seen(statements: DataFrame, key: str = "canonical_id") -> DataFrame:
    """(key, id, first_seen): the first sight of each statement id of a key, one row each, so no key is gathered in one place."""
    return statements.where("id IS NOT NULL").groupBy(key, "id").agg(F.min("first_seen").alias("first_seen"))


def cache_lookup(cache: DataFrame, keys: DataFrame, *, now: str, max_age_days: int | None = None, since: str | None = None) -> DataFrame:
    """(key, text, ts): the latest fresh row of each key.

    Rows are fresh for half to one and three tenths of ``max_age_days``, by a share fixed for each key so that they do not
    all expire at once, and if they are later than ``since``. An age below one finds nothing.
    """
    rows = cache.join(keys.select("key").distinct(), "key", "left_semi")
    if max_age_days is not None:
        if max_age_days < 1:
            return rows.select("key", "text", "ts").limit(0)
        rows = rows.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr("make_dt_interval(0, 0, 0, 1)") * expiry_seconds(F.col("key"), max_age_days))
    if since is not None:
        rows = rows.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))
    return rows.groupBy("key").agg(F.max(F.struct("ts", "text")).alias("r")).select("key", "r.text", "r.ts")


def expiry_seconds(key, days: int):  # noqa: ANN001, ANN201
    """Seconds a cached row of a key stays fresh: its digest picks a share between 0.5 and 1.3 of the days."""
    share = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(801))
    return F.floor((500 + share) * F.lit(days * 86.4))


def cache_like(cache: DataFrame, pattern: str) -> DataFrame:
    """The latest row of every key that is like a pattern."""
    window = W.partitionBy("key").orderBy(F.desc("ts"), F.desc("text"))
    return cache.where(F.col("key").like(pattern)).withColumn("k", F.row_number().over(window)).where("k = 1").drop("k")
