"""What operators need of a session: lineage cuts in the shared folder and row-preserving helpers.

Iterative operators write each round to a Parquet table below ``spark.checkpoint.dir`` (the folder all executors
share) and read it again. Such a table survives the loss of executors and is smaller than a row-wise checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"
_own_dir: str | None = None
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's own setting; only a session on one machine may do without it.

    Raises RuntimeError on a cluster without the setting, where executors could not read each other's files.
    """
    global _own_dir
    configured = spark.conf.get(SHARED_DIR, None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {SHARED_DIR} to a folder that all executors share; the master is {master}")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="knotwork-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one run of an operator.

    ``keep`` writes a DataFrame and returns it as read back; ``drop`` deletes tables no later step reads. Tables that
    the result still reads stay until the process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/knotwork-{label}-{uuid.uuid4().hex}"
        self.count = 0
        _left.append((spark, self.base))

    def keep(self, frame: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._knotwork_path = path  # type: ignore[attr-defined]
        return kept

    def keep_counted(self, frame: DataFrame) -> tuple[DataFrame, int]:
        """As ``keep``, with the number of rows, counted while they are written."""
        seen = Observation()
        kept = self.keep(frame.observe(seen, F.count(F.lit(1)).alias("n")))
        return kept, int(seen.get["n"])

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            path = getattr(frame, "_knotwork_path", None)
            if path:
                _delete(self.spark, path)


@atexit.register
def _sweep() -> None:
    for spark, base in _left:
        try:
            _delete(spark, base)
        except Exception:  # noqa: BLE001  the session may have ended before the process
            pass


def spread(frame: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores, for stages that compute much on few bytes.

    Inputs with enough splits, as all large ones have, stay as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)
