"""Tables changed together, and their files kept in few pieces."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession


class Unit:
    """Tables below a folder that change together: written beside the old ones, then put in their place by renaming.

    Readers see the old table until ``commit`` renames it away; a writer that dies before leaves the old tables whole, and one that
    dies inside ``commit`` leaves each table either old, new, or old under the unit's own folder, from which ``recover`` puts it back.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.own = f"{self.folder}/_unit-{uuid.uuid4().hex}"
        self.staged: list[str] = []
        self.marks: list[int] = []

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _files(self):  # noqa: ANN202
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def stage(self, name: str, frame: DataFrame) -> DataFrame:
        """Write a table that is to replace the one of that name, or the staged one; it is returned as written."""
        at = f"{self.own}/{len(self.staged)}"
        frame.write.parquet(f"{at}/{name}")
        self.staged.append(name)
        return self.spark.read.schema(frame.schema).parquet(f"{at}/{name}")

    def checkpoint(self) -> None:
        """Mark what is staged so far, as where ``rollback`` goes back to."""
        self.marks.append(len(self.staged))

    def rollback(self) -> None:
        """Give up what was staged since the last checkpoint, or all."""
        keep = self.marks.pop() if self.marks else 0
        for k in range(keep, len(self.staged)):
            self._files().delete(self._path(self.own, str(k)), True)
        del self.staged[keep:]

    def commit(self) -> None:
        """Put the staged tables in their places."""
        files = self._files()
        last = {name: k for k, name in enumerate(self.staged)}
        files.mkdirs(self._path(self.own, "old"))
        for name, k in last.items():
            if files.exists(self._path(self.folder, name)):
                files.rename(self._path(self.folder, name), self._path(self.own, "old", name))
            files.rename(self._path(self.own, str(k), name), self._path(self.folder, name))
        files.delete(self._path(self.own), True)
        self.staged, self.marks = [], []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def recover(spark: SparkSession, folder: str) -> list[str]:
    """The names of tables that a unit which died in its commit had renamed away, now in their places again; rests of units go."""
    unit = Unit(spark, folder)
    files, back = unit._files(), []
    if not files.exists(unit._path(unit.folder)):
        return back
    for left in files.listStatus(unit._path(unit.folder)):
        if left.getPath().getName().startswith("_unit-"):
            old = unit._path(left.getPath().toString(), "old")
            for table in files.listStatus(old) if files.exists(old) else []:
                place = unit._path(unit.folder, table.getPath().getName())
                if not files.exists(place):
                    files.rename(table.getPath(), place)
                    back.append(table.getPath().getName())
            files.delete(left.getPath(), True)
    return sorted(back)


def compact(spark: SparkSession, folder: str, name: str, file_bytes: int = 256 << 20) -> int:
    """The number of files of about so many bytes that a table is rewritten to, in one unit."""
    unit = Unit(spark, folder)
    size = unit._files().getContentSummary(unit._path(unit.folder, name)).getLength()
    n = max(1, math.ceil(size / file_bytes))
    unit.stage(name, unit.read(name).coalesce(n))
    unit.commit()
    return n
