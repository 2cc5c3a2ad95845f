"""Compact, exact forms of identifiers for shuffles, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(identifier: Column) -> Column:
    """A binary form half as long for lower-case hex of 40 characters, equal exactly where the strings are equal."""
    return F.when(identifier.rlike("^[0-9a-f]{40}$"), F.concat(F.unhex(F.lit("01")), F.unhex(identifier))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(identifier, "UTF-8")))


def unpack(packed: Column) -> Column:
    """The string that ``pack`` was given."""
    rest = F.substring(packed, 2, 2_000_000_000)
    return F.when(F.hex(F.substring(packed, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def small(frame: DataFrame, rows: int = 10_000) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows, else as it is, to be joined by shuffle."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def meetings(frame: DataFrame, key: str, member: str, holders: int = 1000) -> DataFrame:
    """(a, b): members a < b that hold a common key, each pair once.

    The holders of a key are dealt to salts of about ``holders``, so that no key of the join has more than that many rows on its
    left side, however many hold it; all pairs come out.
    """
    rows = frame.select(F.col(key).alias("_k"), F.col(member).alias("_m")).distinct()
    sized = rows.groupBy("_k").agg(F.ceil(F.count("*") / F.lit(holders)).cast("int").alias("_n"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    rows = rows.join(sized, "_k")
    left = rows.select("_k", F.col("_m").alias("a"), F.pmod(F.xxhash64("_m"), "_n").cast("int").alias("_s"))
    right = rows.select("_k", F.col("_m").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"))
    return left.join(right.hint("merge"), ["_k", "_s"]).where("a < b").select("a", "b").distinct()
