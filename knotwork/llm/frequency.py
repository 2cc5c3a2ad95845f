"""Counts of every distinct term by heavy-light aggregation.

Method: terms that are heavy are detected in one pass by a mergeable sketch (it only chooses the route, never a count) and
broadcast as small numbers. Their occurrences are dealt over all tasks by record and added up in task-local counters, of which
each task has at most ``HEAVY``, so a heavy term leaves a task as one row; only the remaining terms, each of which has less
than a ``HEAVY``-th of all rows, are partitioned by term. Both tables are united. A row that is repeated counts once, which no
task can tell from its own rows: so heavy rows are shuffled too, but as record and number instead of text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import Scratch

#: A term with at least this part of all rows is heavy, so there are at most so many.
HEAVY = 1024
#: Parts a heavy term is dealt to.
SALTS = 64


def _norm(token: str) -> str:
    return unicodedata.normalize("NFC", token.strip().lower())


def _pack(identifier: str) -> bytes:
    """As functions.keys.pack."""
    if len(identifier) == 40 and not identifier.strip("0123456789abcdef"):
        return b"\x01" + bytes.fromhex(identifier)
    return b"\x00" + identifier.encode()


def valid(entries: DataFrame) -> DataFrame:
    """The rows that are occurrences: with id and token, and a count of at least one."""
    return entries.where("id IS NOT NULL AND token IS NOT NULL AND `count` >= 1")


def heavy_terms(entries: DataFrame) -> list[str]:
    """The terms with at least a ``HEAVY``-th of all rows, by a sketch of bounded size over all rows."""
    plain = F.lower(F.trim("token"))
    seen = valid(entries).select(plain.alias("t")).agg(F.expr(f"approx_top_k(t, {HEAVY}, {HEAVY * 16})").alias("top"), F.count("*").alias("n")).head()
    return sorted({_norm(x["item"]) for x in seen.top or [] if x["count"] * HEAVY >= seen.n})


def occurrences(entries: DataFrame, heavy: list[str]) -> DataFrame:
    """(key, token, k, salt, count): how often each record has each token, tokens in lower case, composed, without outer space.

    A heavy token has its number as k and no text; any other has k -1 and salt 0, and all its rows lie in one partition. Rows
    repeated in all of schema, id, field, token and count are one; rows with a null id or token, or a count null or below one,
    are no occurrence. Repeats are dropped within Arrow batches before the only shuffle.
    """
    rows = valid(entries).select("schema", "id", "field", "token", F.col("count").cast("long").alias("count"))
    number = {t: k for k, t in enumerate(heavy)}

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.group_by(table.column_names).aggregate([]).combine_chunks()
            raw = table["token"].to_pylist()
            term = [_norm(t) for t in raw]
            key = [_pack(i) for i in table["id"].to_pylist()]
            spelling = [None if r == t else r for r, t in zip(raw, term, strict=True)]
            ks = [number.get(t, -1) for t in term]
            text = [t if k < 0 else None for t, k in zip(term, ks, strict=True)]
            columns = [pa.array(key, pa.binary()), pa.array(text, pa.string()), pa.array(ks, pa.int32()), pa.array(spelling, pa.string()), table["schema"], table["field"], table["count"]]
            yield from pa.Table.from_arrays(columns, names=["key", "token", "k", "spelling", "schema", "field", "count"]).to_batches()

    schema = "key binary, token string, k int, spelling string, schema string, field string, count bigint"
    keyed = rows.mapInArrow(normalise, schema).withColumn("salt", F.when(F.col("k") >= 0, F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int"))
    return keyed.repartition("token", "k", "salt").distinct().groupBy("key", "token", "k", "salt").agg(F.sum("count").alias("count"))


def records_of(entries: DataFrame) -> int:
    """The number of records with any occurrence."""
    return valid(entries).select("id").distinct().count()


def named(frame: DataFrame, heavy: list[str]) -> DataFrame:
    """The frame with the text of heavy terms in place of their numbers."""
    texts = F.array(*[F.lit(t) for t in heavy]) if heavy else F.array(F.lit(None).cast("string"))
    return frame.withColumn("token", F.coalesce("token", F.when(F.col("k") >= 0, F.get(texts, F.col("k"))))).drop("k")


def marked_terms(entries: DataFrame, common_share: float = 0.05) -> DataFrame:
    """(token, records, total, mark): marked ``rare`` (one record), ``common`` (more than the share of all records) or null."""
    heavy = heavy_terms(entries)
    parts = occurrences(entries, heavy).groupBy("token", "k", "salt").agg(F.count("*").alias("records"), F.sum("count").alias("total"))
    parts = Scratch(entries.sparkSession, "terms").keep(parts)
    hot = parts.where("k >= 0").groupBy("k").agg(F.sum("records").alias("records"), F.sum("total").alias("total")).withColumn("token", F.lit(None).cast("string"))
    counts = named(parts.where("k < 0").drop("salt").unionByName(hot), heavy)
    n = records_of(entries)
    return counts.withColumn("mark", F.when(F.col("records") == 1, "rare").when(F.col("records") > common_share * n, "common"))
