"""Attribute-value rows into wide, typed tables.

Method: rows are reduced to the one deciding row per entity and attribute before anything is gathered, attributes are
encoded as column indices, the reduced rows are partitioned and sorted by entity, and sorted Arrow batches stream
through a builder that scatters values into typed column buffers with validity masks. An entity never has more rows in
a task than there are attributes, however many rows it has in the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark type of each kind of column, and the Arrow type of its buffer.
KINDS: dict[str, tuple[T.DataType, pa.DataType]] = {
    "string": (T.StringType(), pa.string()),
    "long": (T.LongType(), pa.int64()),
    "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "date": (T.DateType(), pa.date32()),
}


@dataclass(frozen=True)
class Attribute:
    """An output column: the attribute it is read from, its kind, and the expression that reads the raw value."""

    column: str
    attribute: str
    kind: str = "string"
    read: Callable[[Column], Column] | None = None


def _builder(names: list[str], kinds: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [KINDS[k][1] for k in kinds]

    def build(entity: pa.Array, index: np.ndarray, value: pa.Array, starts: np.ndarray) -> pa.RecordBatch:
        row = np.cumsum(starts) - 1
        n = int(row[-1]) + 1
        columns: list[pa.Array] = [entity.take(pa.array(np.flatnonzero(starts)))]
        for k, kind in enumerate(types):
            here = np.flatnonzero(index == k)
            source = np.zeros(n, dtype=np.int64)
            empty = np.ones(n, dtype=bool)
            source[row[here]] = here
            empty[row[here]] = False
            taken = value.take(pa.array(source, mask=empty))
            columns.append(taken if kind == pa.string() else taken.cast(kind))
        return pa.RecordBatch.from_arrays(columns, names=["entity", *names])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            entity = table.column(0).combine_chunks()
            starts = np.ones(table.num_rows, dtype=bool)
            starts[1:] = pc.not_equal(entity.slice(1), entity.slice(0, len(entity) - 1)).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(starts)[-1])
            rest = table.slice(last)
            if last:
                head = table.slice(0, last)
                yield build(entity.slice(0, last), head.column(1).to_numpy(), head.column(2).combine_chunks(), starts[:last])
        if rest is not None:
            entity = rest.column(0).combine_chunks()
            starts = np.zeros(rest.num_rows, dtype=bool)
            starts[0] = True
            yield build(entity, rest.column(1).to_numpy(), rest.column(2).combine_chunks(), starts)

    return stream


def attributes_to_columns(
    rows: DataFrame, attributes: list[Attribute], *, entity: str = "entity_id", attribute: str = "prop", value: str = "value", latest: list[str] | None = None
) -> DataFrame:
    """One row per entity with a typed, nullable column per attribute.

    rows: attribute-value rows; only the named columns are read, others may have any name. latest: columns whose
    greatest values decide among several rows of one attribute (nulls lose; remaining ties go to the greater value).
    Defined cases: rows without entity are left out; null values and rows of other attributes give their entity a row
    but no value; unreadable values give null; repeated rows change nothing; an empty table gives an empty table with
    the same columns. Two attributes may not share a column name.
    """
    names = [a.column for a in attributes]
    if len(set(names)) != len(names):
        raise ValueError("column names must differ")
    index = F.lit(-1)
    for k, a in enumerate(attributes):
        index = F.when((F.col(attribute) == a.attribute) & F.col(value).isNotNull(), F.lit(k)).otherwise(index)
    order = F.struct(*[F.col(c) for c in latest or []], F.col(value))
    deciding = (
        rows.where(F.col(entity).isNotNull())
        .select(F.col(entity).cast("string").alias("_e"), index.alias("_k"), order.alias("_o"), F.col(value).cast("string").alias("_v"))
        .groupBy("_e", "_k")
        .agg(F.max_by("_v", "_o").alias("_v"))
    )
    raw, typed = F.col("_v"), F.lit(None).cast("string")
    for k, a in enumerate(attributes):
        typed = F.when(F.col("_k") == k, (a.read(raw) if a.read else raw).cast("string")).otherwise(typed)
    read = deciding.select("_e", "_k", typed.alias("_v")).repartition("_e").sortWithinPartitions("_e", "_k")
    schema = T.StructType([T.StructField("entity", T.StringType()), *[T.StructField(a.column, KINDS[a.kind][0]) for a in attributes]])
    wide = read.mapInArrow(_builder(names, [a.kind for a in attributes]), schema)
    return wide.select(F.col("entity").alias(entity), *[F.col(n) for n in names])
