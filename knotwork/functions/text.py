"""String expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values people write where they know nothing. Fixed values.
FILLERS = ("", "-", "?", "??", "00", "n/a", "n.n.", "k. a.", "tba", "xxx", "unknown", "none given", "not stated", "нет данных")


def squeeze(value: Column) -> Column:
    """Outer white space of any Unicode kind removed."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def states_nothing(value: Column) -> Column:
    """True where the value is null or a filler, whatever its case and inner spacing."""
    plain = F.lower(F.regexp_replace(squeeze(value), r"(?U)\s+", " "))
    return value.isNull() | plain.isin(*FILLERS) | ~plain.rlike(r"[\p{L}\p{N}]")
