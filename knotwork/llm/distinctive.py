"""How distinctive a term is for a record.

Method: residual inverse document frequency, the observed value ln(N / records) less the value -ln(1 - exp(-total / N))
that a Poisson spread of the term's collection frequency would give, multiplied by the frequency in the record. Terms that
are too common to help (``frequency.marked_terms``) have small residuals, which a very high frequency in one record can
outweigh: they lead only records that have no other term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions.keys import unpack
from knotwork.llm.frequency import heavy_terms, named, occurrences, records_of
from knotwork.session import Scratch


def scored_terms(entries: DataFrame) -> DataFrame:
    """(key, token, count, records, idf, score) of every term of every record; key is the packed record id.

    One shuffle by term, heavy terms dealt by record, serves repeats, counts and their join to the records: a window adds each
    term's counts to its rows where they lie, and heavy terms get the sum of their parts by broadcast (at most
    ``frequency.HEAVY`` rows). Rows that are no occurrence are left out, see ``frequency.occurrences``; an empty table gives no
    rows.
    """
    heavy = heavy_terms(entries)
    part = W.partitionBy("token", "k", "salt")
    pairs = occurrences(entries, heavy).withColumns({"records": F.count("*").over(part), "total": F.sum("count").over(part)})
    pairs = Scratch(entries.sparkSession, "scored").keep(pairs)
    n = float(records_of(entries))
    if heavy:
        parts = pairs.where("k >= 0").select("k", "salt", "records", "total").distinct()
        sums = parts.groupBy("k").agg(F.sum("records").alias("all"), F.sum("total").alias("whole"))
        pairs = pairs.join(F.broadcast(sums), "k", "left").withColumns({"records": F.coalesce("all", "records"), "total": F.coalesce("whole", "total")}).drop("all", "whole")
    idf = F.log(F.lit(n) / F.col("records"))
    residual = idf + F.log(-F.expm1(-F.col("total") / F.lit(n)))
    return named(pairs, heavy).select("key", "token", "count", "records", idf.alias("idf"), (F.col("count") * residual).alias("score"), (F.col("records") / F.lit(n)).alias("share"))


def leading_terms(entries: DataFrame, common_share: float = 0.05) -> DataFrame:
    """(record_id, token, score): the best term of each record that is not in more than the share of all records, or the best
    of all where a record has only such; equal scores: the greater count times idf, then the greater token."""
    order = F.struct((F.col("share") <= common_share).alias("telling"), F.col("score"), (F.col("count") * F.col("idf")).alias("weight"), "token")
    best = scored_terms(entries).groupBy("key").agg(F.max(order).alias("top"))
    return best.select(unpack(F.col("key")).alias("record_id"), F.col("top.token").alias("token"), F.col("top.score").alias("score"))
