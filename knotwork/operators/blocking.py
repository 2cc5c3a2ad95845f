"""Token-weighted blocking: ranked candidate pairs within a collection, and ranked matches for subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.operators.ontology import schema_pairs
from knotwork.session import Scratch

#: Weight of a token by its field; any other field counts 1. Fixed values.
BOOSTS = {"np": 5.0, "wd": 0.5, "name": 15.0, "phone": 10.0, "email": 10.0, "address": 1.0, "identifier": 10.0}
#: Holders a token may have before its pairs cost too much.
BUCKET = 60
#: Most candidates of a subject, and the least share of its best score.
MAX_CANDIDATES, MIN_SCORE_RATIO = 75, 0.1


def pair_cost(bucket: int) -> int:
    """Most pairs a token may give within a collection."""
    if bucket < 0:
        raise ValueError("the bucket size must not be negative")
    return bucket * (bucket - 1) // 2


def token_entries(rows: DataFrame) -> DataFrame:
    """Clean (schema, id, field, token, count): each row once, without null ids or tokens and counts below one."""
    return rows.select("schema", "id", "field", "token", "count").where("id IS NOT NULL AND token IS NOT NULL AND `count` >= 1").distinct()


def token_schema_counts(entries: DataFrame) -> DataFrame:
    """(token, schema, field, df, freq): holders and occurrences of each token by schema."""
    return entries.groupBy("token", "schema").agg(F.min("field").alias("field"), F.count("*").alias("df"), F.sum("count").alias("freq"))


def unordered_schema_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def token_costs(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(token, field, freq, df, cost, stopword): what joining a token with itself costs over compatible schemata.

    A token has one row per schema here, so the self-join is tiny whatever the token's number of holders.
    """
    counts = token_schema_counts(entries)
    left = counts.select("token", F.col("schema").alias("left"), F.col("df").alias("ldf"))
    right = counts.select("token", F.col("schema").alias("right"), F.col("df").alias("rdf"))
    same = F.floor(F.col("ldf") * (F.col("ldf") - 1) / 2)
    cost = F.when(F.col("left") == F.col("right"), same).otherwise(F.col("ldf") * F.col("rdf"))
    pairs = F.broadcast(unordered_schema_pairs(schema_pairs(entries.sparkSession)))
    compatible = left.join(right, "token").where("left <= right").join(pairs, ["left", "right"]).groupBy("token").agg(F.sum(cost).alias("cost"))
    totals = counts.groupBy("token").agg(F.min("field").alias("field"), F.sum("freq").alias("freq"), F.sum("df").alias("df"))
    joined = totals.join(compatible, "token", "left").withColumn("cost", F.coalesce("cost", F.lit(0)).cast("long"))
    return joined.withColumn("stopword", F.col("cost") > pair_cost(bucket))


def match_costs(subjects: DataFrame, index: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(token, cost, stopword): what joining a token of the subjects with the whole index costs."""
    left = token_schema_counts(subjects).select("token", F.col("schema").alias("left"), F.col("df").alias("ldf"))
    right = token_schema_counts(index).select("token", F.col("schema").alias("right"), F.col("df").alias("rdf"))
    pairs = F.broadcast(schema_pairs(subjects.sparkSession))
    cost = left.join(right, "token").join(pairs, ["left", "right"]).groupBy("token").agg(F.sum(F.col("ldf") * F.col("rdf")).alias("cost"))
    every = left.select("token").distinct().join(cost, "token", "left").withColumn("cost", F.coalesce("cost", F.lit(0)).cast("long"))
    return every.withColumn("stopword", F.col("cost") > bucket * bucket)


def drop_stopwords(rows: DataFrame, costs: DataFrame) -> DataFrame:
    return rows.join(costs.where("stopword").select("token"), "token", "left_anti")


def _boost(field: Column) -> Column:
    value = F.lit(1.0)
    for name, boost in BOOSTS.items():
        value = F.when(field == name, boost).otherwise(value)
    return value


def term_weights(entries: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(schema, field, token, id, weight): inverse document frequency times boost; parts of names are damped by their number.

    rows: the entries to be weighed, if not all of those that are counted.
    """
    n = entries.select(F.countDistinct("id").cast("double").alias("n")).scalar()
    idf = entries.groupBy("token").agg((1.0 + F.log(n / F.countDistinct("id"))).alias("idf"))
    names = entries.where(F.col("field") == "name").groupBy("id").agg(F.greatest(F.lit(1), F.sum("count")).alias("n_names"))
    joined = (entries if rows is None else rows).join(idf, "token").join(names, "id", "left")
    plain = _boost(F.col("field")) * F.col("idf")
    weight = F.when(F.col("field").isin("np", "sy"), plain / F.sqrt(F.coalesce("n_names", F.lit(1)).cast("double"))).otherwise(plain)
    return joined.select("schema", "field", "token", "id", weight.alias("weight"))


def candidate_pairs(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(lid, rid, score), lid > rid: evidence of shared tokens, with logarithmic credit for several of one field.

    Tokens whose pairs cost more than the bucket allows are left out before the join, so no token joins more than
    ``pair_cost(bucket)`` pairs.
    """
    entries = Scratch(entries.sparkSession, "blocking").keep(entries)  # counted three times and joined
    terms = term_weights(entries, drop_stopwords(entries, token_costs(entries, bucket)))
    side = lambda p: terms.select("token", "field", F.col("id").alias(f"{p}id"), F.col("schema").alias(p), F.col("weight").alias(f"{p}w"))
    left = side("l").withColumnRenamed("l", "left")
    right = side("r").withColumnRenamed("r", "right")
    joined = left.join(right, ["token", "field"]).where("lid > rid").join(F.broadcast(schema_pairs(entries.sparkSession)), ["left", "right"])
    fields = joined.groupBy("lid", "rid", "field").agg(F.max(F.col("lw") + F.col("rw")).alias("w"), F.count("*").alias("n"))
    return fields.groupBy("lid", "rid").agg(F.sum(F.col("w") * (1.0 + F.log(F.col("n").cast("double")))).alias("score"))


def top_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "lid", "rid").limit(limit)


def subject_matches(subjects: DataFrame, index: DataFrame, *, bucket: int = BUCKET, max_candidates: int = MAX_CANDIDATES, min_score_ratio: float = MIN_SCORE_RATIO) -> DataFrame:
    """(matching_id, matches_id, score, rank): each subject's best candidates of the index, with a relative floor."""
    scratch = Scratch(subjects.sparkSession, "blocking")
    index, subjects = scratch.keep(index), scratch.keep(subjects)
    kept = drop_stopwords(subjects, match_costs(subjects, index, bucket)).select("token", "field", F.col("id").alias("matching_id"), F.col("schema").alias("left"))
    asked = index.join(kept.select("token", "field").distinct(), ["token", "field"], "left_semi")
    terms = term_weights(index, asked).select("token", "field", F.col("id").alias("matches_id"), F.col("schema").alias("right"), "weight")
    joined = kept.join(terms, ["token", "field"]).where("matching_id <> matches_id").join(F.broadcast(schema_pairs(subjects.sparkSession)), ["left", "right"])
    fields = joined.groupBy("matching_id", "matches_id", "field").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
    # rounded, so that ranks do not hang on the order in which a sum was made
    scored = fields.groupBy("matching_id", "matches_id").agg(F.round(F.sum(F.col("w") * (1.0 + F.log(F.col("n").cast("double")))), 6).alias("score"))
    window = W.partitionBy("matching_id").orderBy(F.desc("score"), "matches_id")
    ranked = scored.withColumn("rank", F.row_number().over(window)).withColumn("best", F.first("score").over(window))
    return ranked.where((F.col("rank") <= max_candidates) & (F.col("score") >= F.col("best") * min_score_ratio)).drop("best")


def stopword_profile(costs: DataFrame) -> DataFrame:
    """One row of numbers on kept and dropped tokens."""
    s = F.col("stopword")
    when = lambda condition, value: F.when(condition, value)
    return costs.agg(
        F.count("*").alias("tokens"),
        F.coalesce(F.sum(when(s, 1)), F.lit(0)).alias("stopwords"),
        F.coalesce(F.sum(when(s, F.col("df"))), F.lit(0)).alias("stopword_holders"),
        F.coalesce(F.sum(when(s, F.col("cost"))), F.lit(0)).alias("stopword_cost"),
        F.coalesce(F.sum(when(~s, F.col("cost"))), F.lit(0)).alias("kept_cost"),
        F.max(when(~s, F.col("cost"))).alias("kept_max_cost"),
        F.max(when(~s, F.col("df"))).alias("kept_max_df"),
        F.min(when(s, F.col("cost"))).alias("stopword_min_cost"),
    )


def pair_profile(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row on the input of the pair join: rows, entities, tokens, and its cost."""
    costs = token_costs(entries, bucket)
    kept = drop_stopwords(entries, costs).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("entities"), F.countDistinct("token").alias("tokens"))
    cost = costs.where("NOT stopword").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("pairs"), F.coalesce(F.max("cost"), F.lit(0)).alias("max_cost"))
    return kept.join(F.broadcast(cost), how="cross")  # one row with one row
