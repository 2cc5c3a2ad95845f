"""Tokens of statements, and training and evaluation over pairs labelled by their canonical ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import matching as M
from knotwork.operators import tokens as T
from knotwork.operators import training as R
from knotwork.operators.ontology import matchable
from knotwork.plans import matching as P
from knotwork.plans.registry import Registry
from knotwork.session import Scratch
from knotwork.sources.tables import table

REGISTRY = Registry()


def _in(names: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_WORDS = f"string_split({P.clean('value')}, ' ')"
_LEGAL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LEGAL.items()) + " END"
TOKENS = f"""
WITH v AS (SELECT DISTINCT "schema" AS s, canonical_id AS id, prop, value FROM statements WHERE canonical_id IS NOT NULL AND value IS NOT NULL AND "schema" IN {_in(matchable())}
), wd AS (SELECT s, id, prop, value, unnest({_WORDS}) AS w FROM v
), t AS (
  SELECT DISTINCT s, id, 'np' AS field, 'np:' || w AS token, 1 AS k, value FROM wd WHERE prop IN {_in(T._of_type("name"))} AND length(w) BETWEEN 3 AND 30 AND w NOT IN {_in(T.STOPWORDS)} AND w NOT IN {_in(list(T.LEGAL))}
  UNION ALL SELECT s, id, 'name', 'n:' || f, 1, value FROM (SELECT s, id, value, array_to_string(list_sort(list_distinct(list_filter({_WORDS}, lambda w: w <> ''))), '') AS f FROM v WHERE prop IN {_in(T._of_type("name"))}) WHERE length(f) > 3 AND length(f) < 200
  UNION ALL SELECT DISTINCT s, id, 'sy', 'sy:ORG:' || {_LEGAL}, 1, value FROM wd WHERE prop IN {_in(T._of_type("name"))} AND w IN {_in(list(T.LEGAL))}
  UNION ALL SELECT s, id, 'wd', 'wd:' || w, 1, value FROM wd WHERE prop IN {_in(T._of_type("text", "string", "identifier"))} AND length(w) >= 6 AND w NOT IN {_in(T.STOPWORDS)}
  UNION ALL SELECT s, id, 'identifier', 'i:' || f, 1, value FROM (SELECT s, id, value, regexp_replace(upper(value), '[^A-Z0-9]', '', 'g') AS f FROM v WHERE prop IN {_in(T._of_type("identifier"))}) WHERE f <> ''
  UNION ALL SELECT s, id, 'date', 'd:' || value[1:10], 1, value FROM v WHERE prop IN {_in(T._of_type("date"))}
  UNION ALL SELECT s, id, 'address', 'a:' || w, 1, value FROM wd WHERE prop IN {_in(T._of_type("address"))} AND length(w) >= 4 AND w NOT IN {_in(T.STOPWORDS)}
  UNION ALL SELECT s, id, 'wd', 'wd:' || w, 1, value FROM wd WHERE prop IN {_in(T._of_type("address"))} AND length(w) >= 7 AND w NOT IN {_in(T.STOPWORDS)}
  UNION ALL SELECT s, id, 'country', 'c:' || lower(value[1:300]), 1, value FROM v WHERE prop IN {_in(T._of_type("country"))}
  UNION ALL SELECT s, id, 'phone', 'p:' || lower(value[1:300]), 1, value FROM v WHERE prop IN {_in(T._of_type("phone"))}
  UNION ALL SELECT s, id, 'email', 'email:' || lower(value[1:300]), 1, value FROM v WHERE prop IN {_in(T._of_type("email"))}
)
SELECT s AS "schema", id, field, token[1:40] AS token, CASE WHEN field IN ('wd', 'address') THEN count(*) ELSE 1 END::INT AS "count" FROM t GROUP BY s, id, field, token[1:40]
"""


@REGISTRY.query("tok_entries", TOKENS)
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokenise(table(spark, sf_dir, "statements"))


@REGISTRY.query("tok_fields", f"SELECT field, count(*) AS n, count(DISTINCT token) AS tokens, sum(\"count\")::BIGINT AS occurrences FROM ({TOKENS}) GROUP BY field")
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokenise(table(spark, sf_dir, "statements")).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("token").alias("tokens"), F.sum("count").alias("occurrences"))


@REGISTRY.query("trn_partitions", "SELECT canonical_id AS cluster, CASE WHEN ('0x' || substr(sha256('42:' || canonical_id), 1, 16))::UBIGINT::DOUBLE / pow(2, 64) < 0.3 THEN 'test' ELSE 'train' END AS \"partition\" FROM (SELECT DISTINCT canonical_id FROM statements WHERE canonical_id IS NOT NULL)")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "statements").where("canonical_id IS NOT NULL").select(F.col("canonical_id").alias("cluster")).distinct()
    return ids.withColumn("partition", R.partition_of(F.col("cluster")))


_LABELLED = f"""{P.BASE}, own AS (SELECT entity_id, max(canonical_id) AS c FROM statements WHERE "schema" IN ('Person', 'Company', 'Organization') AND value IS NOT NULL GROUP BY 1)
, lb AS (SELECT x.*, (a.c = b.c)::INT AS y, a.c AS lc, b.c AS rc FROM x JOIN own a ON a.entity_id = l JOIN own b ON b.entity_id = r)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share an address or contact, labelled positive if they have one canonical id."""
    rows = table(spark, sf_dir, "statements").where(F.col("schema").isin("Person", "Company", "Organization") & F.col("value").isNotNull())
    own = rows.groupBy("entity_id").agg(F.max("canonical_id").alias("c"))
    both = P.pairs(spark, sf_dir).join(own.select(F.col("entity_id").alias("left"), F.col("c").alias("left_cluster")), "left").join(own.select(F.col("entity_id").alias("right"), F.col("c").alias("right_cluster")), "right")
    return both.withColumn("judgement", F.when(F.col("left_cluster") == F.col("right_cluster"), "positive").otherwise("negative"))


_PART = lambda c: f"CASE WHEN ('0x' || substr(sha256('42:' || {c}), 1, 16))::UBIGINT::DOUBLE / pow(2, 64) < 0.3 THEN 'test' ELSE 'train' END"


@REGISTRY.query(
    "trn_scan_report",
    _LABELLED
    + f""" SELECT CASE WHEN NOT {P._GATE} THEN 'schema_pair' WHEN {_PART("lc")} <> {_PART("rc")} THEN 'cross_partition' ELSE 'accepted' END AS skip, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS label, count(*) AS n FROM lb GROUP BY ALL""",
)
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan_report(R.scan(judged(spark, sf_dir)))


@REGISTRY.query(
    "trn_dataset",
    _LABELLED
    + f""", snap AS (SELECT entity_id AS id, string_agg(DISTINCT prop || chr(1) || value, chr(2) ORDER BY prop || chr(1) || value) AS p FROM statements WHERE "schema" IN {P._KIND_SQL} AND value IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1
), d AS (SELECT min(y) AS y, min({_PART("lc")}) AS part FROM lb JOIN snap a ON a.id = l JOIN snap b ON b.id = r WHERE {P._GATE} AND {_PART("lc")} = {_PART("rc")} GROUP BY q.s, a.p, e.s, b.p HAVING min(y) = max(y) AND min({_PART("lc")}) = max({_PART("lc")}))
SELECT part AS "partition", y, count(*) AS n FROM d GROUP BY ALL""",
)
def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many snapshots of pairs there are to train and to test on: equal snapshots are one, contradictory ones none."""
    return R.dataset(R.scan(judged(spark, sf_dir))).groupBy("partition", "y").agg(F.count("*").alias("n"))


_SCORED = f"{_LABELLED}, sc AS (SELECT y, q.s AS s, round(CASE WHEN {P._GATE} AND ({P.FEATURES['ofac_name_score']}) > 0 THEN greatest(0.0, least(1.0, ({P.FEATURES['ofac_name_score']}) + " + " + ".join(f"({v}) * ({P.FEATURES[n]})" for n, v in P._QUAL.items()) + ")) ELSE 0.0 END::DOUBLE, 5) AS score FROM lb)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.SANCTION_SEARCH.score(judged(spark, sf_dir))
    return rows.select(F.when(F.col("judgement") == "positive", 1).otherwise(0).alias("y"), F.col("l.schema").alias("schema"), F.round("score", 5).alias("score"))


@REGISTRY.query(
    "evl_confusion",
    _SCORED
    + """, c AS (SELECT s AS "group", threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn
  FROM sc, (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) AS t(threshold) GROUP BY ALL)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.confusion(_scored(spark, sf_dir), by="schema")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@REGISTRY.query("evl_losses", _SCORED + """ SELECT s AS "group", count(*) AS n, round(avg(pow(y - score, 2)), 6) AS brier, round(avg(abs(y - score)), 6) AS mean_error FROM sc GROUP BY s""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.losses(_scored(spark, sf_dir), by="schema")
    return out.select("group", "n", F.round("brier", 6).alias("brier"), F.round("mean_error", 6).alias("mean_error"))


@REGISTRY.query(
    "evl_calibration",
    _SCORED + """, b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 4) AS mean_score, avg(y) AS sh FROM sc GROUP BY 1) SELECT bin, n, mean_score, round(sh, 4) AS "share", coalesce(sh >= lag(sh) OVER (ORDER BY bin), true) AS grows FROM b""",
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.calibration(_scored(spark, sf_dir))
    return out.select("bin", "n", F.round("mean_score", 4).alias("mean_score"), F.round("share", 4).alias("share"), "grows")


@REGISTRY.query("agg_score_summary", _SCORED + " SELECT count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS greatest FROM sc")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def _fitted(spark: SparkSession, sf_dir: str, features: dict, name: str, *, search: bool = False) -> DataFrame:
    data = Scratch(spark, "vectors").keep(R.vectors(R.dataset(R.scan(judged(spark, sf_dir))), features))
    model = R.choose(data, name, features)[0] if search else R.fit(data, name, features)
    scored = R.apply(model, data.where("partition = 'test'"))
    areas = R.areas(scored)
    rows = R.losses(scored).select(F.lit("log_loss").alias("metric"), "log_loss").union(R.losses(scored).select(F.lit("brier"), "brier"))
    extra = spark.createDataFrame(list(areas.items()), "metric string, value double")
    return rows.toDF("metric", "value").unionByName(extra)


@REGISTRY.query("trn_regression_v1")
def regression_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first regression scorer, fitted and tested."""
    return _fitted(spark, sf_dir, M.REGRESSION_V1, "regression-v1")


@REGISTRY.query("trn_entity_regression")
def entity_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second regression scorer, its penalty chosen by cross-validation, fitted and tested."""
    return _fitted(spark, sf_dir, M.ENTITY_REGRESSION, "entity-regression", search=True)
