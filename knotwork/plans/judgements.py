"""Decisions of the resolver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import judgements as J
from knotwork.plans.registry import Registry
from knotwork.session import Scratch
from knotwork.sources.tables import table

REGISTRY = Registry()

_W = "(CASE WHEN regexp_matches({0}, '^Q\\d+$') THEN 3 WHEN starts_with({0}, 'NK-') THEN 2 ELSE 1 END)"


def w(column: str) -> str:
    return _W.format(column)


BASE = f"""
WITH RECURSIVE raw AS (
  SELECT DISTINCT CASE WHEN ({w("source")}, source) > ({w("target")}, target) THEN source ELSE target END AS target,
    CASE WHEN ({w("source")}, source) > ({w("target")}, target) THEN target ELSE source END AS source,
    lower(trim(judgement)) AS judgement, score, "user", created_at, deleted_at FROM resolver WHERE source <> target
), live AS (
  SELECT target, source, judgement, score, "user", created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY target, source ORDER BY created_at DESC, judgement DESC, score DESC NULLS LAST, "user" DESC) AS k FROM raw WHERE deleted_at IS NULL) WHERE k = 1
), way AS (SELECT target AS u, source AS v FROM live WHERE judgement = 'positive' UNION SELECT source, target FROM live WHERE judgement = 'positive'
), reach AS (SELECT u AS n, u AS m FROM way UNION SELECT r.n, way.v FROM reach r JOIN way ON r.m = way.u
), lab AS (SELECT n AS node, min(m) AS label, max_by(m, ({w("m")}, m)) AS head FROM reach GROUP BY n
), linker AS (SELECT node, label, head, CASE WHEN {w("head")} > 1 THEN head ELSE node END AS canonical_id FROM lab
), span AS (
  SELECT e.*, least(coalesce(a.label, e.source), coalesce(b.label, e.target)) AS x, greatest(coalesce(a.label, e.source), coalesce(b.label, e.target)) AS y
  FROM live e LEFT JOIN lab a ON a.node = e.source LEFT JOIN lab b ON b.node = e.target
), block AS (SELECT x, y, min(judgement) AS blocker FROM span WHERE judgement IN ('negative', 'unsure') AND x <> y GROUP BY x, y
), sugg AS (SELECT source AS l, target AS r FROM live WHERE judgement = 'no_judgement'
), judged AS (
  SELECT l, r, CASE WHEN l = r OR ll = rl THEN 'positive' WHEN {w("l")} = 3 AND {w("r")} = 3 THEN 'negative' ELSE coalesce(blocker, 'no_judgement') END AS judgement
  FROM (SELECT l, r, coalesce(a.label, l) AS ll, coalesce(b.label, r) AS rl FROM sugg LEFT JOIN lab a ON a.node = l LEFT JOIN lab b ON b.node = r) p
  LEFT JOIN block ON x = least(ll, rl) AND y = greatest(ll, rl))
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "resolver")


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.suggestions(_edges(spark, sf_dir)).select(F.col("source").alias("left"), F.col("target").alias("right"))


@REGISTRY.query("gra_live_edges", BASE + 'SELECT target, source, judgement, score, "user", created_at FROM live')
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.live(_edges(spark, sf_dir))


@REGISTRY.query("gra_identifiers", BASE + f"SELECT DISTINCT u AS id, {w('u')} AS weight, {w('u')} > 1 AS canonical FROM (SELECT target AS u FROM raw UNION SELECT source FROM raw)")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = J.paired(_edges(spark, sf_dir)).select(F.explode(F.array("target", "source")).alias("id")).distinct()
    return ids.select("id", J.weight(F.col("id")).alias("weight"), J.is_canonical(F.col("id")).alias("canonical"))


@REGISTRY.query(
    "gra_merge",
    BASE
    + """SELECT a.judgement AS left_judgement, b.judgement AS right_judgement, CASE WHEN a.judgement = 'positive' AND b.judgement = 'positive' THEN 'positive'
  WHEN least(a.judgement, b.judgement) = 'negative' AND greatest(a.judgement, b.judgement) = 'positive' THEN 'negative' ELSE 'unsure' END AS merged, count(*) AS n
  FROM live a JOIN live b ON a.target = b.target AND a.source < b.source WHERE a.target NOT IN (SELECT target FROM live GROUP BY 1 HAVING count(*) > 50) GROUP BY ALL""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of two edges that share a target, merged; targets with more than 50 edges have too many pairs."""
    rows = J.live(_edges(spark, sf_dir)).select("target", "source", "judgement")
    many = rows.groupBy("target").count().where("count > 50").select("target")
    rows = rows.join(many, "target", "left_anti")
    left = rows.select("target", F.col("source").alias("a"), F.col("judgement").alias("left_judgement"))
    right = rows.select("target", F.col("source").alias("b"), F.col("judgement").alias("right_judgement"))
    both = left.join(right, "target").where("a < b")
    return both.withColumn("merged", J.merge(F.col("left_judgement"), F.col("right_judgement"))).groupBy("left_judgement", "right_judgement", "merged").agg(F.count("*").alias("n"))


@REGISTRY.query("gra_linker", BASE + "SELECT node, canonical_id, head FROM linker")
def linker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.linker(_edges(spark, sf_dir))


@REGISTRY.query("gra_canonicals", BASE + f"SELECT DISTINCT head AS canonical_id FROM lab WHERE {w('head')} > 1")
def canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.canonicals(J.linker(_edges(spark, sf_dir)))


@REGISTRY.query("gra_referents", BASE + f"SELECT head AS canonical_id, node AS referent FROM lab WHERE {w('head')} > 1 AND node <> head AND {w('node')} = 1")
def referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.referents(J.linker(_edges(spark, sf_dir)), with_canonicals=False)


@REGISTRY.query("gra_judge_pairs", BASE + 'SELECT l AS "left", r AS "right", judgement FROM judged')
def judge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.judge(_suggested(spark, sf_dir), _edges(spark, sf_dir))


@REGISTRY.query(
    "gra_resolved_edges",
    BASE
    + """SELECT l AS "left", r AS "right", e.target, e.source, e.judgement FROM (SELECT l, r, coalesce(a.label, l) AS ll, coalesce(b.label, r) AS rl FROM sugg LEFT JOIN lab a ON a.node = l LEFT JOIN lab b ON b.node = r) p
  JOIN (SELECT x, y, unnest(min({'target': target, 'source': source, 'judgement': judgement})) FROM span GROUP BY x, y) e ON x = least(ll, rl) AND y = greatest(ll, rl)""",
)
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resolved_edges(_suggested(spark, sf_dir), _edges(spark, sf_dir))


@REGISTRY.query(
    "top_candidates",
    BASE + "SELECT target, source, score FROM live JOIN judged ON l = source AND r = target WHERE live.judgement = 'no_judgement' AND judged.judgement = 'no_judgement' ORDER BY score DESC NULLS LAST, target, source LIMIT 100",
)
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.candidates(_edges(spark, sf_dir), 100)


@REGISTRY.query(
    "top_next_pair",
    BASE + "SELECT target, source, score FROM live JOIN judged ON l = source AND r = target WHERE live.judgement = 'no_judgement' AND judged.judgement = 'no_judgement' ORDER BY score DESC NULLS LAST, target, source LIMIT 1 OFFSET 7",
)
def top_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next pair to review when the first seven were put off, some with their ends exchanged."""
    edges = Scratch(spark, "edges").keep(_edges(spark, sf_dir))
    first = Scratch(spark, "first").keep(J.candidates(edges, 7))
    flip = F.col("score") > 0.5
    return J.next_pair(edges, first.select(F.when(flip, F.col("source")).otherwise(F.col("target")).alias("target"), F.when(flip, F.col("target")).otherwise(F.col("source")).alias("source")))


@REGISTRY.query("top_recent_judgements", BASE + "SELECT target, source, judgement, created_at FROM live WHERE judgement <> 'no_judgement' ORDER BY created_at DESC, target, source LIMIT 50")
def top_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent(_edges(spark, sf_dir), 50).select("target", "source", "judgement", "created_at")


_NOW = "2030-01-01T00:00:00.000000Z"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best suggestions as positive decisions, the worst as negative ones."""
    rows = J.suggestions(_edges(spark, sf_dir))
    verdict = F.when(F.col("score") >= 0.7, J.POSITIVE).when(F.col("score") <= 0.2, J.NEGATIVE)
    return rows.select(F.col("source").alias("left"), F.col("target").alias("right"), verdict.alias("judgement")).where("judgement IS NOT NULL")


_DECIDE = (
    BASE
    + f""", dec AS (SELECT source AS l, target AS r, CASE WHEN score >= 0.7 THEN 'positive' ELSE 'negative' END AS judgement FROM live WHERE judgement = 'no_judgement' AND (score >= 0.7 OR score <= 0.2)
), way2 AS (SELECT u, v FROM way UNION SELECT l, r FROM dec WHERE judgement = 'positive' UNION SELECT r, l FROM dec WHERE judgement = 'positive'
), reach2 AS (SELECT u AS n, u AS m FROM way2 UNION SELECT q.n, way2.v FROM reach2 q JOIN way2 ON q.m = way2.u
), grp AS (SELECT n, max_by(m, ({w("m")}, m)) AS top, 'NK-' || substr(sha256(min(m)), 1, 22) AS mint FROM reach2 GROUP BY n
), fresh AS (
  SELECT target, source, judgement FROM (SELECT r AS target, l AS source, judgement FROM dec WHERE judgement <> 'positive' UNION SELECT r, l, judgement FROM dec JOIN grp ON n = l WHERE judgement = 'positive' AND {w("top")} > 1
    UNION SELECT mint, unnest([l, r]), judgement FROM dec JOIN grp ON n = l WHERE judgement = 'positive' AND {w("top")} = 1)
)
"""
)


@REGISTRY.query(
    "gra_decide",
    _DECIDE + "SELECT target, source, judgement FROM live WHERE (target, source) NOT IN (SELECT r, l FROM dec) AND (target, source) NOT IN (SELECT target, source FROM fresh) UNION ALL SELECT target, source, judgement FROM fresh",
)
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.live(J.decide(_edges(spark, sf_dir), _decisions(spark, sf_dir), now=_NOW, user="query")).select("target", "source", "judgement")


@REGISTRY.query(
    "gra_suggest",
    BASE
    + """SELECT target, source, judgement, CASE WHEN judgement = 'no_judgement' THEN 0.5 ELSE score END AS score FROM live""",
)
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live pair suggested anew with one score: only undecided ones take it."""
    pairs = J.live(_edges(spark, sf_dir)).select(F.col("source").alias("left"), F.col("target").alias("right"), F.lit(0.5).alias("score"))
    return J.suggest(_edges(spark, sf_dir), pairs, now=_NOW, user="query").select("target", "source", "judgement", "score")


_HEADS = f"SELECT DISTINCT head AS node FROM lab WHERE {w('head')} = 3"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.linker(_edges(spark, sf_dir)).where(J.weight(F.col("head")) == 3).select(F.col("head").alias("node")).distinct()


@REGISTRY.query("gra_remove", BASE + f", gone AS ({_HEADS}) SELECT target, source, judgement FROM live WHERE target NOT IN (SELECT node FROM gone) AND source NOT IN (SELECT node FROM gone)")
def remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.live(J.remove(_edges(spark, sf_dir), _items(spark, sf_dir), now=_NOW)).select("target", "source", "judgement")


@REGISTRY.query("gra_explode", BASE + f"SELECT node FROM lab WHERE {w('head')} = 3")
def explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.explode(_edges(spark, sf_dir), _items(spark, sf_dir), now=_NOW)[1]


@REGISTRY.query(
    "gra_rename",
    BASE + ", o AS (SELECT max(target) AS old FROM live WHERE judgement = 'positive') SELECT DISTINCT 'Q1' AS target, CASE WHEN target = old THEN source ELSE target END AS source, judgement FROM live, o WHERE target = old OR source = old",
)
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest positive target under another name: the edges that changed."""
    edges = _edges(spark, sf_dir)
    old = J.live(edges).where(F.col("judgement") == J.POSITIVE).agg(F.max("target").alias("t")).head().t
    after, _ = J.rename(edges, old or "", "Q1", now=_NOW)
    return J.live(after).where("target = 'Q1'").select("target", "source", "judgement")


@REGISTRY.query(
    "gra_prune",
    BASE
    + f""", a AS (SELECT e.*, canonical_id, judgement = 'positive' AND {w("target")} = 1 AND coalesce({w("canonical_id")}, 1) > 1 AS loose FROM live e LEFT JOIN linker ON node = target WHERE judgement <> 'no_judgement'
), k AS (SELECT target, source, judgement, created_at FROM a WHERE NOT loose UNION ALL SELECT canonical_id, end_, judgement, '{_NOW}' FROM (SELECT canonical_id, unnest([target, source]) AS end_, judgement FROM a WHERE loose) WHERE end_ <> canonical_id
), k1 AS (SELECT target, source, max_by(judgement, (created_at, judgement)) AS judgement, max(created_at) AS created_at FROM k GROUP BY target, source
), k2 AS (SELECT *, judgement = 'positive' AND {w("target")} > 1 AND {w("source")} > 1 AND created_at < '2022-01-01' AS old FROM k1
), mv AS (SELECT DISTINCT source AS node, canonical_id AS dest FROM k2 JOIN linker ON node = source WHERE old AND source <> canonical_id
), z AS (SELECT coalesce(t.dest, target) AS a, coalesce(s.dest, source) AS b, judgement, CASE WHEN t.dest IS NOT NULL OR s.dest IS NOT NULL THEN '{_NOW}' ELSE created_at END AS created_at
  FROM k2 LEFT JOIN mv t ON t.node = target LEFT JOIN mv s ON s.node = source WHERE NOT old)
SELECT target, source, max_by(judgement, (created_at, judgement)) AS judgement FROM (
  SELECT CASE WHEN ({w("a")}, a) > ({w("b")}, b) THEN a ELSE b END AS target, CASE WHEN ({w("a")}, a) > ({w("b")}, b) THEN b ELSE a END AS source, judgement, created_at FROM z WHERE a <> b) GROUP BY target, source""",
)
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.prune(_edges(spark, sf_dir), now=_NOW, cutoff="2022-01-01").select("target", "source", "judgement")


@REGISTRY.query("gra_refresh", BASE + "SELECT node, min(label) AS label FROM lab GROUP BY node")
def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the rows up to a time, brought up to date with the later ones, each under its least id."""
    edges, since = _edges(spark, sf_dir), "2022-01-01"
    deleted = F.when(F.col("deleted_at") <= since, F.col("deleted_at"))
    before = edges.where(F.col("created_at") <= since).withColumn("deleted_at", deleted)
    found = J.refreshed(J.clusters(before), edges, since)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))


@REGISTRY.query(
    "jn_conflicting_matches",
    BASE
    + """, sc AS (SELECT source AS l, target AS r FROM live WHERE judgement IN ('no_judgement', 'positive')), both_ AS (SELECT l AS c, r AS m FROM sc UNION SELECT r, l FROM sc
), nm AS (SELECT c, m, coalesce(label, m) AS lb FROM both_ LEFT JOIN lab ON node = m), wall AS (SELECT DISTINCT x, y FROM span WHERE judgement = 'negative' AND x <> y)
SELECT DISTINCT a.c AS candidate, least(a.m, b.m) AS "left", greatest(a.m, b.m) AS "right" FROM nm a JOIN wall ON wall.x = a.lb JOIN nm b ON b.c = a.c AND b.lb = wall.y""",
)
def conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    scores = J.live(edges).where(F.col("judgement").isin(J.UNDECIDED, J.POSITIVE)).select(F.col("source").alias("left"), F.col("target").alias("right"), F.lit(1.0).alias("score"))
    return J.conflicting_matches(scores, edges, 0.5)


@REGISTRY.query("gra_history", BASE + 'SELECT target, source, judgement, created_at, row_number() OVER (PARTITION BY target, source ORDER BY created_at, judgement, deleted_at NULLS FIRST)::INT AS step FROM raw')
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.history(_edges(spark, sf_dir)).select("target", "source", "judgement", "created_at", "step")
