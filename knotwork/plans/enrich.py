"""Enrichment, reconciliation, hierarchies and command lines over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import enrich as E
from knotwork.operators import items as I
from knotwork.operators import judgements as J
from knotwork.operators import matching as M
from knotwork.operators import statements as S
from knotwork.plans import matching as P
from knotwork.plans.judgements import BASE as EDGES
from knotwork.plans.registry import Registry
from knotwork.sources.tables import table

REGISTRY = Registry()


@REGISTRY.query(
    "gra_closure",
    """WITH RECURSIVE c AS (SELECT name, name AS ancestor, 0 AS hop FROM datasets UNION SELECT c.name, d.parent, hop + 1 FROM c JOIN datasets d ON d.name = c.ancestor WHERE d.parent IS NOT NULL AND hop < 6)
SELECT name, ancestor, min(hop) AS hop FROM c GROUP BY ALL""",
)
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.closure(table(spark, sf_dir, "datasets"))


_STARTS = "(SELECT DISTINCT canonical_id AS subject FROM statements WHERE canonical_id LIKE 'NK-%')"
_WAYS = """known AS (SELECT DISTINCT canonical_id FROM statements WHERE canonical_id IS NOT NULL), link AS (SELECT DISTINCT canonical_id AS a, value AS b FROM statements WHERE prop_type = 'entity' AND value IN (SELECT canonical_id FROM known)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link)"""


@REGISTRY.query(
    "gra_expand",
    f"""WITH RECURSIVE {_WAYS}, r AS (SELECT subject, subject AS id, 0 AS hop FROM {_STARTS} UNION SELECT r.subject, way.b, hop + 1 FROM r JOIN way ON way.a = r.id WHERE hop < 2)
SELECT hop, count(*) AS n, count(DISTINCT subject) AS subjects FROM (SELECT subject, id, min(hop) AS hop FROM r GROUP BY ALL) GROUP BY hop""",
)
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities within two links of merged entities, counted by distance."""
    rows = table(spark, sf_dir, "statements")
    starts = rows.where(F.col("canonical_id").startswith("NK-")).select(F.col("canonical_id").alias("subject"), F.col("canonical_id").alias("id")).distinct()
    found = E.expand(starts, S.outbound(rows), 2)
    return found.groupBy("hop").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


_OFF = {"soundex_name_parts": 0.0}


def _source(spark: SparkSession, sf_dir: str) -> tuple[E.Source, DataFrame]:
    """Pairs that share a contact or address as the stored answers of a source."""
    entities = P.entities(spark, sf_dir)
    pairs = P.shared_pairs(spark, sf_dir).select(F.col("left").alias("subject"), F.col("right").alias("candidate"))
    return E.make_source("table", pairs=pairs, entities=entities), entities


_JUDGE = """, pj AS (SELECT x.l, x.r, CASE WHEN a.label IS NOT NULL AND coalesce(a.label, x.l) = coalesce(b.label, x.r) THEN 'positive' ELSE coalesce(blocker, 'no_judgement') END AS j FROM pr x LEFT JOIN lab a ON a.node = x.l LEFT JOIN lab b ON b.node = x.r
  LEFT JOIN block k ON k.x = least(coalesce(a.label, x.l), coalesce(b.label, x.r)) AND k.y = greatest(coalesce(a.label, x.l), coalesce(b.label, x.r)))"""
_BOTH = EDGES.rstrip() + ", " + P.BASE.strip().removeprefix("WITH ") + _JUDGE
_SCORE = f"""round(CASE WHEN {P._GATE} AND 0.5 * ({P.FEATURES["jaro_name_parts"]}) > 0 THEN greatest(0.0, least(1.0, 0.5 * ({P.FEATURES["jaro_name_parts"]}) + {" + ".join(f"({v}) * ({P.FEATURES[n]})" for n, v in P._QUAL.items())})) ELSE 0.0 END::DOUBLE, 5)"""


@REGISTRY.query("enr_match", _BOTH + f"""SELECT x.l AS "left", x.r AS "right", {_SCORE} AS score FROM x JOIN pj ON pj.l = x.l AND pj.r = x.r WHERE j = 'no_judgement' AND {P._GATE}""")
def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, entities = _source(spark, sf_dir)
    scorer = M.Algorithm("jaro", tuple(f for f in M.NAME_QUALIFIED.features if f.name != "soundex_name_parts"), "sum")
    return E.match(source, entities, table(spark, sf_dir, "resolver"), scorer).withColumn("score", F.round("score", 5))


@REGISTRY.query("enr_judged", _BOTH + """SELECT l AS "left", r AS "right", j AS judgement FROM pj""")
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the source with the decisions known on them."""
    return J.judge(P.shared_pairs(spark, sf_dir), table(spark, sf_dir, "resolver"))


@REGISTRY.query("enr_enrich", _BOTH + """SELECT DISTINCT l AS subject, r AS id, 0 AS hop FROM pj WHERE j = 'positive'""")
def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that subjects are judged to be (they have no links of their own here)."""
    source, entities = _source(spark, sf_dir)
    links = S.outbound(table(spark, sf_dir, "statements").where("schema = 'Address'"))
    return E.enrich(source, entities, table(spark, sf_dir, "resolver"), links)


_SC = f"""{P.BASE}, sc AS (SELECT l, r, round(0.5 * ({P.FEATURES["jaro_name_parts"]}), 5) AS score FROM x)"""


def _jaro(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = P.pairs(spark, sf_dir)
    from knotwork.functions import features as X

    return both.select("left", "right", F.round(0.5 * X.jaro_name_parts(F.col("l"), F.col("r")), 5).alias("score"))


@REGISTRY.query("rec_best", _SC + """SELECT l AS "left", r AS "right", score, CASE WHEN score > 0.48 THEN 'take' ELSE 'review' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS k FROM sc) WHERE k = 1""")
def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reconcile(_jaro(spark, sf_dir), 0.48)


@REGISTRY.query("rec_queue", _SC + "SELECT id, max(score) AS score FROM ent LEFT JOIN sc ON sc.l = id GROUP BY id")
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.review_queue(P.entities(spark, sf_dir), _jaro(spark, sf_dir))


_PV = """, pv AS (SELECT DISTINCT entity_id AS id, prop, value FROM statements WHERE value IS NOT NULL AND "schema" IN ('Person', 'Company', 'Organization'))"""
_SINGLE = "('birthDate', 'incorporationDate', 'gender', 'birthPlace')"


@REGISTRY.query(
    "rec_propose",
    P.BASE
    + _PV
    + f"""SELECT DISTINCT l AS "left", a.prop, a.value FROM pr JOIN pv a ON a.id = l WHERE a.prop IN ({", ".join(repr(p) for p in S.PROPERTIES)}) AND NOT EXISTS (SELECT 1 FROM pv b WHERE b.id = r AND b.prop = a.prop AND b.value = a.value)
  AND (a.prop NOT IN {_SINGLE} OR (NOT EXISTS (SELECT 1 FROM pv b WHERE b.id = r AND b.prop = a.prop) AND (SELECT count(*) FROM pv c WHERE c.id = l AND c.prop = a.prop) = 1))""",
)
def propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.propose(P.pairs(spark, sf_dir))


@REGISTRY.query("rec_comparison", P.BASE + _PV + """SELECT l AS "left", r AS "right", prop, count(*) FILTER (side = 'l') AS left_n, count(*) FILTER (side = 'r') AS right_n FROM (SELECT l, r, prop, 'l' AS side FROM pr JOIN pv ON id = l UNION ALL SELECT l, r, prop, 'r' FROM pr JOIN pv ON id = r) GROUP BY ALL""")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.comparison(P.shared_pairs(spark, sf_dir), P.entities(spark, sf_dir))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return found.select("left", "right", "prop", F.greatest(n("left_values"), F.lit(0)).alias("left_n"), F.greatest(n("right_values"), F.lit(0)).alias("right_n"))


@REGISTRY.query(
    "flt_enricher",
    """SELECT DISTINCT entity_id AS id FROM statements WHERE "schema" IN ('Person', 'Company') AND prop = 'topics' AND value IN ('gov', 'debarment') AND entity_id IS NOT NULL""",
)
def enricher_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.in_filter(P.entities(spark, sf_dir), ["Person", "Company"], ["gov", "debarment"]).select("id")


@REGISTRY.query(
    "snk_command_lines",
    r"""SELECT entity_id || E'\tLen\t"' || replace(replace(value, '\', '\\'), '"', '\"') || '"' AS line FROM (SELECT entity_id, min(value) AS value FROM statements WHERE "schema" = 'Company' AND prop = 'name' AND value IS NOT NULL GROUP BY 1)
UNION ALL SELECT entity_id || E'\tP571\t+' || CASE length(v) WHEN 10 THEN v WHEN 7 THEN v || '-00' ELSE v || '-00-00' END || 'T00:00:00Z/' || CASE length(v) WHEN 10 THEN '11' WHEN 7 THEN '10' ELSE '9' END
  FROM (SELECT entity_id, min(value) AS v FROM statements WHERE "schema" = 'Company' AND prop = 'incorporationDate' AND regexp_matches(value, '^\d{4}(-\d\d(-\d\d)?)?$') GROUP BY 1)""",
)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and dates of companies as command lines."""
    rows = table(spark, sf_dir, "statements").where("schema = 'Company' AND value IS NOT NULL")
    name = rows.where("prop = 'name'").groupBy("entity_id").agg(F.min("value").alias("value")).select(
        F.lit(0).alias("seq"), F.lit("label").alias("action"), F.col("entity_id").alias("target"), F.lit("en").alias("key"), F.lit("string").alias("kind"), "value"
    )
    date = rows.where(F.col("prop").eqNullSafe("incorporationDate") & F.col("value").rlike(r"^\d{4}(-\d\d(-\d\d)?)?$")).groupBy("entity_id").agg(F.min("value").alias("value"))
    date = date.select(F.lit(1).alias("seq"), F.lit("claim").alias("action"), F.col("entity_id").alias("target"), F.lit("P571").alias("key"), F.lit("time").alias("kind"), "value")
    both = name.unionByName(date).withColumns({"lang": F.lit(None).cast("string"), "source_url": F.lit(None).cast("string")})
    return I.command_lines(both)


@REGISTRY.query("sca_clean_names", r"""SELECT DISTINCT value, trim(regexp_replace(regexp_replace(regexp_replace(value, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[^\pL\pM\pN\pP\p{Sc}\s\x{a0}]', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM statements WHERE prop IN ('name', 'alias') AND value IS NOT NULL""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements").where(F.col("prop").isin("name", "alias") & F.col("value").isNotNull())
    return rows.select("value", I.clean_name(F.col("value")).alias("cleaned")).distinct()


@REGISTRY.query("sca_linked_items", r"SELECT DISTINCT node AS id, regexp_matches(node, '^Q\d+$') AS item FROM (SELECT target AS node FROM resolver UNION SELECT source FROM resolver)")
def linked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "resolver").select(F.explode(F.array("target", "source")).alias("id")).distinct()
    return ids.select("id", I.is_item(F.col("id")).alias("item"))
