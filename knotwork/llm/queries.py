"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.distinctive import leading_terms
from knotwork.llm.frequency import marked_terms
from knotwork.llm.groups import consolidate
from knotwork.llm.leaks import leaks
from knotwork.llm.linkage import link
from knotwork.llm.mixture import mixture, shares
from knotwork.llm.sentences import sentence_units
from knotwork.llm.spellings import variant_classes, variant_pairs
from knotwork.llm.survivors import Bundle, Dependency, survivors
from knotwork.plans.registry import Registry
from knotwork.sources.tables import table

REGISTRY = Registry()

_FIELDS = ("birthDate", "birthPlace", "incorporationDate", "address", "registrationNumber", "legalForm")

P1_SQL = r"""
WITH g AS (SELECT canonical_id FROM statements WHERE canonical_id IS NOT NULL AND entity_id IS NOT NULL AND id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT entity_id) > 1
), s AS (
  SELECT canonical_id, prop, id, value, coalesce(trust, 0) AS trust, coalesce(last_seen, TIMESTAMP '0001-01-01') AS seen, trim(value) AS v
  FROM statements JOIN g USING (canonical_id) LEFT JOIN datasets ON name = dataset
  WHERE prop IN ('birthDate', 'birthPlace', 'incorporationDate', 'address', 'registrationNumber', 'legalForm') AND id IS NOT NULL AND entity_id IS NOT NULL
), d AS (SELECT canonical_id, prop FROM s GROUP BY ALL HAVING count(DISTINCT value) > 1
), r AS (
  SELECT s.*, CASE
      WHEN prop IN ('birthDate', 'incorporationDate') THEN CASE WHEN regexp_matches(v, '^\d{4}-\d\d-\d\d$|^\d\d\.\d\d\.\d{4}$') THEN 3 WHEN regexp_matches(v, '^\d{4}-\d\d$') THEN 2 ELSE 1 END
      WHEN prop = 'address' THEN len(regexp_extract_all(v, '\d+')) + len(list_filter(string_split(v, ','), lambda x: regexp_matches(x, '\pL')))
      WHEN prop = 'birthPlace' THEN len(list_filter(string_split(v, ','), lambda x: regexp_matches(x, '\pL')))
      WHEN prop = 'registrationNumber' THEN CASE WHEN regexp_matches(v, '[*]|\.\.') THEN len(regexp_replace(v, '\D', '', 'g')) ELSE 15 END
      ELSE 1 END AS info
  FROM s JOIN d USING (canonical_id, prop)
  WHERE lower(v) NOT IN ('', '-', '?', '??', '00', 'n/a', 'n.n.', 'k. a.', 'tba', 'xxx', 'unknown', 'none given', 'not stated', 'нет данных') AND regexp_matches(v, '[\pL\pN]')
)
SELECT canonical_id, prop, arg_max(id, (trust, seen, info, id)) AS statement_id FROM r GROUP BY ALL
"""


@REGISTRY.query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each property is a bundle without dependencies: its best statement survives, of equal ones that with the greatest id."""
    found = survivors(table(spark, sf_dir, "statements"), table(spark, sf_dir, "datasets"), [Bundle(p, (p,)) for p in _FIELDS])
    return found.select("canonical_id", "prop", "statement_id")


@REGISTRY.query("p1_bundles")
def p1_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden records whose registration and form, and whose birth date and place, stay together."""
    bundles = [Bundle("birth", ("birthDate", "birthPlace")), Bundle("registration", ("registrationNumber", "incorporationDate")), Bundle("form", ("legalForm",)), Bundle("seat", ("address",))]
    found = survivors(table(spark, sf_dir, "statements"), table(spark, sf_dir, "datasets"), bundles, [Dependency("registration", "form"), Dependency("registration", "seat")], differing_only=False)
    return found.select("canonical_id", "bundle", "prop", "statement_id")

_TERMS = r"""
WITH term AS (
  SELECT id, tok, sum(c) AS c FROM (
    SELECT DISTINCT "schema", id, field, token, "count" AS c, nfc_normalize(lower(regexp_replace(token, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'))) AS tok
    FROM entries WHERE id IS NOT NULL AND token IS NOT NULL AND "count" >= 1) GROUP BY ALL
), stat AS (SELECT tok, count(*) AS records, sum(c) AS total FROM term GROUP BY tok
), size AS (SELECT count(DISTINCT id) AS n FROM term)
"""


@REGISTRY.query(
    "p3_found",
    _TERMS
    + """SELECT id AS record_id, max_by(tok, (records <= 0.05 * n, score, weight, tok)) AS token FROM (
  SELECT id, tok, n, records, c * ln(n / records) AS weight, c * (ln(n / records) + ln(1 - exp(-total::DOUBLE / n))) AS score FROM term JOIN stat USING (tok), size) GROUP BY id""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leading_terms(table(spark, sf_dir, "entries")).select("record_id", "token")


@REGISTRY.query("p5_found", _TERMS + "SELECT tok AS token, CASE WHEN records = 1 THEN 'rare' ELSE 'common' END AS mark FROM stat, size WHERE records = 1 OR records > 0.05 * n")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "entries")).where("mark IS NOT NULL").select("token", "mark")


@REGISTRY.query("p5_counts", _TERMS + "SELECT tok AS token, records, total::BIGINT AS total, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.05 * n THEN 'common' END AS mark FROM stat, size")
def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "entries"))


P7_SQL = r"""
WITH RECURSIVE live AS (
  SELECT least(source, target) AS a, greatest(source, target) AS b, coalesce(created_at, '') AS moment, lower(regexp_replace(judgement, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS j
  FROM resolver WHERE deleted_at IS NULL AND source <> target
), link AS (SELECT a, b FROM (SELECT a, b, max_by(j, (moment, j)) AS j FROM live GROUP BY a, b) WHERE j = 'positive'
), way AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link
), reach AS (SELECT u AS n, u AS m FROM way UNION SELECT r.n, w.v FROM reach r JOIN way w ON r.m = w.u)
SELECT n AS node_id, min(m) AS group_id FROM reach GROUP BY n
"""


@REGISTRY.query("p7_found", P7_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate(table(spark, sf_dir, "resolver"))


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(table(spark, sf_dir, "statements"), table(spark, sf_dir, "datasets"))
    return found.where("confidence >= 0.5").select("left_id", "right_id")


@REGISTRY.query("p2_confidences")
def p2_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs with their confidence."""
    return link(table(spark, sf_dir, "statements"), table(spark, sf_dir, "datasets"))


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "statements"), table(spark, sf_dir, "datasets"))


@REGISTRY.query("p6_classes")
def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed entity with its class of spellings, in place of pairs."""
    return variant_classes(table(spark, sf_dir, "statements"), table(spark, sf_dir, "datasets"))


@REGISTRY.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


#: The tree above the sources: a parameter of the mixture.
DOMAINS = {"newswire": "press", "parish_bulletin": "press", "register_extract": "records", "court_digest": "records", "sanction_gazette": "records", "donation_report": "records", "encyclopedia": "reference"}


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    return table(spark, sf_dir, "mix_targets").withColumn("domain", F.coalesce(known[F.col("source")], F.lit("other")))


@REGISTRY.query("p9_mixture")
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest mixture in which every source has its target share."""
    return mixture(table(spark, sf_dir, "documents"), _targets(spark, sf_dir), domain="domain")


@REGISTRY.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return shares(mixture(table(spark, sf_dir, "documents"), targets, domain="domain"), targets)


@REGISTRY.query("p9_whole")
def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as all documents, rare languages raised: capped sources and languages pass their shortage to
    siblings, then to other domains."""
    targets = _targets(spark, sf_dir)
    return shares(mixture(table(spark, sf_dir, "documents"), targets, domain="domain", total=math.inf, temperature=0.7), targets)


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


def registries() -> list[Registry]:
    return [REGISTRY]
