"""Attribute-value rows of payments as a wide, typed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.text import squeeze
from knotwork.functions.typed import MONTHS, euro_cents, full_date
from knotwork.operators.wide import Attribute, attributes_to_columns
from knotwork.plans.registry import Registry
from knotwork.sources.tables import table

REGISTRY = Registry()

PAYMENT = [
    Attribute("payer", "payer", read=lambda v: F.lower(squeeze(v))),
    Attribute("beneficiary", "beneficiary", read=lambda v: F.lower(squeeze(v))),
    Attribute("pay_date", "date", read=full_date),
    Attribute("amount_cents", "amountEur", "long", read=euro_cents),
]

_MONTH_SQL = "CASE " + " ".join(f"WHEN mon IN ({', '.join(repr(n) for n in names)}) THEN {m}" for m, names in enumerate(MONTHS, 1)) + " END"

P4_SQL = rf"""
WITH deciding AS (
  SELECT entity_id, prop, max_by(value, (coalesce(last_seen, TIMESTAMP '0001-01-01'), id, value)) AS v
  FROM statements WHERE "schema" = 'Payment' AND entity_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL
), clean AS (SELECT entity_id, prop, regexp_replace(v, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS v FROM deciding
), dated AS (
  SELECT *, lower(CASE WHEN regexp_matches(v, '^\d{{1,2}}\.?\s\pL+\.?\s\d{{4}}$') THEN regexp_extract(v, '\pL+') WHEN regexp_matches(v, '^\pL+\.?\s\d{{1,2}},?\s\d{{4}}$') THEN regexp_extract(v, '\pL+') END) AS mon
  FROM clean WHERE prop = 'date'
), parts AS (
  SELECT entity_id,
    CASE WHEN regexp_matches(v, '^\d{{4}}[-./]\d{{1,2}}[-./]\d{{1,2}}([T ]\d.*)?$') THEN regexp_replace(v, '^(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}}).*$', '\1-\2-\3')
      WHEN regexp_matches(v, '^\d{{8}}$') THEN v[1:4] || '-' || v[5:6] || '-' || v[7:8]
      WHEN regexp_matches(v, '^\d{{1,2}}\s?[-./]\s?\d{{1,2}}\s?[-./]\s?\d{{4}}$') THEN regexp_replace(v, '^(\d{{1,2}})\s?[-./]\s?(\d{{1,2}})\s?[-./]\s?(\d{{4}})$', '\3-\2-\1')
      WHEN regexp_matches(v, '^\d{{1,2}}\.?\s\pL+\.?\s\d{{4}}$') THEN regexp_extract(v, '\d{{4}}$') || '-' || ({_MONTH_SQL}) || '-' || regexp_extract(v, '^\d{{1,2}}')
      WHEN mon IS NOT NULL THEN regexp_extract(v, '\d{{4}}$') || '-' || ({_MONTH_SQL}) || '-' || regexp_extract(v, '\s(\d{{1,2}}),?\s', 1) END AS d
  FROM dated
), amounts AS (
  SELECT entity_id, CASE WHEN regexp_matches(v, '^(EUR|€|eur|Eur)?[\s\x{{a0}}\x{{202f}}]*(-?\d{{1,3}}([.,''’\s\x{{a0}}\x{{202f}}]?\d{{3}})*|-?\d+)[.,]\d\d+[\s\x{{a0}}\x{{202f}}]*(EUR|€|eur|Eur)?$')
    THEN CAST(round(CAST(regexp_replace(regexp_replace(v, '[.,](\d\d+)[^\d]*$', ''), '[^-\d]', '', 'g') || '.' || regexp_extract(v, '[.,](\d\d+)[^\d]*$', 1)[1:6] AS DECIMAL(30, 6)) * 100, 0) AS BIGINT) END AS c
  FROM clean WHERE prop = 'amountEur'
)
SELECT e.entity_id, coalesce(lower(p.v), '') AS payer, coalesce(lower(b.v), '') AS beneficiary,
  coalesce(strftime(try_cast(regexp_replace(regexp_replace(d, '-(\d)-', '-0\1-'), '-(\d)$', '-0\1') AS DATE), '%Y-%m-%d'), '') AS pay_date, coalesce(c, -1) AS amount_cents
FROM (SELECT DISTINCT entity_id FROM statements WHERE "schema" = 'Payment' AND entity_id IS NOT NULL) e
LEFT JOIN (SELECT * FROM clean WHERE prop = 'payer') p USING (entity_id) LEFT JOIN (SELECT * FROM clean WHERE prop = 'beneficiary') b USING (entity_id)
LEFT JOIN parts USING (entity_id) LEFT JOIN amounts USING (entity_id)
"""


@REGISTRY.query("p4_found", P4_SQL)
def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements").where(F.lower(squeeze(F.col("schema"))) == "payment")
    wide = attributes_to_columns(rows, PAYMENT, latest=["last_seen", "id"])
    return wide.select("entity_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("payer", "beneficiary", "pay_date")], F.coalesce("amount_cents", F.lit(-1).cast("long")).alias("amount_cents"))
