"""Statements, entities, storage and files over the statement table; lookups over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import judgements as J
from knotwork.operators import statements as S
from knotwork.operators import store as V
from knotwork.operators.ontology import PROPERTIES, SCHEMATA, ancestors
from knotwork.plans.judgements import BASE as EDGES
from knotwork.plans.registry import Registry
from knotwork.session import Scratch
from knotwork.sources import formats
from knotwork.sources import units as U
from knotwork.sources.tables import table

REGISTRY = Registry()

_COLUMNS = 'entity_id, canonical_id, prop, prop_type, "schema", value, original_value, dataset, origin, lang, external, first_seen, last_seen'
_ONCE = f"""once AS (SELECT id, {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, entity_id DESC NULLS LAST, canonical_id DESC NULLS LAST, prop DESC NULLS LAST,
  prop_type DESC NULLS LAST, "schema" DESC NULLS LAST, value DESC NULLS LAST, original_value DESC NULLS LAST, dataset DESC NULLS LAST, origin DESC NULLS LAST, lang DESC NULLS LAST, external DESC NULLS LAST, first_seen DESC NULLS LAST) AS k
  FROM statements WHERE id IS NOT NULL) WHERE k = 1)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "statements")


@REGISTRY.query("sto_latest_statements", f"WITH {_ONCE} SELECT id, {_COLUMNS} FROM once")
def latest_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(_statements(spark, sf_dir))


@REGISTRY.query(
    "snk_upsert",
    f"""WITH {_ONCE} SELECT id, entity_id, prop, value, CASE WHEN dataset = 'press_clippings' THEN 'NK-' || canonical_id ELSE canonical_id END AS canonical_id,
  CASE WHEN dataset = 'press_clippings' THEN 'xx' ELSE lang END AS lang, origin FROM once""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset written again with other canonical ids, languages and origins: origins are not taken over."""
    rows = _statements(spark, sf_dir)
    batch = rows.where("dataset = 'press_clippings'").withColumns({"canonical_id": F.concat(F.lit("NK-"), "canonical_id"), "lang": F.lit("xx"), "origin": F.lit("again")})
    return S.upsert(rows, batch).select("id", "entity_id", "prop", "value", "canonical_id", "lang", "origin")


@REGISTRY.query("snk_pop", "SELECT id, canonical_id, prop, value FROM statements WHERE canonical_id LIKE 'NK-%'")
def pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statements(spark, sf_dir)
    ids = rows.where(F.col("canonical_id").startswith("NK-")).select("canonical_id")
    return S.pop(rows, ids)[0].select("id", "canonical_id", "prop", "value")


@REGISTRY.query("snk_pop_rest", "SELECT id, canonical_id, prop, value FROM statements WHERE canonical_id IS NULL OR canonical_id NOT LIKE 'NK-%'")
def pop_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _statements(spark, sf_dir)
    ids = rows.where(F.col("canonical_id").startswith("NK-")).select("canonical_id")
    return S.pop(rows, ids)[1].select("id", "canonical_id", "prop", "value")


@REGISTRY.query(
    "snk_replace_dataset",
    f"""WITH {_ONCE}, kept AS (SELECT id, dataset, value FROM statements WHERE dataset IS DISTINCT FROM 'gazetteer'),
new AS (SELECT id, 'gazetteer' AS dataset, upper(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST) AS k FROM statements WHERE prop = 'city') WHERE k = 1)
SELECT dataset, count(*) AS n, count(DISTINCT id) AS ids, min(value) AS least, max(value) AS greatest FROM (SELECT * FROM kept UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM kept WHERE id IS NOT NULL)) GROUP BY dataset""",
)
def replace_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address dataset replaced by its cities in capitals, by dataset."""
    rows = _statements(spark, sf_dir)
    after = S.replace_dataset(rows, "gazetteer", rows.where("prop = 'city'").withColumn("value", F.upper("value")))
    return after.groupBy("dataset").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("value").alias("least"), F.max("value").alias("greatest"))


_SCOPE = """scope AS (SELECT d.name FROM datasets d LEFT JOIN datasets p ON p.name = d.parent LEFT JOIN datasets q ON q.name = p.parent WHERE d.kind <> 'collection' AND 'official' IN (d.name, p.name, q.name))"""


@REGISTRY.query("flt_scope", f"WITH {_SCOPE} SELECT dataset, \"schema\", count(*) AS n FROM statements WHERE dataset IN (SELECT name FROM scope) AND NOT coalesce(external, false) GROUP BY ALL")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a collection that are not external, counted."""
    leaves = S.scope_names(table(spark, sf_dir, "datasets"), "official")
    return S.in_scope(_statements(spark, sf_dir), leaves).groupBy("dataset", "schema").agg(F.count("*").alias("n"))


@REGISTRY.query("flt_scope_external", f"WITH {_SCOPE} SELECT id, prop, value FROM statements WHERE dataset IN (SELECT name FROM scope)")
def scope_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = S.scope_names(table(spark, sf_dir, "datasets"), "official")
    return S.in_scope(_statements(spark, sf_dir), leaves, external=True).select("id", "prop", "value")


@REGISTRY.query(
    "can_statements",
    EDGES
    + """SELECT s.id, s.entity_id, coalesce(c.canonical_id, s.entity_id) AS canonical_id, s.prop, coalesce(v.canonical_id, s.value) AS value,
  CASE WHEN v.canonical_id IS NOT NULL AND v.canonical_id <> s.value THEN coalesce(s.original_value, s.value) ELSE s.original_value END AS original_value
  FROM statements s LEFT JOIN linker c ON c.node = s.entity_id LEFT JOIN linker v ON v.node = s.value AND s.prop_type = 'entity'""",
)
def canonical_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = J.linker(table(spark, sf_dir, "resolver"))
    return S.canonicalise(_statements(spark, sf_dir), links).select("id", "entity_id", "canonical_id", "prop", "value", "original_value")


_KINDS = ", ".join(f"('{s}', '{a}')" for s in SCHEMATA for a in ancestors(s))
_ASSEMBLE = f"""kinds AS (SELECT * FROM (VALUES {_KINDS}) AS t(s, a)), st AS (SELECT DISTINCT canonical_id, "schema" AS s FROM statements WHERE canonical_id IS NOT NULL AND value IS NOT NULL),
sz AS (SELECT canonical_id, count(*) AS n FROM st GROUP BY 1), fit AS (SELECT st.canonical_id, k.s AS c, count(*) AS m FROM st JOIN kinds k ON k.a = st.s GROUP BY ALL),
com AS (SELECT fit.canonical_id, min(c) AS common FROM fit JOIN sz USING (canonical_id) JOIN st ON st.canonical_id = fit.canonical_id AND st.s = fit.c WHERE m = n GROUP BY 1)"""


@REGISTRY.query("agg_common_schema", f"WITH {_ASSEMBLE} SELECT canonical_id, common FROM sz LEFT JOIN com USING (canonical_id)")
def common_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.common_schema(_statements(spark, sf_dir).where("value IS NOT NULL"))


@REGISTRY.query(
    "agg_assemble",
    f"""WITH {_ASSEMBLE}, pv AS (SELECT canonical_id, prop, string_agg(DISTINCT value, '|' ORDER BY value) AS vs FROM statements WHERE canonical_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT canonical_id AS id, common AS "schema", (SELECT string_agg(prop || '=' || vs, ';' ORDER BY prop) FROM pv WHERE pv.canonical_id = c.canonical_id) AS properties,
  coalesce((SELECT string_agg(DISTINCT dataset, '|' ORDER BY dataset) FROM statements s WHERE s.canonical_id = c.canonical_id AND value IS NOT NULL), '') AS datasets,
  coalesce((SELECT string_agg(DISTINCT entity_id, '|' ORDER BY entity_id) FROM statements s WHERE s.canonical_id = c.canonical_id AND value IS NOT NULL AND entity_id <> canonical_id), '') AS referents,
  (SELECT min(first_seen) FROM statements s WHERE s.canonical_id = c.canonical_id AND value IS NOT NULL) AS first_seen FROM com c""",
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged entities, with their properties as text."""
    found = S.assemble(_statements(spark, sf_dir))
    props = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
    return found.select("id", "schema", props.alias("properties"), F.array_join("datasets", "|").alias("datasets"), F.array_join("referents", "|").alias("referents"), "first_seen")


@REGISTRY.query(
    "can_entities",
    EDGES
    + """SELECT coalesce(c.canonical_id, s.entity_id) AS id, s.prop, coalesce(v.canonical_id, s.value) AS value FROM (SELECT DISTINCT entity_id, prop, value FROM statements WHERE entity_id IS NOT NULL AND value IS NOT NULL AND "schema" = 'Payment') s
  LEFT JOIN linker c ON c.node = s.entity_id LEFT JOIN linker v ON v.node = s.value AND s.prop IN ('payer', 'beneficiary', 'addressEntity') GROUP BY ALL""",
)
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments, as its SQL; ``can_entities_all`` has all entities."""
    return _canonical(_statements(spark, sf_dir).where("schema = 'Payment'"), table(spark, sf_dir, "resolver"))


@REGISTRY.query("can_entities_all")
def canonical_entities_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities, taken apart, canonicalised and told by id, property and value."""
    return _canonical(_statements(spark, sf_dir), table(spark, sf_dir, "resolver"))


def _canonical(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements as entities, taken apart, canonicalised and told by id, property and value."""
    apart = S.disassemble(S.assemble(rows, key="entity_id")).withColumn("original_value", F.lit(None).cast("string"))
    return S.canonicalise(apart, J.linker(edges)).select(F.col("canonical_id").alias("id"), "prop", "value").distinct()


_KNOWN = "known AS (SELECT DISTINCT canonical_id FROM statements WHERE canonical_id IS NOT NULL)"
_LINK = """link AS (SELECT DISTINCT canonical_id AS id, prop, value AS other FROM statements WHERE prop_type = 'entity' AND value IN (SELECT canonical_id FROM known))"""


@REGISTRY.query("jn_outbound", f"WITH {_KNOWN}, {_LINK} SELECT id, prop, other FROM link")
def outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outbound(_statements(spark, sf_dir))


_BACK = "CASE prop " + " ".join(f"WHEN '{n}' THEN '{p.reverse}'" for n, p in PROPERTIES.items() if p.reverse) + " END"


@REGISTRY.query("jn_inbound", f"WITH {_KNOWN}, {_LINK} SELECT other AS id, {_BACK} AS prop, id AS other FROM link WHERE {_BACK} IS NOT NULL")
def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inbound(_statements(spark, sf_dir))


@REGISTRY.query("agg_has_entity", "SELECT node AS id, count(s.id) > 0 AS known FROM (SELECT target AS node FROM resolver UNION SELECT source FROM resolver) LEFT JOIN (SELECT DISTINCT canonical_id AS id FROM statements) s ON s.id = node GROUP BY node")
def has_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids of the resolver have statements."""
    ids = table(spark, sf_dir, "resolver").select(F.explode(F.array("target", "source")).alias("id")).distinct()
    have = _statements(spark, sf_dir).select(F.col("canonical_id").alias("id"), F.lit(True).alias("known")).distinct()
    return ids.join(have, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@REGISTRY.query("sto_first_seen", "SELECT canonical_id, string_agg(id || '=' || coalesce(strftime(t, '%Y-%m-%d %H:%M:%S.%f'), '?'), ';' ORDER BY id) AS seen FROM (SELECT canonical_id, id, min(first_seen) AS t FROM statements WHERE \"schema\" = 'Address' AND id IS NOT NULL GROUP BY ALL) GROUP BY 1")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses only, as its SQL, as text per canonical id; ``sto_first_seen_all`` has all entities."""
    found = V.first_seen(_statements(spark, sf_dir).where("schema = 'Address'"))
    entry = F.concat("id", F.lit("="), F.coalesce(F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("?")))
    rows = found.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("text")))).alias("all"))
    return rows.select("canonical_id", F.array_join(F.col("all.text"), ";").alias("seen"))


@REGISTRY.query("sto_first_seen_all", "SELECT canonical_id, id, min(first_seen) AS first_seen FROM statements WHERE id IS NOT NULL GROUP BY ALL")
def first_seen_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sight of every statement of every entity."""
    return V.first_seen(_statements(spark, sf_dir))


@REGISTRY.query(
    "sto_versions",
    """WITH v AS (SELECT id, value, min(first_seen) AS f, max(last_seen) AS l FROM statements WHERE dataset = 'party_accounts' AND id IS NOT NULL GROUP BY ALL), a AS (SELECT id, min(first_seen) AS f FROM statements WHERE dataset = 'party_accounts' AND last_seen < TIMESTAMP '2022-01-01' GROUP BY 1),
b AS (SELECT id, max_by(first_seen, last_seen) AS f FROM statements WHERE dataset = 'party_accounts' AND id IS NOT NULL GROUP BY 1)
SELECT b.id, coalesce(TIMESTAMP '2001-01-01' + INTERVAL 0 DAY, b.f) AS first_seen FROM b JOIN a USING (id) UNION ALL SELECT id, TIMESTAMP '2002-02-02' FROM b WHERE id NOT IN (SELECT id FROM a)""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset in two versions: statements of the first keep its first sight in the second."""
    rows = _statements(spark, sf_dir).where("dataset = 'party_accounts'")
    scratch = Scratch(spark, "versions")
    store = V.VersionedStore(spark, scratch.base)
    store.write("party_accounts", "1", rows.where("last_seen < '2022-01-01'").withColumn("first_seen", F.lit("2001-01-01").cast("timestamp_ntz")))
    store.release("party_accounts", "1")
    store.write("party_accounts", "2", rows.withColumn("first_seen", F.lit("2002-02-02").cast("timestamp_ntz")))
    store.release("party_accounts", "2")
    return store.view(["party_accounts"]).select("id", "first_seen")


def _round_trip(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    scratch = Scratch(spark, f"format-{fmt}")
    path = f"{scratch.base}/statements"
    formats.write_statements(_statements(spark, sf_dir), path, fmt)
    return formats.read_statements(spark, path, fmt).select("id", "entity_id", "prop", "value", "original_value", "external", "last_seen")


for _fmt in formats.FORMATS:
    REGISTRY.query(f"src_statements_{_fmt}", "SELECT id, entity_id, prop, value, original_value, external, last_seen FROM statements")(lambda spark, sf_dir, fmt=_fmt: _round_trip(spark, sf_dir, fmt))


@REGISTRY.query("src_entities_json", """SELECT entity_id AS id, any_value("schema") AS "schema", count(DISTINCT (prop, value)) AS n_values, min(value) AS least FROM statements WHERE "schema" = 'Address' AND value IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1""")
def entities_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, as its SQL; ``src_entities_json_all`` has all entities."""
    return _entities_json(spark, _statements(spark, sf_dir).where("schema = 'Address'"))


@REGISTRY.query("src_entities_json_all")
def entities_json_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities written as JSON lines and read again."""
    return _entities_json(spark, _statements(spark, sf_dir))


def _entities_json(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Statements written as JSON-lines entities and read again."""
    scratch = Scratch(spark, "entities")
    path = f"{scratch.base}/entities"
    formats.write_entities(S.assemble(rows, key="entity_id"), path)
    values = F.flatten(F.map_values("properties"))
    return formats.read_entities(spark, path).select("id", "schema", F.size(values).cast("long").alias("n_values"), F.array_min(values).alias("least"))


@REGISTRY.query("src_dump_edges", EDGES + """SELECT '[' || to_json(target) || ',' || to_json(source) || ',' || to_json(judgement) || ',null,' || to_json("user") || ',' || to_json(created_at) || ']' AS line FROM live WHERE judgement <> 'no_judgement'""")
def dump_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.dump_edges(J.live(table(spark, sf_dir, "resolver")))


@REGISTRY.query("src_load_edges", EDGES + """SELECT target, source, judgement, "user", created_at FROM live WHERE judgement <> 'no_judgement'""")
def load_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions dumped to a file and loaded from it."""
    scratch = Scratch(spark, "edges")
    path = f"{scratch.base}/edges"
    formats.dump_edges(J.live(table(spark, sf_dir, "resolver"))).write.text(path)
    return formats.load_edges(spark, path).select("target", "source", "judgement", "user", "created_at")


_CACHE = "c AS (SELECT event_type || '/' || (user_id % 50) AS key, props AS text, ts FROM events)"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached lookups: the kind of event and a bucket of users are the key."""
    return table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")).alias("key"), F.col("props").alias("text"), "ts")


@REGISTRY.query("sto_cache_latest", f"WITH {_CACHE} SELECT key, arg_max(text, (ts, text)) AS text, max(ts) AS ts FROM c GROUP BY key")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    return V.cache_lookup(cache, cache.select("key"), now="2100-01-01")


@REGISTRY.query("sto_cache_since", f"WITH {_CACHE} SELECT key, max(ts) AS ts FROM c WHERE ts > (SELECT TIMESTAMP '2024-01-15') GROUP BY key")
def cache_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    return V.cache_lookup(cache, cache.select("key"), now="2100-01-01", since="2024-01-15").select("key", "ts")


@REGISTRY.query("src_cache_like", f"WITH {_CACHE} SELECT key, arg_max(text, (ts, text)) AS text, max(ts) AS ts FROM c WHERE key LIKE '%/1_' GROUP BY key")
def cache_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cache_like(_cache(spark, sf_dir), "%/1_")


@REGISTRY.query(
    "sto_cache_aged",
    f"""WITH {_CACHE}, n AS (SELECT date_trunc('second', max(ts)) AS now FROM c), f AS (SELECT c.* FROM c, n WHERE ts > now - to_seconds(floor((500 + (('0x' || substr(md5(key), 1, 8))::UBIGINT % 801)::INT) * 864)::BIGINT))
SELECT key, arg_max(text, (ts, text)) AS text, max(ts) AS ts FROM f GROUP BY key""",
)
def cache_aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups not older than ten days, give or take, at the time of the last event."""
    cache = _cache(spark, sf_dir)
    now = cache.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("t")).head().t
    return V.cache_lookup(cache, cache.select("key"), now=now or "2100-01-01", max_age_days=10)


@REGISTRY.query("snk_unit", "SELECT kind, count(*) AS n, sum(trust)::BIGINT AS trust FROM datasets WHERE kind <> 'media' GROUP BY kind")
def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets written, changed, changed again but rolled back, committed together, rewritten to one file, and read."""
    folder = Scratch(spark, "unit").base
    first = U.Unit(spark, folder)
    rows = first.stage("datasets", table(spark, sf_dir, "datasets"))
    first.commit()
    second = U.Unit(spark, folder)
    rows = second.stage("datasets", second.read("datasets").where("kind <> 'media'"))
    second.checkpoint()
    second.stage("datasets", rows.limit(0))
    second.rollback()
    second.commit()
    U.compact(spark, folder, "datasets")
    return U.Unit(spark, folder).read("datasets").groupBy("kind").agg(F.count("*").alias("n"), F.sum("trust").alias("trust"))
