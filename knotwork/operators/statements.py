"""Statements: canonical ids, assembly into entities, scopes, neighbours, and changes by dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.keys import small
from knotwork.operators.ontology import PROPERTIES, SCHEMATA, schema_kinds


def latest(statements: DataFrame) -> DataFrame:
    """Each statement id once, with its latest ``last_seen`` (null is earliest)."""
    others = [c for c in statements.columns if c not in ("id", "last_seen")]
    row = F.struct("last_seen", *others)
    kept = statements.where("id IS NOT NULL").groupBy("id").agg(F.max(row).alias("r"))
    return kept.select("id", "r.*").select(*statements.columns)


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch: a known id takes the batch's canonical id, schema, type, language, original value and time.

    Entity, property, value, dataset, origin and first sight stay as they were. Of rows with one id in the batch the last
    seen counts.
    """
    changing = ("canonical_id", "schema", "prop_type", "lang", "original_value", "last_seen")
    fresh = latest(batch)
    old = latest(store).select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in store.columns if c != "id"])
    joined = old.join(fresh, F.col("_id") == F.col("id"), "full")
    known, new = F.col("_id").isNotNull(), F.col("id").isNotNull()
    take = lambda c: F.when(known & ~new, F.col(f"_{c}")).when(known & F.lit(c not in changing), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select(F.coalesce("_id", "id").alias("id"), *[take(c).alias(c) for c in store.columns if c != "id"]).select(*store.columns)


def pop(store: DataFrame, canonical_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the statements of some canonical ids, the rest)."""
    ids = canonical_ids.select("canonical_id").distinct()
    return store.join(ids, "canonical_id", "left_semi").select(*store.columns), store.join(ids, "canonical_id", "left_anti").select(*store.columns)


def replace_dataset(store: DataFrame, dataset: str, fresh: DataFrame) -> DataFrame:
    """The store with a dataset's statements replaced; an id that another dataset holds is not taken over."""
    kept = store.where(~F.col("dataset").eqNullSafe(dataset))
    once = latest(fresh.withColumn("dataset", F.lit(dataset)))
    return kept.unionByName(once.join(kept.select("id"), "id", "left_anti").select(*store.columns))


def scope_names(datasets: DataFrame, name: str, depth: int = 8) -> DataFrame:
    """(name) of a dataset and all below it that are no collections."""
    below = datasets.where(F.col("name") == name).select("name", "kind")
    found = below
    for _ in range(depth):
        below = datasets.join(below.select(F.col("name").alias("parent")), "parent", "left_semi").select("name", "kind")
        found = found.unionByName(below)
    return found.where("kind <> 'collection'").select("name").distinct()


def in_scope(statements: DataFrame, leaves: DataFrame, *, external: bool = False) -> DataFrame:
    """Statements of some datasets; those marked external only if asked for."""
    rows = statements.join(small(leaves.select(F.col("name").alias("dataset"))), "dataset", "left_semi").select(*statements.columns)
    return rows if external else rows.where(~F.coalesce("external", F.lit(False)))


def of_schemata(entities: DataFrame, names: list[str]) -> DataFrame:
    """Entities of exactly these schemata, not of kinds of them; all, if none is named."""
    return entities.where(F.col("schema").isin(*names)) if names else entities


def canonicalise(statements: DataFrame, links: DataFrame) -> DataFrame:
    """Statements with the canonical ids of a linker (node, canonical_id); values that are entity ids are replaced too,
    and keep what they were in ``original_value``."""
    entity = links.select(F.col("node").alias("entity_id"), F.col("canonical_id").alias("_c"))
    value = links.select(F.col("node").alias("value"), F.col("canonical_id").alias("_v"), F.lit("entity").alias("prop_type"))
    rows = statements.join(entity, "entity_id", "left").join(value, ["value", "prop_type"], "left")
    moved = F.col("_v").isNotNull() & (F.col("_v") != F.col("value"))
    changed = {
        "canonical_id": F.coalesce("_c", "entity_id"),
        "original_value": F.when(moved, F.coalesce("original_value", "value")).otherwise(F.col("original_value")),
        "value": F.coalesce("_v", "value"),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in statements.columns])


def common_schema(statements: DataFrame, key: str = "canonical_id") -> DataFrame:
    """(key, common): the most specific schema of a group that all its schemata are kinds of, or that is a kind of them all.

    Null where two schemata are on different branches, or unknown.
    """
    spark = statements.sparkSession
    kinds = schema_kinds(spark)
    stated = statements.select(key, "schema").where(F.col(key).isNotNull()).distinct()
    size = stated.groupBy(key).agg(F.count("*").alias("n"))
    # a schema fits the group if every schema of the group is among its ancestors
    fits = stated.join(F.broadcast(kinds.withColumnsRenamed({"schema": "common", "ancestor": "schema"}).drop("depth")), "schema").groupBy(key, "common").agg(F.count("*").alias("k"))
    own = stated.withColumnRenamed("schema", "common")
    best = fits.join(own, [key, "common"], "left_semi").join(size, key).where("k = n").groupBy(key).agg(F.min("common").alias("common"))
    return size.join(best, key, "left").select(key, "common")


def assemble(statements: DataFrame, referents: DataFrame | None = None, key: str = "canonical_id") -> DataFrame:
    """(id, schema, properties, datasets, referents, first_seen, last_seen): one entity per group with a common schema.

    Values are distinct within a property before a group is gathered. referents: (canonical_id, referent) beyond the
    entity ids of the group.
    """
    rows = statements.where(F.col(key).isNotNull() & F.col("value").isNotNull())
    values = rows.groupBy(key, "prop").agg(F.array_sort(F.collect_set("value")).alias("values"))
    props = values.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "values")))).alias("properties"))
    about = rows.groupBy(key).agg(
        F.array_sort(F.collect_set("dataset")).alias("datasets"), F.array_sort(F.collect_set("entity_id")).alias("members"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    out = props.join(about, key).join(common_schema(rows, key), key).where("common IS NOT NULL")
    if referents is None:
        extra = F.array().cast("array<string>")
    else:
        more = referents.groupBy(F.col("canonical_id").alias(key)).agg(F.collect_set("referent").alias("more"))
        out, extra = out.join(more, key, "left"), F.coalesce("more", F.array().cast("array<string>"))
    refs = F.array_sort(F.array_except(F.array_union("members", extra), F.array(F.col(key))))
    return out.select(F.col(key).alias("id"), F.col("common").alias("schema"), "properties", "datasets", refs.alias("referents"), "first_seen", "last_seen")


def disassemble(entities: DataFrame) -> DataFrame:
    """(entity_id, canonical_id, schema, prop, prop_type, value) of every value of entities."""
    types = F.create_map(*[F.lit(x) for n, p in PROPERTIES.items() for x in (n, p.type)])
    rows = entities.select("id", "schema", F.explode("properties").alias("prop", "values")).select("id", "schema", "prop", F.explode("values").alias("value"))
    return rows.select(F.col("id").alias("entity_id"), F.col("id").alias("canonical_id"), "schema", "prop", types[F.col("prop")].alias("prop_type"), "value")


def outbound(statements: DataFrame) -> DataFrame:
    """(id, prop, other): links from entities to entities."""
    refs = statements.where(F.col("prop_type") == "entity").select(F.col("canonical_id").alias("id"), "prop", F.col("value").alias("other")).distinct()
    known = statements.select(F.col("canonical_id").alias("other")).distinct()
    return refs.join(known, "other", "left_semi").select("id", "prop", "other")


def inbound(statements: DataFrame) -> DataFrame:
    """(id, prop, other): the same links seen from the other end, under the reverse property."""
    back = F.create_map(*[F.lit(x) for n, p in PROPERTIES.items() if p.reverse for x in (n, p.reverse)])
    rows = outbound(statements).withColumn("reverse", back[F.col("prop")]).where("reverse IS NOT NULL")
    return rows.select(F.col("other").alias("id"), F.col("reverse").alias("prop"), F.col("id").alias("other"))


def known_schemata(statements: DataFrame) -> DataFrame:
    return statements.where(F.col("schema").isin(*SCHEMATA))


def pair_entities(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """pairs (left, right) with both entities as structs; pairs with an unknown end are left out."""
    row = F.struct(*entities.columns)
    left = entities.select(F.col("id").alias("left"), row.alias("l"))
    right = entities.select(F.col("id").alias("right"), row.alias("r"))
    return pairs.join(left, "left").join(right, "right")
