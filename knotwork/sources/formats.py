"""Statement, entity, pair and decision files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.ontology import SCHEMATA, can_match

STATEMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "entity_id", "canonical_id", "prop", "prop_type", "schema", "value", "original_value", "dataset", "origin", "lang")]
    + [T.StructField("external", T.BooleanType()), T.StructField("first_seen", T.TimestampNTZType()), T.StructField("last_seen", T.TimestampNTZType())]
)
ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("datasets", T.ArrayType(T.StringType())),
        T.StructField("referents", T.ArrayType(T.StringType())),
    ]
)
PAIR = T.StructType(
    [
        T.StructField("format_version", T.IntegerType()),
        T.StructField("left", ENTITY),
        T.StructField("right", ENTITY),
        T.StructField("judgement", T.StringType()),
        T.StructField("left_cluster", T.StringType()),
        T.StructField("right_cluster", T.StringType()),
    ]
)
FORMATS = ("parquet", "json", "csv")


def write_statements(statements: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Statements as files of a format; text formats keep times as ISO text with microseconds."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    rows = statements.select(*STATEMENT.names)
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    elif fmt == "json":
        writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def read_statements(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.schema(STATEMENT)
    if fmt == "csv":
        return reader.option("header", True).option("nullValue", "\\N").option("emptyValue", "").option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    if fmt == "json":
        return reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return reader.parquet(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON-lines file; entities of unknown schemata and those without id are left out."""
    return spark.read.schema(ENTITY).json(path).where(F.col("id").isNotNull() & F.col("schema").isin(*SCHEMATA))


def load_entities(spark: SparkSession, path: str, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The entities of a JSON-lines file and the (name, entities) of the datasets they come from, which need not be known before.

    links: (node, canonical_id) by which ids are replaced; entities that become one keep the values of all, the first schema by
    name, and the ids they had as referents.
    """
    rows = read_entities(spark, path)
    if links is not None:
        moved = rows.join(links.select(F.col("node").alias("id"), "canonical_id"), "id", "left").withColumn("to", F.coalesce("canonical_id", "id"))
        values = moved.select("to", F.explode("properties").alias("prop", "v")).select("to", "prop", F.explode("v").alias("v")).groupBy("to", "prop").agg(F.array_sort(F.collect_set("v")).alias("v"))
        props = values.groupBy("to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "v")))).alias("properties"))
        flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
        own = F.array_union(F.coalesce("referents", F.array().cast("array<string>")), F.when(F.col("to") != F.col("id"), F.array("id")).otherwise(F.array().cast("array<string>")))
        heads = moved.groupBy("to").agg(F.min("schema").alias("schema"), flat(F.col("datasets")).alias("datasets"), flat(own).alias("referents"))
        rows = heads.join(props, "to", "left").select(F.col("to").alias("id"), "schema", F.coalesce("properties", F.create_map().cast("map<string,array<string>>")).alias("properties"), "datasets", "referents")
    found = rows.select("id", F.explode("datasets").alias("name")).groupBy("name").agg(F.count("*").alias("entities"))
    return rows, found


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Judged pairs (left, right, judgement, left_cluster, right_cluster) as JSON lines of the current version."""
    pairs.select(F.lit(1).alias("format_version"), "left", "right", "judgement", "left_cluster", "right_cluster").write.mode("overwrite").json(path)


def write_entities(entities: DataFrame, path: str) -> None:
    entities.select(*ENTITY.names).write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Judged pairs of a JSON-lines file: positive and negative ones of compatible schemata."""
    rows = spark.read.schema(PAIR).json(path).where(F.lower("judgement").isin("positive", "negative"))
    known = F.array(*[F.lit(f"{a}|{b}") for a in SCHEMATA for b in SCHEMATA if can_match(a, b)])
    return rows.where(F.array_contains(known, F.concat_ws("|", "left.schema", "right.schema")))


def dump_edges(live: DataFrame) -> DataFrame:
    """(line): one JSON array per live decision, oldest first: target, source, judgement, score, user, created_at."""
    rows = live.where(F.col("judgement") != "no_judgement").orderBy("created_at", "target", "source")
    text = [F.to_json(F.array(c)) for c in ("target", "source", "judgement")]
    score = F.when(F.col("judgement") == "no_judgement", F.col("score").cast("string"))
    parts = [*[F.substring(t, 2, 2_000_000).alias(str(i)) for i, t in enumerate(text)]]
    inner = [F.substring(p, F.lit(1), F.length(p) - 1) for p in parts]
    tail = [F.coalesce(score, F.lit("null")), *[F.coalesce(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null")) for c in ("user", "created_at")]]
    return rows.select(F.concat(F.lit("["), F.concat_ws(",", *inner, *tail), F.lit("]")).alias("line"))


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a dump, as live rows."""
    parsed = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", "array<string>").alias("a"))
    at = lambda i: F.get("a", F.lit(i))
    return parsed.select(
        at(0).alias("target"), at(1).alias("source"), at(2).alias("judgement"), at(3).cast("double").alias("score"), at(4).alias("user"), at(5).alias("created_at"), F.lit(None).cast("string").alias("deleted_at")
    )
