"""Items of a public knowledge base: claims, labels, qualified values and command lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An item as its service gives it.
ITEM = """struct<id: string, labels: map<string, struct<language: string, value: string>>, aliases: map<string, array<struct<language: string, value: string>>>,
claims: map<string, array<struct<rank: string, mainsnak: struct<snaktype: string, datavalue: string>, qualifiers: map<string, array<struct<snaktype: string, datavalue: string>>>>>>,
sitelinks: map<string, struct<site: string, title: string>>>"""
#: Item properties and the entity properties they are. Fixed values.
PROPERTY_OF = {"P569": "birthDate", "P21": "gender", "P27": "country", "P19": "birthPlace", "P571": "incorporationDate", "P17": "country", "P1278": "leiCode", "P968": "email", "P1329": "phone"}
#: Qualifiers: start, end and point of a period. Fixed values.
START, END, POINT = "P580", "P582", "P585"
LANGUAGES = ("en", "de", "fr", "es", "ru", "el", "ar", "hi", "zh", "ja", "th")


def is_item(identifier: Column) -> Column:
    return F.coalesce(identifier.rlike(r"^Q\d+$"), F.lit(False))


def item_of(identifier: Column, linked: Column | None = None) -> Column:
    """The item an entity is: its id, else the link it states."""
    first = F.when(is_item(identifier), identifier)
    return first if linked is None else F.coalesce(first, F.when(is_item(linked), linked))


def parse_items(rows: DataFrame, column: str = "text") -> DataFrame:
    """(id, item) of items in JSON text; unreadable text is left out."""
    return rows.select(F.from_json(F.col(column), ITEM).alias("item")).where("item.id IS NOT NULL").select("item.id", "item")


def labels(items: DataFrame, preferred: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(id, text, lang): the label in the first of the preferred languages, else in the least other."""
    rows = items.select("id", F.explode(F.map_values("item.labels")).alias("l")).select("id", F.col("l.value").alias("text"), F.col("l.language").alias("lang"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("lang")), F.lit(0)), F.lit(len(preferred) + 1))
    return rows.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "lang", "text")).alias("m")).select("id", "m.text", "m.lang")


def aliases(items: DataFrame) -> DataFrame:
    """(id, text, lang, strong): aliases without brackets; strong if they have several words and three characters."""
    rows = items.select("id", F.explode(F.flatten(F.map_values("item.aliases"))).alias("a"))
    text = clean_name(F.col("a.value"))
    return rows.select("id", text.alias("text"), F.col("a.language").alias("lang"), strong_alias(text).alias("strong")).where("text <> ''").distinct()


def clean_name(value: Column) -> Column:
    """A label without what stands in brackets and without symbols."""
    bare = F.regexp_replace(value, r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}\p{P}\p{Sc}\s]", ""), r"\s+", " "))


def strong_alias(value: Column) -> Column:
    return value.contains(" ") & value.rlike(r"\p{L}") & (F.length(value) >= 3)


def time_text(value: Column) -> Column:
    """A time value as a date prefix: a day, a month or a year as precise as it is; years before 1000 and unclear ones are null."""
    time = F.regexp_extract(value, r"\+(\d{4}-\d{2}-\d{2})", 1)
    precision = F.get_json_object(value, "$.value.precision").cast("int")
    text = F.when(precision >= 11, time).when(precision == 10, F.substring(time, 1, 7)).when(precision == 9, F.substring(time, 1, 4))
    text = F.when(F.substring(time, 6, 5) == "00-00", F.substring(time, 1, 4)).otherwise(text)
    return F.when((time != "") & (F.substring(time, 1, 4) >= "1000"), text)


def value_text(value: Column) -> Column:
    """A claim's value as text: a time, an item's id, a text in a language, an amount, or the value as it is."""
    kind = F.get_json_object(value, "$.type")
    at = lambda path: F.get_json_object(value, f"$.value{path}")
    return (
        F.when(kind == "time", time_text(value))
        .when(kind == "wikibase-entityid", at(".id"))
        .when(kind == "monolingualtext", at(".text"))
        .when(kind == "quantity", F.regexp_replace(at(".amount"), r"^\+", ""))
        .when(kind == "string", at(""))
    )


def claims(items: DataFrame) -> DataFrame:
    """(id, prop, value, start, end, ended_unknown) of claims that are not deprecated and state a value."""
    rows = items.select("id", F.explode("item.claims").alias("prop", "cs")).select("id", "prop", F.explode("cs").alias("c"))
    rows = rows.where((F.coalesce("c.rank", F.lit("normal")) != "deprecated") & (F.col("c.mainsnak.snaktype") == "value"))
    qualifier = lambda p: time_text(F.get(F.col("c.qualifiers")[p], F.lit(0))["datavalue"])
    unknown = F.coalesce(F.exists(F.col("c.qualifiers")[END], lambda q: q["snaktype"] == "somevalue"), F.lit(False))
    return rows.select("id", "prop", value_text(F.col("c.mainsnak.datavalue")).alias("value"), qualifier(START).alias("start"), qualifier(END).alias("end"), unknown.alias("ended_unknown")).where("value IS NOT NULL")


def is_ended(rows: DataFrame, now: str) -> Column:
    """Whether a claim's end lies before a day, or is said to be over at an unknown time."""
    return F.coalesce(F.col("ended_unknown") | (F.col("end") < F.substring(F.lit(now), F.lit(1), F.length("end"))), F.lit(False))


def qualified(value: Column, start: Column, end: Column) -> Column:
    """A value with its period in brackets."""
    period = F.when(start.isNotNull() & end.isNotNull(), F.concat_ws("-", start, end)).when(start.isNotNull(), F.concat(start, F.lit("-"))).when(end.isNotNull(), F.concat(F.lit("-"), end))
    return F.when(period.isNotNull(), F.concat(value, F.lit(" ("), period, F.lit(")"))).otherwise(value)


def entity_statements(items: DataFrame) -> DataFrame:
    """(entity_id, prop, value): items as statements of entities, by the properties that have a counterpart."""
    known = F.create_map(*[F.lit(x) for kv in PROPERTY_OF.items() for x in kv])
    stated = claims(items).withColumn("prop", known[F.col("prop")]).where("prop IS NOT NULL").select(F.col("id").alias("entity_id"), "prop", "value")
    named = labels(items).select(F.col("id").alias("entity_id"), F.lit("name").alias("prop"), F.col("text").alias("value"))
    other = aliases(items).select(F.col("id").alias("entity_id"), F.when(F.col("strong"), "alias").otherwise("weakAlias").alias("prop"), F.col("text").alias("value"))
    return stated.unionByName(named).unionByName(other).distinct()


def query_bindings(rows: DataFrame, column: str = "text") -> DataFrame:
    """(row, var, value): the bindings of a query service's JSON answers, with items as bare ids."""
    schema = "struct<results: struct<bindings: array<map<string, struct<type: string, value: string>>>>>"
    found = rows.select(F.posexplode(F.from_json(F.col(column), schema)["results"]["bindings"]).alias("row", "b")).select("row", F.explode("b").alias("var", "v"))
    return found.select("row", "var", F.regexp_replace("v.value", r"^https?://[^/]+/entity/", "").alias("value"))


# command lines


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def day_value(prefix: Column) -> Column:
    """A date prefix as a time value with its precision."""
    n = F.length(prefix)
    full = F.when(n >= 10, F.substring(prefix, 1, 10)).when(n == 7, F.concat(prefix, F.lit("-00"))).when(n == 4, F.concat(prefix, F.lit("-00-00")))
    precision = F.when(n >= 10, "11").when(n == 7, "10").when(n == 4, "9")
    return F.concat(F.lit("+"), full, F.lit("T00:00:00Z/"), precision)


def rendered(kind: Column, value: Column, lang: Column) -> Column:
    """A value in a command: an item, a text, a text in a language, or a time."""
    return F.when(kind == "item", value).when(kind == "string", quoted(value)).when(kind == "text", F.concat(lang, F.lit(":"), quoted(value))).when(kind == "time", day_value(value))


def command_lines(commands: DataFrame) -> DataFrame:
    """(line) of commands (seq, action, target, key, kind, value, lang, source_url), in order.

    action: ``create``, ``label``, ``alias``, ``description`` (key is a language) or ``claim`` (key is a property); a claim may
    cite a web address.
    """
    prefix = F.when(F.col("action") == "label", F.concat(F.lit("L"), "key")).when(F.col("action") == "alias", F.concat(F.lit("A"), "key")).when(F.col("action") == "description", F.concat(F.lit("D"), "key"))
    text = F.concat_ws("\t", "target", prefix, quoted(F.col("value")))
    claim = F.concat_ws("\t", "target", "key", rendered(F.col("kind"), F.col("value"), F.col("lang")), F.when(F.col("source_url").isNotNull(), F.concat(F.lit("S854\t"), quoted(F.col("source_url")))))
    line = F.when(F.col("action") == "create", F.lit("CREATE")).when(F.col("action") == "claim", claim).otherwise(text)
    return commands.orderBy("seq").select(line.alias("line"))


def empty_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"id string, item {ITEM}")
