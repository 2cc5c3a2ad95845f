"""Entities as tokens: (schema, id, field, token, count) rows for blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.similarity import clean, strict_id
from knotwork.operators.ontology import PROPERTIES, matchable

#: Words of names that tell nothing apart. Fixed values.
STOPWORDS = ("the", "and", "for", "von", "van", "der", "del", "des", "les", "die", "das", "und")
#: Legal forms, with the class of organisation they stand for. Fixed values.
LEGAL = {
    "ag": "jsc", "aktiengesellschaft": "jsc", "sa": "jsc", "inc": "jsc", "incorporated": "jsc", "ooo": "llc", "llc": "llc", "ltd": "llc", "limited": "llc", "gmbh": "llc", "bv": "llc", "mbh": "llc", "company": "co",
}
#: Properties that are no evidence. Fixed values.
SKIPPED = ("wikidataId", "wikipediaUrl", "publisher", "publisherUrl", "programId", "recordId", "legalForm", "status")
PREFIX = {"country": "c", "phone": "p", "email": "email", "date": "d", "identifier": "i", "address": "a"}
LONGEST = 40


def _of_type(*types: str) -> list[str]:
    return [n for n, p in PROPERTIES.items() if p.type in types and p.matchable and n not in SKIPPED]


def _tokens(field: str, prefix: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(F.lit(field).alias("field"), F.concat(F.lit(prefix + ":"), w).alias("token")))


def _long(words: Column, least: int, most: int = 10_000) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= least) & (F.length(w) <= most))


def name_tokens(value: Column) -> Column:
    """Parts of a name and its fingerprint, and the class of its legal form."""
    words = F.array_distinct(F.split(clean(value), " "))
    parts = _long(F.filter(words, lambda w: ~w.isin(*STOPWORDS) & ~w.isin(*LEGAL)), 3, 30)
    print_ = F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), "")
    whole = F.when((F.length(print_) > 3) & (F.length(print_) < 200), F.array(print_)).otherwise(F.array().cast("array<string>"))
    classes = F.create_map(*[F.lit(x) for kv in LEGAL.items() for x in kv])
    symbols = F.array_distinct(F.transform(F.filter(words, lambda w: w.isin(*LEGAL)), lambda w: classes[w]))
    return F.concat(_tokens("np", "np", parts), _tokens("name", "n", whole), _tokens("sy", "sy:ORG", symbols))


def value_tokens(prop: Column, value: Column) -> Column:
    """Tokens of a value that is no name."""
    empty = F.array().cast("array<struct<field:string,token:string>>")
    kept = F.filter(_long(F.split(clean(value), " "), 6), lambda w: ~w.isin(*STOPWORDS))
    text = _tokens("wd", "wd", kept)
    strict = strict_id(value)
    place = F.filter(F.split(clean(value), " "), lambda w: ~w.isin(*STOPWORDS))
    out = F.when(prop.isin(*_of_type("text", "string")), text).when(
        prop.isin(*_of_type("identifier")), F.concat(text, F.when(strict != "", _tokens("identifier", "i", F.array(strict))).otherwise(empty))
    )
    out = out.when(prop.isin(*_of_type("date")), _tokens("date", "d", F.array(F.substring(value, 1, 10))))
    out = out.when(prop.isin(*_of_type("address")), F.concat(_tokens("address", "a", _long(place, 4)), _tokens("wd", "wd", _long(place, 7))))
    for kind in ("country", "phone", "email"):
        out = out.when(prop.isin(*_of_type(kind)), _tokens(kind, PREFIX[kind], F.array(F.lower(F.substring(value, 1, 300)))))
    return out.otherwise(empty)


def tokenise(statements: DataFrame, key: str = "canonical_id") -> DataFrame:
    """(schema, id, field, token, count) of entities that are compared.

    Values are distinct within a property. Parts of names, fingerprints, classes, countries, contacts, dates and identifiers
    count once per entity, words of texts and addresses as often as they occur. Tokens are cut to ``LONGEST`` characters.
    """
    rows = statements.where(F.col(key).isNotNull() & F.col("value").isNotNull() & F.col("schema").isin(*matchable()))
    rows = rows.select("schema", F.col(key).alias("id"), "prop", "value").distinct()
    named = F.when(F.col("prop").isin(*_of_type("name")), name_tokens(F.col("value"))).otherwise(value_tokens(F.col("prop"), F.col("value")))
    tokens = rows.select("schema", "id", F.explode(named).alias("t")).select("schema", "id", "t.field", F.substring("t.token", 1, LONGEST).alias("token"))
    counted = tokens.groupBy("schema", "id", "field", "token").agg(F.count("*").alias("n"))
    return counted.select("schema", "id", "field", "token", F.when(F.col("field").isin("wd", "address"), F.col("n")).otherwise(1).cast("int").alias("count"))
