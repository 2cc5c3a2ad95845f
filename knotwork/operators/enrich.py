"""Enrichment from other sources: candidates, expansion along links, reconciliation and proposals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import features as X
from knotwork.operators import judgements as J
from knotwork.operators.ontology import PROPERTIES
from knotwork.operators.statements import pair_entities


class Source(Protocol):
    """A source of candidates: ``candidates`` gives (subject, candidate) for subjects, ``records`` the entities known."""

    def candidates(self, subjects: DataFrame) -> DataFrame: ...

    def records(self) -> DataFrame: ...


SOURCES: dict[str, Callable[..., Source]] = {}


def register_source(name: str, make: Callable[..., Source]) -> None:
    SOURCES[name] = make


def make_source(name: str, **config: object) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}")
    return SOURCES[name](**config)


class TableSource:
    """A source whose candidates and records are tables, for instance the stored answers of a service."""

    def __init__(self, pairs: DataFrame, entities: DataFrame) -> None:
        self._pairs, self._entities = pairs, entities

    def candidates(self, subjects: DataFrame) -> DataFrame:
        ids = subjects.select(F.col("id").alias("subject"))
        return self._pairs.join(ids, "subject", "left_semi").select("subject", "candidate")

    def records(self) -> DataFrame:
        return self._entities


register_source("table", TableSource)


def fetch_missing(keys: DataFrame, cache: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """(key, text): stored answers, and for keys without one what ``fetch`` gives; a failed fetch gives null.

    Each key is fetched once, in batches of a partition; one more attempt follows a broken answer.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key in batch["key"]:
                text = None
                for _ in range(2):
                    try:
                        text = fetch(key)
                        break
                    except ConnectionError:
                        continue
                    except Exception:  # noqa: BLE001  one failure must not end the batch
                        break
                out.append((key, text))
            yield pd.DataFrame(out, columns=["key", "text"])

    wanted = keys.select("key").distinct()
    known = cache.select("key", "text").join(wanted, "key", "left_semi")
    missing = wanted.join(known, "key", "left_anti")
    return known.unionByName(missing.mapInPandas(load, "key string, text string"))


def in_filter(entities: DataFrame, schemata: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
    """Entities of some schemata that have one of some topics; ``all`` stands for any topic."""
    rows = entities.where(F.col("schema").isin(*schemata)) if schemata else entities
    if not topics:
        return rows
    own = X.values(F.struct("properties"), "topics")
    return rows.where(F.size(own) > 0 if "all" in topics else F.arrays_overlap(own, F.array(*[F.lit(t) for t in topics])))


def match(source: Source, subjects: DataFrame, edges: DataFrame, scorer, *, threshold: float = 0.0) -> DataFrame:  # noqa: ANN001
    """(left, right, score): candidates of the subjects that are undecided and may match, scored."""
    pairs = source.candidates(subjects).select(F.col("subject").alias("left"), F.col("candidate").alias("right"))
    open_ = J.judge(pairs, edges).where(F.col("judgement") == J.UNDECIDED).select("left", "right")
    row = F.struct(*subjects.columns)
    rows = pairs.join(open_, ["left", "right"], "left_semi").join(subjects.select(F.col("id").alias("left"), row.alias("l")), "left")
    records = source.records()
    rows = rows.join(records.select(F.col("id").alias("right"), F.struct(*records.columns).alias("r")), "right").where(X.compatible(F.col("l"), F.col("r")))
    return scorer.score(rows).select("left", "right", "score").where(F.col("score") >= threshold)


def enrich(source: Source, subjects: DataFrame, edges: DataFrame, links: DataFrame, depth: int = 1) -> DataFrame:
    """(subject, id, hop): what is linked to the records that subjects are judged to be, up to some links away.

    links: (id, prop, other) between records.
    """
    pairs = source.candidates(subjects).select(F.col("subject").alias("left"), F.col("candidate").alias("right"))
    same = J.judge(pairs, edges).where(F.col("judgement") == J.POSITIVE)
    return expand(same.select(F.col("left").alias("subject"), F.col("right").alias("id")), links, depth)


def expand(starts: DataFrame, links: DataFrame, depth: int = 1) -> DataFrame:
    """(subject, id, hop): all ids within some links of each start, with the fewest links needed; a start has hop 0."""
    ways = links.select("id", "other").unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    seen = starts.select("subject", "id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(ways, "id").select("subject", F.col("other").alias("id")).distinct()
        frontier = reached.join(seen, ["subject", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def closure(parents: DataFrame, depth: int = 6, *, ended: str | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """(name, ancestor, hop) of a hierarchy (name, parent), safe against cycles.

    ended: a column that is not null where a claim no longer holds; such claims are skipped, but for the parents in ``kept``.
    """
    holds = F.col("parent").isNotNull() if ended is None else F.col("parent").isNotNull() & (F.col(ended).isNull() | F.col("parent").isin(*kept))
    edges = parents.where(holds).select("name", "parent").distinct()
    seen = parents.select("name", F.col("name").alias("ancestor")).distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(edges.withColumnsRenamed({"name": "ancestor", "parent": "up"}), "ancestor").select("name", F.col("up").alias("ancestor")).distinct()
        frontier = reached.join(seen, ["name", "ancestor"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def reconcile(scores: DataFrame, threshold: float = 0.96, *, subjects: DataFrame | None = None, linked: DataFrame | None = None, create: bool = False) -> DataFrame:
    """(left, right, score, action): each subject's best candidate, to be taken over above the threshold, else reviewed.

    subjects: (left) of all subjects; those without a candidate are created if ``create`` is set, else left out. linked: (left,
    right) of subjects that are linked already: they are only compared (``diff``), whatever their candidates.
    """
    best = scores.groupBy("left").agg(F.min(F.struct((-F.col("score")).alias("s"), "right")).alias("b")).select("left", "b.right", (-F.col("b.s")).alias("score"))
    best = best.withColumn("action", F.when(F.col("score") > threshold, "take").otherwise("review"))
    if linked is not None:
        known = linked.groupBy("left").agg(F.min("right").alias("right"))
        best = best.join(known.select("left"), "left", "left_anti").unionByName(known.select("left", "right", F.lit(None).cast("double").alias("score"), F.lit("diff").alias("action")))
    if create and subjects is not None:
        rest = subjects.select("left").distinct().join(best.select("left"), "left", "left_anti")
        best = best.unionByName(rest.select("left", F.lit(None).cast(scores.schema["right"].dataType).alias("right"), F.lit(None).cast("double").alias("score"), F.lit("create").alias("action")))
    return best


def tenures(claims: DataFrame) -> DataFrame:
    """(subject, position, start, end) of positions held (subject, position, start, end): one held more than once, in several
    tenures, keeps no dates, as it is not known to which of them a date belongs."""
    one = claims.distinct().groupBy("subject", "position").agg(F.count("*").alias("n"), F.first("start").alias("start"), F.first("end").alias("end"))
    return one.select("subject", "position", F.when(F.col("n") == 1, F.col("start")).alias("start"), F.when(F.col("n") == 1, F.col("end")).alias("end"))


def holders(positions: DataFrame, parents: DataFrame, held: DataFrame, depth: int = 6) -> DataFrame:
    """(position, subject, hop): who holds each of some positions (position) or one below it, by the hierarchy (name, parent) and
    the positions held (subject, position); the nearest way counts."""
    below = closure(parents, depth).select(F.col("ancestor").alias("position"), F.col("name").alias("held"), "hop")
    below = below.unionByName(positions.select("position", F.col("position").alias("held"), F.lit(0).alias("hop")))
    found = below.join(positions.select("position").distinct(), "position", "left_semi").join(held.select("subject", F.col("position").alias("held")), "held")
    return found.groupBy("position", "subject").agg(F.min("hop").alias("hop"))


def review_queue(subjects: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, score): subjects by their best candidate, those without any last."""
    best = scores.groupBy(F.col("left").alias("id")).agg(F.max("score").alias("score"))
    return subjects.select("id").distinct().join(best, "id", "left").orderBy(F.desc_nulls_last("score"), "id")


def propose(matched: DataFrame, single: tuple[str, ...] = ("birthDate", "incorporationDate", "gender", "birthPlace")) -> DataFrame:
    """(left, prop, value): what the record (l) knows of a matched item (r) that the item lacks.

    matched: (left, l, r). A single-valued property is proposed only if the item has none and the record one value.
    """
    own = matched.select("left", F.explode("l.properties").alias("prop", "values"), F.col("r.properties").alias("known")).where(F.col("prop").isin(*PROPERTIES))
    have = F.coalesce(F.col("known")[F.col("prop")], F.array().cast("array<string>"))
    rows = own.withColumns({"have": have, "new": F.array_except("values", have)})
    one = F.col("prop").isin(*single)
    rows = rows.where(F.when(one, (F.size("have") == 0) & (F.size("values") == 1)).otherwise(F.size("new") > 0))
    return rows.select("left", "prop", F.explode("new").alias("value")).distinct()


def comparison(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(left, right, prop, left_values, right_values): both sides of pairs by property, names first, then by type and name."""
    both = pair_entities(pairs, entities)
    rows = both.select("left", "right", F.explode(F.array_union(F.map_keys("l.properties"), F.map_keys("r.properties"))).alias("prop"), F.col("l.properties").alias("a"), F.col("r.properties").alias("b"))
    order = {"name": 0, "date": 1, "country": 2, "identifier": 3, "address": 4}
    types = F.create_map(*[F.lit(x) for n, p in PROPERTIES.items() for x in (n, order.get(p.type, 9))])
    return rows.select("left", "right", "prop", F.coalesce(types[F.col("prop")], F.lit(9)).alias("order"), F.col("a")[F.col("prop")].alias("left_values"), F.col("b")[F.col("prop")].alias("right_values"))


def nested_records(rows: DataFrame, column: str, schema: str, path: Callable[[Column], Column], depth: int) -> DataFrame:
    """(root, node, parent, depth) of records nested in JSON text: ``path`` gives the array of children of a node.

    schema: the type of a node nested to ``depth``; deeper nodes are left out.
    """
    at = rows.select(F.col("id").alias("root"), F.from_json(column, schema).alias("n"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    out = at.select("root", F.col("n.id").alias("node"), "parent", "depth")
    for level in range(1, depth):
        at = at.select("root", F.explode(path(F.col("n"))).alias("child"), F.col("n.id").alias("parent"), F.lit(level).alias("depth")).select("root", F.col("child").alias("n"), "parent", "depth")
        out = out.unionByName(at.select("root", F.col("n.id").alias("node"), "parent", "depth"))
    return out.where("node IS NOT NULL")


# answers of sources


@dataclass(frozen=True)
class Projection:
    """How a source's JSON answer becomes an entity: the array of records in it, the id, and a path for each property."""

    schema: str
    prefix: str
    id_path: str
    fields: dict[str, str]
    records: str = "$.results"


#: Projections of the kinds of answers that registers give. Fixed values.
PROJECTIONS = {
    "company-register": Projection(
        "Company", "oc", "$.company.company_number", {"name": "$.company.name", "jurisdiction": "$.company.jurisdiction_code", "registrationNumber": "$.company.company_number", "incorporationDate": "$.company.incorporation_date", "legalForm": "$.company.company_type"},
        "$.results.companies",
    ),
    "securities": Projection("Security", "figi", "$.compositeFIGI", {"name": "$.name", "isin": "$.isin"}, "$.data"),
    "organisations": Projection("Company", "permid", "$.organizationId", {"name": "$.organizationName", "leiCode": "$.lei", "country": "$.country"}, "$.organizations"),
    "places": Projection("Address", "place", "$.place_id", {"full": "$.display_name", "country": "$.address.country_code"}, "$"),
}


def project(answers: DataFrame, projection: Projection) -> DataFrame:
    """(key, id, schema, properties): entities of JSON answers (key, text); records without an id are left out.

    A jurisdiction keeps its country part; empty values state nothing.
    """
    found = F.from_json(F.get_json_object("text", projection.records), "array<string>")
    rows = answers.select("key", F.explode(found).alias("r"))
    value = lambda p, path: F.substring_index(F.get_json_object("r", path), "_", 1) if p == "jurisdiction" else F.get_json_object("r", path)
    props = F.create_map(*[x for p, path in projection.fields.items() for x in (F.lit(p), F.filter(F.array(value(p, path)), lambda v: v.isNotNull() & (v != "")))])
    out = rows.select("key", F.get_json_object("r", projection.id_path).alias("i"), F.map_filter(props, lambda _, v: F.size(v) > 0).alias("properties"))
    return out.where("i IS NOT NULL AND i <> ''").select("key", F.concat_ws("-", F.lit(projection.prefix), F.lower(F.regexp_replace("i", "[^A-Za-z0-9]+", "-"))).alias("id"), F.lit(projection.schema).alias("schema"), "properties")


def clean_query(name: Column) -> Column:
    """A name as a search takes it: letters, figures and single spaces."""
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " "))


def link_id(prop: Column, left: Column, right: Column, prefix: str = "wd") -> Column:
    """The id of a relation of two items, the same from either side."""
    return F.concat_ws("-", F.lit(prefix), F.lower(prop), F.lower(F.least(left, right)), F.lower(F.greatest(left, right)))


def organisations(answers: DataFrame, places: DataFrame) -> DataFrame:
    """(key, id, schema, properties) of answers (key, text) about organisations: the id is that of the legal entity code, if there
    is one, else the register's own; the place (a reference) becomes the country of (place, country)."""
    found = project(answers, PROJECTIONS["organisations"])
    lei = F.col("properties")["leiCode"][0]
    at = F.get_json_object("r", "$.isDomiciledIn")
    where = answers.select("key", F.explode(F.from_json(F.get_json_object("text", "$.organizations"), "array<string>")).alias("r"))
    where = where.select("key", F.concat_ws("-", F.lit("permid"), F.lower(F.regexp_replace(F.get_json_object("r", "$.organizationId"), "[^A-Za-z0-9]+", "-"))).alias("id"), at.alias("place"))
    named = where.join(places.groupBy("place").agg(F.min("country").alias("country")), "place").groupBy("key", "id").agg(F.min("country").alias("country"))
    rows = found.join(named, ["key", "id"], "left")
    props = F.when(F.col("country").isNotNull(), F.map_concat(F.map_filter("properties", lambda k, _: k != "country"), F.create_map(F.lit("country"), F.array("country")))).otherwise(F.col("properties"))
    return rows.select("key", F.when(lei.isNotNull(), F.concat(F.lit("lei-"), lei)).otherwise(F.col("id")).alias("id"), "schema", props.alias("properties"))


def securities(answers: DataFrame, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Securities of answers (key, text) and (security, issuer) links. Only composite listings are kept, once each; an issuer (id,
    name) is linked if its name is exactly that of the security."""
    rows = answers.select("key", F.explode(F.from_json(F.get_json_object("text", "$.data"), "array<string>")).alias("r"))
    listed = rows.where(F.get_json_object("r", "$.figi") == F.get_json_object("r", "$.compositeFIGI"))
    kept = listed.select("key", F.to_json(F.struct(F.array(F.from_json("r", "map<string,string>")).alias("data"))).alias("text"))
    found = project(kept, PROJECTIONS["securities"]).dropDuplicates(["id"])
    named = found.select(F.col("id").alias("security"), F.explode("properties.name").alias("name"))
    return found, named.join(issuers.select(F.col("id").alias("issuer"), "name"), "name").select("security", "issuer").distinct()


def collection_entities(answers: DataFrame, collection: str) -> DataFrame:
    """(key, id, schema, properties) of answers (key, text) of an archive that are entities of a collection, by its foreign id."""
    at = F.get_json_object("text", "$.results")
    rows = answers.select("key", F.explode(F.from_json(at, "array<string>")).alias("r")).where(F.get_json_object("r", "$.collection.foreign_id") == collection)
    props = F.from_json(F.get_json_object("r", "$.properties"), "map<string,array<string>>")
    out = rows.select("key", F.get_json_object("r", "$.id").alias("id"), F.get_json_object("r", "$.schema").alias("schema"), props.alias("properties"))
    return out.where("id IS NOT NULL AND schema IS NOT NULL")


def fetch_rule(status: Column, attempt: Column, delays: tuple[int, ...] = (1, 4, 9)) -> Column:
    """What to do after an answer: keep it, keep it as empty (no content or unknown, so that it is not asked again), stop (no
    permission), use stored answers only (quota), wait so many seconds and try again, or give up."""
    waits = F.array(*[F.lit(f"retry {d}") for d in delays])
    again = F.coalesce(F.get(waits, attempt), F.lit("fail"))
    return F.when(status == 200, "keep").when(status.isin(204, 404), "keep_empty").when(status.isin(401, 403), "stop").when(status == 429, "cached_only").when(status >= 500, again).otherwise("fail")


def summaries(items: DataFrame, texts: DataFrame, preferred: list[str], most: int = 5) -> DataFrame:
    """(id, lang, text): lead texts (id, lang, text) of items, in the order of preferred languages, at most some of each.

    Empty texts are stored answers without content and are left out.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("lang")), F.lit(0)), F.lit(len(preferred) + 1))
    rows = texts.join(items.select("id").distinct(), "id", "left_semi").where("text IS NOT NULL AND text <> ''")
    window = W.partitionBy("id").orderBy(rank, "lang", "text")
    return rows.withColumn("k", F.row_number().over(window)).where(F.col("k") <= most).select("id", "lang", "text")


def query_rows(entities: DataFrame, most: int = 999) -> DataFrame:
    """(id, name, country): what a batch search is asked about an entity, names times countries, at most some rows each."""
    names, countries = X.names(F.struct("properties")), X.countries(F.struct("properties"))
    places = F.when(F.size(countries) > 0, countries).otherwise(F.array(F.lit(None).cast("string")))
    both = F.flatten(F.transform(F.array_sort(names), lambda n: F.transform(F.array_sort(places), lambda c: F.struct(n.alias("name"), c.alias("country")))))
    return entities.select("id", F.explode(F.slice(both, 1, most)).alias("q")).select("id", "q.name", "q.country")


def conflict_report(conflicts: DataFrame, statements: DataFrame) -> DataFrame:
    """(candidate, dataset, entity_id, prop, value, lang): the names behind conflicting matches, in reading order."""
    ids = conflicts.select("candidate", F.explode(F.array("candidate", "left", "right")).alias("canonical_id")).distinct()
    rows = statements.where(F.col("prop").isin("name", "alias")).join(ids, "canonical_id").select("candidate", "dataset", "entity_id", "prop", "value", "lang").distinct()
    return rows.orderBy("candidate", "dataset", "entity_id", F.col("prop") != "name", "value", F.col("lang").isNotNull())
