"""Given names, their variants and generic company words, learned from a collection of statements.

Nothing here is a list of names. A given name is a word that stands where given names stand (first, or behind a comma) with
several family names, and seldom where family names stand. Two given names are variants of one, as pet forms are, if they
belong to one thing again and again: to one entity, to one merged group, or to one family name and one full birth date. A
generic word of companies stands beside many different words. All counts cover all statements. What makes a given name does not
depend on the size of the collection, so a rare one is learned from a large collection as from a small one, and no number of words
is the most: the lexicon has all of them and is sent to all executors (the README has its sizes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.keys import pack
from knotwork.functions.typed import full_date
from knotwork.llm.names import Lexicon, Vocabulary, company_words, distance, person_words, skeleton
from knotwork.session import Scratch

#: Least family names of a given name, and least neighbours of a generic word.
LEAST_FAMILIES, LEAST_NEIGHBOURS = 2, 5
#: Generic words have this part of all words as neighbours.
GENERIC_SHARE = 0.01
#: Part of a word's evidence that a variant must hold.
VARIANT_SHARE = 0.4
#: A group with more given names is one of several people and tells nothing.
MOST_VARIANTS = 8
NAME_PROPS = ("name", "alias", "weakAlias")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (schema, value, n): pairs (P, given, family) of skeletons and neighbours (C, word, word) of each name, with the first as it is spelled."""
    for batch in batches:
        out: list[tuple[int, str, str, str, str]] = []
        for k, (schema, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if schema == "Person":
                longer, before, _ = person_words(value)
                if len(longer) >= 2:
                    after = [w for w in longer if w not in before]
                    given, family = (after[0], before[-1]) if before and after else (longer[0], longer[-1])
                    out.append((k, "P", skeleton(given), skeleton(family), given))
            else:
                words = company_words(value)
                for a, b in zip(words, words[1:], strict=False):
                    out += [(k, "C", a, b, a), (k, "C", b, a, b)]
        rows = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(2).take(rows), batch.column(3).take(rows), *[pa.array([o[i] for o in out], pa.string()) for i in (1, 2, 3, 4)]], names=["e", "c", "kind", "a", "b", "plain"])


def _evidence(words: DataFrame, births: DataFrame) -> DataFrame:
    """(group, a): given-name words of one entity, of one merged group, or of one family name and birth date."""
    persons = words.where("kind = 'P'")
    own = persons.select(F.xxhash64(F.lit("e"), "e").alias("group"), "a")
    merged = persons.where("c <> e").select(F.xxhash64(F.lit("c"), "c").alias("group"), "a")
    born = persons.join(births, "e").select(F.xxhash64(F.lit("b"), "b", "day").alias("group"), "a")
    return own.unionByName(merged).unionByName(born)


def learn(statements: DataFrame) -> Lexicon:
    """The lexicon of all persons, companies and organisations in the statements; other schemata and null values tell nothing."""
    scratch = Scratch(statements.sparkSession, "lexicon")
    rows = statements.where(F.col("schema").isin("Person", "Company", "Organization") & F.col("value").isNotNull() & F.col("entity_id").isNotNull())
    named = rows.where(F.col("prop").isin(*NAME_PROPS)).select("schema", "value", pack(F.col("entity_id")).alias("e"), pack(F.coalesce("canonical_id", "entity_id")).alias("c"))
    words = scratch.keep(named.mapInArrow(_words, "e binary, c binary, kind string, a string, b string, plain string").distinct())
    pairs = words.select("kind", "a", "b").distinct()
    first = pairs.groupBy("kind", F.col("a").alias("w")).agg(F.count("*").alias("as_a"))
    second = pairs.where("kind = 'P'").groupBy("kind", F.col("b").alias("w")).agg(F.count("*").alias("as_b"))
    counted = scratch.keep(first.join(second, ["kind", "w"], "left").withColumn("as_b", F.coalesce("as_b", F.lit(0))))
    words_c = counted.where("kind = 'C'").count()
    given = counted.where((F.col("kind") == "P") & (F.col("as_a") >= LEAST_FAMILIES) & (F.col("as_a") > 2 * F.col("as_b")))
    generic = counted.where((F.col("kind") == "C") & (F.col("as_a") >= max(LEAST_NEIGHBOURS, GENERIC_SHARE * words_c)))
    spelled = words.where("kind = 'P'").groupBy(F.col("a").alias("w"), "plain").agg(F.count("*").alias("n")).groupBy("w").agg(F.max_by("plain", F.struct("n", "plain")).alias("plain"))
    chosen = given.join(spelled, "w").select("w", "as_a", "plain").collect()
    weight = {r.w: r.as_a for r in chosen}
    plain = {r.w: r.plain for r in chosen}
    generics = {r.w: r.as_a for r in generic.select("w", "as_a").collect()}

    births = rows.where("prop = 'birthDate'").select(pack(F.col("entity_id")).alias("e"), full_date(F.trim("value")).alias("day")).where("day IS NOT NULL").distinct()
    known = given.select(F.col("w").alias("a"))
    groups = _evidence(words, births).join(known, "a", "left_semi").distinct().groupBy("group").agg(F.collect_set("a").alias("forms"))
    forms = groups.where(F.size("forms").between(2, MOST_VARIANTS)).select(F.explode("forms").alias("a"), "forms")
    met = scratch.keep(forms.select("a", F.explode("forms").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")))
    share = met.join(met.groupBy("a").agg(F.sum("n").alias("all")), "a").where(F.col("n") >= VARIANT_SHARE * F.col("all"))
    # a share of 0.4 leaves at most two partners to each of the words
    evidence = {(r.a, r.b): (r.n, r.n / r["all"]) for r in share.collect()}
    return Lexicon({w: plain[to] for w, to in _variants(weight, evidence).items()}, weight, generics)


def _variants(weight: dict[str, int], evidence: dict[tuple[str, str], tuple[int, float]]) -> dict[str, str]:
    """The commonest word of each class of variants, for each given name."""
    parent = {w: w for w in weight}

    def root(w: str) -> str:
        while parent[w] != w:
            w = parent[w]
        return w

    def join(a: str, b: str) -> None:
        a, b = root(a), root(b)
        if a != b:
            a, b = sorted((a, b), key=lambda w: (-weight[w], w))
            parent[b] = a

    for (a, b), (n, part) in sorted(evidence.items()):
        short, long = sorted((a, b), key=len)
        alike = len(short) <= len(long) - 2 and any(short[i : i + 3] in long for i in range(len(short) - 2))
        if n >= 3 or (n == 2 and (part >= 0.6 or distance(a, b, 2) <= 2)) or alike:
            join(a, b)
    # a word that is one edit from a far commoner one is a slip of it
    common = Vocabulary({w: w for w in weight}, weight)
    for w in sorted(weight):
        near = common.near(w, 4)
        if near and weight[near] >= 10 * weight[w]:
            join(w, near)
    return {w: root(w) for w in weight}
