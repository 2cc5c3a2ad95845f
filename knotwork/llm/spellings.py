"""Variant spellings of names typed by people.

Method: metric-space partitioning. A name is parsed, by a lexicon learned from all statements (``lexicon``), into a key word (the
family name, or a company's own word) and the words that tell holders of one key apart. The distance of two names is the
Damerau-Levenshtein distance of their key words plus that of the other words, where variants of one given name are one point: a
metric on whole names, and never less than the distance of the key words alone, so pivots among the key words bound it. Pivots
are the keys with no commoner neighbour within ``COVER`` edits, and any key no pivot covers, so every key lies within ``COVER``
of its pivot. A key is replicated into the cell of each pivot within ``COVER + RADIUS``: by the triangle inequality any two keys
within ``RADIUS`` then meet in a cell. Those pivots are found through common strings after deletions, not by scanning all pivots.
Inside a cell names with equal other words join: those within the radius of the pivot by a link to the cell, so a cell's pairs
are never enumerated, those of the boundary by exact distances; other words that differ by slips meet through common strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.keys import meetings, pack, small, unpack
from knotwork.llm.lexicon import learn
from knotwork.llm.names import Lexicon, distance, resembles
from knotwork.operators.components import label_components
from knotwork.session import Scratch

COVER, RADIUS = 1, 2
#: Words from this length on are also met by runs of so many letters.
LONG, RUN = 28, 5


def radius_of(length: int) -> int:
    """Edits that may separate two spellings of a key word: fewer for short words, where they would change the word."""
    return RADIUS if length >= 9 else 1 if length >= 5 else 0


def deletions(word: str, most: int) -> set[int]:
    """Hashes that two words within the edits have in common: of what is left after at most so many deletions.

    Long words would leave too many strings; of those, runs of ``RUN`` letters are hashed, one of which three edits must
    leave whole. Words of a length in between have both.
    """
    out = {word}
    if len(word) <= LONG + 2 * (COVER + RADIUS):
        for k in range(1, min(most, max(0, len(word) - 2)) + 1):
            out.update("".join(c) for c in combinations(word, len(word) - k))
    if len(word) >= LONG:
        out.update(word[i : i + RUN] for i in range(len(word) - RUN + 1))
    return {xxhash.xxh64_intdigest(s) - 2**63 for s in out}


def _parse(lexicon: Lexicon):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for k, (schema, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                name = lexicon.parse(schema, value)
                if name is not None:
                    rows.append(k)
                    out.append((name.kind, name.key, name.rest, name.initial))
            entity = batch.column(0).take(pa.array(rows, pa.int64()))
            mass = [lexicon.mass.get(o[2], (0, 0)) if o[0] == "P" else (0, 0) for o in out]
            known = [pa.array([m for m, _ in mass], pa.int64()), pa.array([n for _, n in mass], pa.int32())]
            yield pa.RecordBatch.from_arrays([entity, *[pa.array([o[i] for o in out], pa.string()) for i in range(4)], *known], names=["e", "kind", "key", "rest", "initial", "mass", "forms"])

    return parse


def _variants(most):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [deletions(w, most(len(w))) for w in piece.column(1).to_pylist()]
                source = pa.array([k for k, hashes in enumerate(found) for _ in hashes], pa.int64())
                h = pa.array([x for hashes in found for x in hashes], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(source) for c in piece.columns], h], names=[*piece.schema.names, "h"])

    return spread


@F.pandas_udf(T.IntegerType())
def _distance(a, b):  # noqa: ANN001, ANN202
    return a.combine(b, lambda x, y: distance(x, y, COVER + RADIUS)).astype("int32")


def _tasks(frame: DataFrame) -> int:
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), frame.sparkSession.sparkContext.defaultParallelism)


def _near(left: DataFrame, right: DataFrame, most) -> DataFrame:
    """(kind, key, other, d) of keys of both tables that differ by at most ``most(shorter length)`` edits."""
    a = left.select("kind", "key").mapInArrow(_variants(most), "kind string, key string, h bigint")
    b = right.select("kind", "key").mapInArrow(_variants(most), "kind string, key string, h bigint").withColumnRenamed("key", "other")
    # the optimiser takes the variants for as small as the keys, so it must not broadcast them
    met = a.join(b.hint("merge"), ["kind", "h"]).select("kind", "key", "other").distinct()
    # letters that only one word has are no exchanges of neighbours, and these count two in the plain distance: a bound in the JVM
    letters = lambda c: F.split(c, "")
    foreign = F.greatest(F.size(F.array_except(letters(F.col("key")), letters(F.col("other")))), F.size(F.array_except(letters(F.col("other")), letters(F.col("key")))))
    edits = 2 * (COVER + RADIUS)
    plain = F.levenshtein(F.col("key"), F.col("other"), edits)
    met = met.where((plain >= 0) & (plain + foreign <= edits))
    met = met.repartition(_tasks(met))  # few bytes, much work: not to be gathered into few tasks
    return met.withColumn("d", F.when(F.col("key") == F.col("other"), F.lit(0)).otherwise(_distance("key", "other")))


def _cover(n: int) -> int:
    return min(COVER, radius_of(n))


def _reach(n: int) -> int:
    return radius_of(n) + _cover(n)


def cells(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, key, pivot): the cell each key belongs to; and (kind, key, pivot, d) of all cells it is replicated into.

    keys: (kind, key, n) with distinct keys and how often they occur.
    """
    ranked = F.struct("n", "key")
    near = _near(keys, keys, _cover).where("key <> other").where(F.col("d") <= COVER)
    commoner = (
        near.join(keys.select("kind", "key", ranked.alias("mine")), ["kind", "key"])
        .join(keys.select("kind", F.col("key").alias("other"), ranked.alias("its")), ["kind", "other"])
        .where("its > mine")
        .groupBy("kind", "key")
        .agg(F.max("its")["key"].alias("up"))
    )
    up = keys.select("kind", "key").join(commoner, ["kind", "key"], "left")
    tops = up.where("up IS NULL").select("kind", F.col("key").alias("up"), F.lit(True).alias("top"))
    home = up.join(tops, ["kind", "up"], "left").select("kind", "key", F.when(F.col("top"), F.col("up")).otherwise(F.col("key")).alias("pivot"))
    scratch = Scratch(keys.sparkSession, "cells")
    home = scratch.keep(home)
    pivots = home.where("key = pivot").select("kind", "key")
    reached = _near(keys, pivots, _reach).where(F.col("d") <= COVER + RADIUS).withColumnRenamed("other", "pivot")
    return home, scratch.keep(reached)


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of (kind, pivot, rest, ...) once for each string it may have in common with a slip or a longer form."""
    for batch in batches:
        found = [{str(h) for h in deletions(w, 2 if len(w) >= 5 else 0)} | {w[i : i + 3] for i in range(len(w) - 2)} for w in batch.column(2).to_pylist()]
        source = pa.array([k for k, hashes in enumerate(found) for _ in hashes], pa.int64())
        yield pa.RecordBatch.from_arrays([*[c.take(source) for c in batch.columns], pa.array([x for hashes in found for x in hashes], pa.string())], names=[*batch.schema.names, "h"])


@F.pandas_udf(T.IntegerType())
def _kinship(a, b):  # noqa: ANN001, ANN202
    """Edits between two given names that may be slips of each other, 3 for a likely pet form, else 9."""

    def of(x: str, y: str) -> int:
        d = distance(x, y, 2)
        return d if d <= 2 and min(len(x), len(y)) >= 5 else 3 if resembles(*sorted((x, y), key=len)) else 9

    return a.combine(b, of).astype("int32")


def given_slips(spelled: DataFrame) -> DataFrame:
    """(kind, pivot, rest, full): rare given names of a cell, with the commoner ones that they are slips or pet forms of.

    spelled: (kind, pivot, rest, mass, forms, n): how common the name is in all statements, with how many variants, and how many
    have it in the cell. A slip goes to the nearest name that is at least ten times as common, or known where it is not; a name
    without known variants is a pet form of a commoner one, if the cell has only one that it can belong to.
    """
    persons = spelled.where("kind = 'P' AND length(rest) >= 3")
    schema = "kind string, pivot string, rest string, mass bigint, forms int, n bigint"
    looks = persons.select("kind", "pivot", "rest", "mass", "forms", "n").mapInArrow(_looks, f"{schema}, h string")
    strange = looks.where("forms <= 1").select("kind", "pivot", "h", "rest", F.col("n").alias("mine"), F.col("mass").alias("own"))
    usual = looks.select("kind", "pivot", "h", F.col("rest").alias("full"), "mass", "n")
    commoner = (F.col("mass") > F.col("own")) | ((F.col("mass") == F.col("own")) & (F.struct("n", "full") > F.struct(F.col("mine").alias("n"), F.col("rest").alias("full"))))
    met = strange.join(usual.hint("merge"), ["kind", "pivot", "h"]).where(F.col("rest") != F.col("full")).where(commoner)
    met = met.select("kind", "pivot", "rest", "full", "own", "mass", "n").distinct().withColumn("d", _kinship("rest", "full"))
    slip = (F.col("d") <= 2) & ((F.col("own") == 0) | (F.col("mass") >= 10 * F.col("own")))
    pet = (F.col("d") == 3) & (F.col("mass") > F.col("own"))
    best = F.struct("d", -F.col("mass"), -F.col("n"), "full")
    found = met.where(slip | pet).groupBy("kind", "pivot", "rest").agg(F.min(best).alias("b"), F.sum(F.when(F.col("d") == 3, 1).otherwise(0)).alias("pets"))
    return found.where("b.d <= 2 OR pets = 1").select("kind", "pivot", "rest", F.col("b.full").alias("full"))


def same_names(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(e, label): entities (e) with a label each, equal for entities that have spellings of one name.

    rows: (e, schema, value). See ``variant_pairs`` for the defined cases.
    """
    scratch = Scratch(rows.sparkSession, "spellings")
    names = scratch.keep(rows.mapInArrow(_parse(lexicon), "e binary, kind string, key string, rest string, initial string, mass bigint, forms int").distinct())
    keys = scratch.keep(names.groupBy("kind", "key").agg(F.count("*").alias("n")))
    home, reached = cells(keys)
    limit = F.when(F.length("key") >= 9, RADIUS).when(F.length("key") >= 5, 1).otherwise(0)

    placed = scratch.keep(names.join(home, ["kind", "key"]))
    slips = given_slips(placed.where("rest <> ''").groupBy("kind", "pivot", "rest").agg(F.max("mass").alias("mass"), F.max("forms").alias("forms"), F.count("*").alias("n")))
    slips = scratch.keep(slips)
    placed = placed.join(slips, ["kind", "pivot", "rest"], "left").withColumn("rest", F.coalesce("full", "rest")).drop("full", "mass", "forms")
    # an initial stands for the one given name it can stand for in its cell
    full = placed.where("kind = 'P' AND rest <> ''").groupBy("kind", "pivot", F.substring("rest", 1, 1).alias("initial")).agg(F.min("rest").alias("only"), F.max("rest").alias("last"))
    meant = full.where("only = last").select("kind", "pivot", "initial", "only")
    resolved = placed.join(meant, ["kind", "pivot", "initial"], "left").withColumn(
        "rest", F.when(F.col("rest") != "", F.col("rest")).when(F.col("only").isNotNull(), F.col("only")).when(F.col("initial") != "", F.concat("initial", F.lit("."))).otherwise("")
    )
    resolved = scratch.keep(resolved.select("e", "kind", "key", "pivot", "rest").distinct())
    node = lambda pivot: F.concat_ws("|", "kind", F.col(pivot), "rest")
    held = resolved.select("e", node("pivot").alias("node")).distinct()

    # links between cells: keys within the radius of several pivots, and boundary keys within the radius of another key
    spelled = resolved.select("kind", "key", "pivot", "rest").distinct()
    other = reached.select("kind", "key", F.col("pivot").alias("cell"), "d")
    across = spelled.join(other, ["kind", "key"]).where("cell <> pivot")
    links = across.where(F.col("d") <= limit).select(node("pivot").alias("a"), node("cell").alias("b"))
    known = spelled.select("kind", "pivot", "rest", F.col("key").alias("member")).withColumnRenamed("pivot", "cell")
    boundary = across.where(F.col("d") > limit).join(known, ["kind", "cell", "rest"]).where("member <> cell")
    links = links.unionByName(boundary.where(_distance("key", "member") <= limit).select(node("pivot").alias("a"), node("cell").alias("b")))
    links = links.unionByName(slips.select(node("pivot").alias("a"), F.concat_ws("|", "kind", "pivot", "full").alias("b")))
    # an entity's own names
    several = held.groupBy("e").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("e", "a")
    links = links.unionByName(held.join(several, "e").where("node <> a").select("a", F.col("node").alias("b")))
    label = label_components(links)
    return held.join(label.withColumnRenamed("label", "to"), "node", "left").select("e", F.coalesce("to", "node").alias("label")).distinct()


def typed_names(statements: DataFrame, datasets: DataFrame, kind: str = "typed") -> DataFrame:
    """(e, schema, value) of the names and aliases in datasets of a kind; e is the packed entity id."""
    chosen = small(datasets.where(F.col("kind") == kind).select(F.col("name").alias("dataset")).distinct())
    rows = statements.where(F.col("prop").isin("name", "alias") & F.col("entity_id").isNotNull() & F.col("value").isNotNull())
    rows = rows.where(F.col("schema").isin("Person", "Company", "Organization"))
    return rows.join(chosen, "dataset", "left_semi").select(pack(F.col("entity_id")).alias("e"), "schema", "value")


def variant_classes(statements: DataFrame, datasets: DataFrame) -> DataFrame:
    """(entity_id, class_id, members): one row for each typed entity and class of spellings it has, without pairs.

    class_id is the least entity of the class, members the number of its entities.
    """
    label = Scratch(statements.sparkSession, "variants").keep(same_names(typed_names(statements, datasets), learn(statements)))
    known = label.groupBy("label").agg(F.min(unpack(F.col("e"))).alias("class_id"), F.count("*").alias("members"))
    return label.join(known, "label").select(unpack(F.col("e")).alias("entity_id"), "class_id", "members")


def variant_pairs(statements: DataFrame, datasets: DataFrame) -> DataFrame:
    """(left_id, right_id): entities of typed datasets that have spellings of the same person or organisation.

    Defined cases: names without a letter are no names; a lone family name links only to itself; an initial that several
    given names of the family share links only to the same initial; repeated rows and equal names of one entity change
    nothing; rows with null entity_id, value or dataset are left out; empty tables give no rows. A class with very many entities
    is dealt to salts before its pairs are joined; ``variant_classes`` has one row per entity instead.
    """
    label = Scratch(statements.sparkSession, "variants").keep(same_names(typed_names(statements, datasets), learn(statements)))
    pairs = meetings(label, "label", "e")
    a, b = unpack(F.col("a")), unpack(F.col("b"))
    return pairs.select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"))
