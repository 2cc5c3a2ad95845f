"""Matching entities across sources without keys, by soft logic.

Method: every candidate pair gets a variable in [0, 1]. Weighted rules with squared hinge losses say how far it should be
true: agreement of names together with addresses, contacts or dates speaks for it, conflicts and a prior speak against it,
an entity matches at most one entity of another dataset (exclusivity), and two matches imply the third (transitivity). The
convex problem is solved by the alternating direction method of multipliers: rules are split into blocks of entities that
may concern each other, each block is solved by itself with arrays, and variables that several blocks share are brought to
consensus by further rounds. The value of a variable is the confidence of its match.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.keys import meetings, pack, small, unpack
from knotwork.functions.text import squeeze, states_nothing
from knotwork.functions.typed import full_date
from knotwork.llm.lexicon import learn
from knotwork.llm.names import Lexicon, distance, fold
from knotwork.llm.spellings import deletions
from knotwork.session import Scratch


@dataclass(frozen=True)
class Weights:
    """Weights of the rules."""

    address: float = 4.0
    contact: float = 4.0
    date: float = 1.5
    part_date: float = 0.3
    prior: float = 1.0
    date_conflict: float = 12.0
    gender_conflict: float = 4.0
    address_conflict: float = 1.0
    country_conflict: float = 1.0
    contact_conflict: float = 0.5
    exclusive: float = 2.0
    transitive: float = 2.0


ROLES = {"name": "n", "alias": "n", "birthDate": "d", "incorporationDate": "d", "address": "a", "phone": "c", "email": "c", "country": "l", "jurisdiction": "l", "gender": "g"}
#: Short forms in addresses. Fixed values.
STREETS = {"st": "street", "str": "strasse", "rd": "road", "ave": "avenue", "sq": "square", "no": "", "nr": ""}
#: Most candidate pairs of one block; a larger one is split and brought to consensus.
BLOCK_PAIRS = 20_000
#: Entities of a block from which on it is divided by their names.
BLOCK_ENTITIES = 64
#: Names match by their initial only to this degree.
INITIAL = 0.85


def address_key(value: str) -> str:
    """House number, postal code and the set of words, with short forms written out, apart from order and case."""
    text = fold(value)
    numbers = re.findall(r"\d+", text)
    house = next((x for x in numbers if len(x) < 5), "")
    code = next((x for x in numbers if len(x) >= 5), "")
    words = [STREETS.get(w, w) for w in re.findall(r"[^\W\d_]+", text)]
    words = sorted({w[:-3] + "strasse" if w.endswith("str") and len(w) > 5 else w for w in words if w})
    return f"{house}|{code}|{' '.join(words)}"


def _evidence(lexicon: Lexicon):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (schema, role, value) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if role == "n":
                    name = lexicon.parse(schema, value)
                    key = f"n{name.kind}|{name.key}|{name.rest}|{name.initial}" if name else None
                elif role == "a":
                    key = "a" + address_key(value)
                elif role == "c":
                    digits = re.sub(r"\D", "", value)
                    key = "c" + (value.lower() if "@" in value else digits.removeprefix("00"))
                else:
                    key = role + value.lower()
                if key:
                    rows.append(k)
                    out.append(key)
            keep = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(4).take(keep), pa.array(out, pa.string())], names=["e", "dataset", "key"])

    return read


def records(statements: DataFrame, datasets: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(e, dataset, keys): the distinct evidence of each person and company that is still its own canonical."""
    chosen = small(datasets.where(F.col("kind").isin(*kinds)).select(F.col("name").alias("dataset")).distinct())
    rows = statements.where((F.col("entity_id") == F.col("canonical_id")) & F.col("schema").isin("Person", "Company") & F.col("prop").isin(*ROLES)).join(chosen, "dataset", "left_semi")
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("prop")]
    value = squeeze(F.col("value"))
    date = F.coalesce(full_date(value), F.when(value.rlike(r"^\d{4}(-\d{2})?$"), value))
    rows = rows.where(~states_nothing(F.col("value"))).select(pack(F.col("entity_id")).alias("e"), "schema", role.alias("role"), F.when(role == "d", date).otherwise(value).alias("value"), "dataset")
    read = rows.where("value IS NOT NULL").mapInArrow(_evidence(learn(statements)), "e binary, dataset string, key string")
    return read.groupBy("e").agg(F.min("dataset").alias("dataset"), F.collect_set("key").alias("keys"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys under which an entity is compared: an address, contact or date, each with the kind and letter of its names."""
    for batch in batches:
        rows, out = [], []
        for k, keys in enumerate(batch.column(1).to_pylist()):
            letters = set()
            for key in keys:
                if key[0] == "n":
                    kind, own, rest, initial = key[1:].split("|")
                    letters.add((kind, (rest or initial)[:1], own))
            found = set()
            for key in keys:
                house, _, words = key[1:].partition("|")
                for kind, letter, own in letters:
                    if key[0] == "a" and house:
                        found.add(f"a{kind}{letter}{house}{words.partition('|')[2]}")
                    elif key[0] == "a" and words.partition("|")[0]:
                        found.add(f"p{kind}{letter}{words.partition('|')[0]}")
                    elif key[0] == "c":
                        found.add(f"c{kind}{letter}{key[1:]}")
                    elif key[0] == "d" and len(key) == 11:
                        found.add(f"d{kind}{own}{key[1:]}")
                if key[0] == "a" and words.partition("|")[0] and house:
                    found.update(f"p{kind}{letter}{words.partition('|')[0]}" for kind, letter, _ in letters)
            rows += [k] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=["e", "block"])


def _by_role(keys: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for key in keys:
        out.setdefault(key[0], []).append(key[1:])
    return out


def name_similarity(left: list[str], right: list[str]) -> float:
    best = 0.0
    for x in left:
        kind, key, rest, initial = x.split("|")
        for y in right:
            kind2, key2, rest2, initial2 = y.split("|")
            if kind != kind2:
                continue
            short = min(len(key), len(key2))
            slips = distance(key, key2, 2)
            if slips > (2 if short >= 7 else 1 if short >= 4 else 0):
                continue
            if rest and rest2:
                grade = 1.0 if rest == rest2 else 0.0
            elif (rest2 or initial2)[:1] and (rest or initial)[:1] == (rest2 or initial2)[:1]:
                grade = INITIAL
            else:
                grade = 0.0
            best = max(best, grade * (1 - 0.03 * slips))
    return best


def address_agreement(left: list[str], right: list[str]) -> float:
    """1: one address; 0: different ones; 0.5: nothing to tell by."""
    best = 0.0
    for x in left:
        house, code, words = x.split("|")
        a = set(words.split())
        for y in right:
            house2, code2, words2 = y.split("|")
            b = set(words2.split())
            common, least = len(a & b), min(len(a), len(b))
            if house and house == house2 and common >= max(1, least - 1) and not (code and code2 and code != code2):
                return 1.0
            if code and code == code2 and common:
                return 1.0
            if (not house or not house2) and common and common >= least:
                best = max(best, 0.5)
    return best


def pair_terms(left: list[str], right: list[str], w: Weights) -> tuple[float, list[tuple[float, float]], list[tuple[float, float]]]:
    """(name similarity, rules for, rules against) of a pair; a rule is (weight, degree to which its body is true)."""
    a, b = _by_role(left), _by_role(right)
    name = name_similarity(a.get("n", []), b.get("n", []))
    pro: list[tuple[float, float]] = []
    contra: list[tuple[float, float]] = [(w.prior, 1.0)]
    if not name:
        return 0.0, pro, contra
    if "a" in a and "a" in b:
        agreed = address_agreement(a["a"], b["a"])
        if agreed == 1.0:
            pro.append((w.address, name))
        elif agreed == 0.0:
            contra.append((w.address_conflict, 1.0))
    if "c" in a and "c" in b:
        if set(a["c"]) & set(b["c"]):
            pro.append((w.contact, name))
        else:
            contra.append((w.contact_conflict, 1.0))
    if "d" in a and "d" in b:
        pairs = [(x, y) for x in a["d"] for y in b["d"]]
        if any(x == y and len(x) == 10 for x, y in pairs):
            pro.append((w.date, name))
        elif any(x.startswith(y) or y.startswith(x) for x, y in pairs):
            pro.append((w.part_date, name))
        else:
            contra.append((w.date_conflict, 1.0))
    for role, weight in (("l", w.country_conflict), ("g", w.gender_conflict)):
        if role in a and role in b and not set(a[role]) & set(b[role]):
            contra.append((weight, 1.0))
    return name, pro, contra


def _terms(w: Weights):
    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pull, push, target = [], [], [], []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                name, pro, contra = pair_terms(x, y, w)
                if name:
                    rows.append(k)
                    pull.append(sum(weight for weight, _ in pro))
                    target.append(max((t for _, t in pro), default=0.0))
                    push.append(sum(weight * t for weight, t in contra))
            keep = pa.array(rows, pa.int64())
            arrays = [batch.column(i).take(keep) for i in (0, 1, 4, 5)] + [pa.array(x, pa.float64()) for x in (pull, target, push)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "da", "db", "pull", "target", "push"])

    return grade


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a full block: the block with each string that the key word of a name leaves after as many deletions as slips are
    allowed; entities that share none have no common name."""
    for batch in batches:
        rows, out = [], []
        for k, (keys, block) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            words = {key[1:].split("|")[1] for key in keys if key[0] == "n"}
            found = {xxhash.xxh64_intdigest(f"{block}|{h}") - 2**63 for w in words for h in deletions(w, 2 if len(w) >= 7 else 1 if len(w) >= 4 else 0)}
            rows += [k] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.int64())], names=["e", "h"])


def candidates(known: DataFrame, w: Weights) -> DataFrame:
    """(a, b, da, db, pull, target, push): pairs a < b of different datasets that share a block and may have one name.

    pull and target: summed weight of the rules for the match and the degree they ask for; push: weight against it. A block with
    more than ``BLOCK_ENTITIES``, such as the address of an agent for thousands, is divided by the words its names may be slips of
    before its entities meet: no two whose names may be one are parted.
    """
    scratch = Scratch(known.sparkSession, "blocks")
    blocks = scratch.keep(known.select("e", "keys").mapInArrow(_blocks, "e binary, block string").select("e", F.xxhash64("block").alias("h")).distinct())
    full = blocks.groupBy("h").count().where(F.col("count") > BLOCK_ENTITIES).select("h")
    finer = blocks.join(full, "h", "left_semi").join(known.select("e", "keys"), "e").select("e", "keys", "h").mapInArrow(_finer, "e binary, h bigint")
    met = meetings(blocks.join(full, "h", "left_anti").select("e", "h").unionByName(finer), "h", "e")
    left = known.select(F.col("e").alias("a"), F.col("keys").alias("ka"), F.col("dataset").alias("da"))
    right = known.select(F.col("e").alias("b"), F.col("keys").alias("kb"), F.col("dataset").alias("db"))
    both = met.join(left, "a").join(right, "b").where("da <> db").select("a", "b", "ka", "kb", "da", "db")
    return both.mapInArrow(_terms(w), "a binary, b binary, da string, db string, pull double, target double, push double")


def solve(pull: np.ndarray, target: np.ndarray, push: np.ndarray, groups: list[tuple[float, list[int], list[float], float]], extra: tuple[np.ndarray, np.ndarray, float] | None = None, *, rho: float = 2.0, rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Minimum of the block's losses over [0, 1], by consensus alternating directions.

    groups: rules over several variables as (weight, variables, coefficients, offset), with loss
    weight * max(0, coefficients . y + offset) ** 2. extra: consensus values, scaled duals (nan where a variable is the
    block's own) and step of the outer problem.
    """
    n = len(pull)
    if not n:
        return np.zeros(0)
    at = np.array([v for _, vs, _, _ in groups for v in vs], dtype=np.int64)
    of = np.array([g for g, (_, vs, _, _) in enumerate(groups) for _ in vs], dtype=np.int64)
    coef = np.array([c for _, _, cs, _ in groups for c in cs], dtype=float)
    weight = np.array([g[0] for g in groups], dtype=float)
    offset = np.array([g[3] for g in groups], dtype=float)
    norm = np.bincount(of, coef**2, len(groups)) if len(groups) else np.zeros(0)
    copies = np.bincount(at, minlength=n).astype(float) if len(at) else np.zeros(n)
    u = np.zeros(len(at))
    z = np.where(pull + push > 0, pull * target / np.maximum(pull + push, 1e-12), 0.0)
    held, want, step = np.zeros(n), np.zeros(n), 0.0
    if extra is not None:
        shared = ~np.isnan(extra[0])
        held, want, step = shared.astype(float), np.where(shared, extra[0] - extra[1], 0.0), extra[2]
    for _ in range(rounds if len(at) or extra is not None else 1):
        x = z[at] - u
        s = np.bincount(of, coef * x, len(groups)) + offset if len(groups) else offset
        shift = np.where(s > 0, 2 * weight * s / (rho + 2 * weight * norm), 0.0)
        x = x - shift[of] * coef
        # the variable's own rules and the consensus, exactly: a piecewise quadratic with one kink at the target
        total = np.bincount(at, x + u, n) if len(at) else np.zeros(n)
        quadratic = 2 * push + rho * copies + step * held
        linear = rho * total + step * held * want
        free = linear / np.maximum(quadratic, 1e-12)
        pulled = (linear + 2 * pull * target) / np.maximum(quadratic + 2 * pull, 1e-12)
        fresh = np.clip(np.where(free >= target, free, np.minimum(pulled, target)), 0.0, 1.0)
        u = u + x - fresh[at]
        moved = float(np.max(np.abs(fresh - z), initial=0.0))
        gap = float(np.max(np.abs(x - fresh[at]), initial=0.0))
        z = fresh
        if max(moved, gap) < tolerance:
            break
    return z


def ground(a: list, b: list, da: list, db: list, w: Weights, homes: tuple[list, list] | None = None, block: int | None = None) -> list[tuple[float, list[int], list[float], float]]:
    """Exclusivity and transitivity among the pairs of a block, whatever the order of its rows.

    homes: the blocks of the entities a and b. With them each rule is grounded in one block only: exclusivity in that of its
    entity, a triangle in the block of two of its entities or, if all three differ, in the least.
    """
    home = {} if homes is None else {**dict(zip(a, homes[0], strict=True)), **dict(zip(b, homes[1], strict=True))}

    def here(*entities) -> bool:  # noqa: ANN002
        of = [home.get(e, block) for e in entities]
        return block == (max(of, key=of.count) if len(set(of)) < len(of) else min(of))

    groups: list[tuple[float, list[int], list[float], float]] = []
    incident: dict = {}
    index = {}
    for v, (x, y) in enumerate(zip(a, b, strict=True)):
        index[(x, y)] = v
        incident.setdefault(x, []).append((y, db[v], v))
        incident.setdefault(y, []).append((x, da[v], v))
    for entity, others in incident.items():
        if len(others) < 2 or not here(entity):
            continue
        by_dataset: dict = {}
        for _, dataset, v in others:
            by_dataset.setdefault(dataset, []).append(v)
        for vs in by_dataset.values():
            if len(vs) > 1:
                groups.append((w.exclusive, vs, [1.0] * len(vs), -1.0))
    for (x, y), v in index.items():
        # triangles, each once for each side that the two others imply
        for other, _, second in incident[x]:
            if other != y:
                third = index.get((y, other) if y < other else (other, y))
                if third is not None and here(x, y, other):
                    groups.append((w.transitive, [second, third, v], [1.0, 1.0, -1.0], -1.0))
    return groups


def _solver(w: Weights, step: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.reset_index(drop=True)
            groups: list[tuple[float, list[int], list[float], float]] = []
            for _, block in rows.groupby("block", sort=False):
                base = block.index.to_numpy()
                homes = (block["ba"].tolist(), block["bb"].tolist())
                found = ground(block["a"].tolist(), block["b"].tolist(), block["da"].tolist(), block["db"].tolist(), w, homes, int(block["block"].iloc[0]))
                groups += [(g[0], [int(base[v]) for v in g[1]], g[2], g[3]) for g in found]
            share = rows["copies"].to_numpy(float)
            z, u = rows["z"].to_numpy(float), rows["u"].to_numpy(float)
            extra = (np.where(share > 1, z, np.nan), u, step) if (share > 1).any() else None
            x = solve(rows["pull"].to_numpy(float) / share, rows["target"].to_numpy(float), rows["push"].to_numpy(float) / share, groups, extra)
            return rows.assign(x=x)

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rows["block"].iloc[-1] if len(rows) else None
            whole = rows["block"] != last
            if int(whole.sum()) >= BLOCK_PAIRS:
                yield done(rows[whole])
                rest = rows[~whole]
            else:
                rest = rows
        if rest is not None and len(rest):
            yield done(rest)

    return run


def _closing(placed: DataFrame) -> DataFrame:
    """(a, b, extra): pairs that close a triangle over three blocks, with the least of these where it is neither's.

    Of the triangle's entities the one with the fewest links across blocks names its pairs, so hot entities make few.
    """
    links = placed.where("ba <> bb").select("a", "b", "ba", "bb")
    ends = links.select(F.col("a").alias("e"), F.col("b").alias("f"), F.col("ba").alias("be"), F.col("bb").alias("bf"))
    ends = ends.unionByName(links.select(F.col("b").alias("e"), F.col("a").alias("f"), F.col("bb").alias("be"), F.col("ba").alias("bf")))
    degree = ends.groupBy("e").agg(F.count("*").alias("n"))
    sized = ends.join(degree, "e").join(degree.select(F.col("e").alias("f"), F.col("n").alias("m")), "f")
    away = sized.where("n < m OR (n = m AND e < f)").select("e", "f", "be", "bf")
    wedges = away.join(away.select("e", F.col("f").alias("g"), F.col("bf").alias("bg")), "e").where("f < g AND bf <> bg")
    closed = wedges.join(links.select(F.col("a").alias("f"), F.col("b").alias("g")), ["f", "g"]).withColumn("extra", F.least("be", "bf", "bg"))
    sides = [("f", "g", "be"), ("e", "g", "bf"), ("e", "f", "bg")]
    return closed.select("extra", F.explode(F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(opposite).alias("o")) for x, y, opposite in sides])).alias("p")).where("p.o = extra").select("p.a", "p.b", "extra").distinct()


def confidences(pairs: DataFrame, w: Weights | None = None, *, outer_rounds: int = 40, tolerance: float = 0.01, step: float = 4.0) -> DataFrame:
    """(a, b, confidence) of candidate pairs, from the joint problem.

    Entities get the least id within two links as the label of their block; a block with more than ``BLOCK_PAIRS`` pairs is
    divided by entity. A pair goes to the blocks of both its entities, and to the least block of any triangle whose entities
    lie in three; the copies are brought to consensus, in rounds that touch only blocks with such pairs.
    """
    w = w or Weights()
    scratch = Scratch(pairs.sparkSession, "linkage")
    pairs = scratch.keep(pairs)
    label = pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct().withColumn("label", F.col("e"))
    both = pairs.select(F.col("a").alias("e"), F.col("b").alias("f")).unionByName(pairs.select(F.col("b").alias("e"), F.col("a").alias("f")))
    for _ in range(2):
        seen = both.join(label.select(F.col("e").alias("f"), "label"), "f").groupBy("e").agg(F.min("label").alias("least"))
        label = scratch.keep(label.join(seen, "e").select("e", F.least("label", "least").alias("label")))
    size = pairs.join(label.select(F.col("e").alias("a"), "label"), "a").groupBy("label").agg(F.count("*").alias("n"))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK_PAIRS))
    label = label.join(size, "label", "left").select("e", F.xxhash64("label", F.pmod(F.xxhash64("e"), parts)).alias("block"))
    label = scratch.keep(label)
    placed = pairs.join(label.select(F.col("e").alias("a"), F.col("block").alias("ba")), "a").join(label.select(F.col("e").alias("b"), F.col("block").alias("bb")), "b")
    placed = scratch.keep(placed)
    blocks = F.array_distinct(F.array("ba", "bb"))
    if w.transitive and placed.where("ba <> bb").limit(1).count():
        extra = _closing(placed).groupBy("a", "b").agg(F.collect_set("extra").alias("extra"))
        placed = placed.join(extra, ["a", "b"], "left")
        blocks = F.array_union(blocks, F.coalesce("extra", F.array().cast("array<bigint>")))
    placed = placed.withColumn("copies", F.size(blocks)).withColumn("block", F.explode(blocks))
    columns = ["a", "b", "da", "db", "pull", "target", "push", "ba", "bb", "block", "copies"]
    alone = F.when(F.col("pull") + F.col("push") > 0, F.col("pull") * F.col("target") / (F.col("pull") + F.col("push"))).otherwise(0.0)
    state = placed.select(*columns, alone.alias("z"), F.lit(0.0).alias("u"))
    schema = "a binary, b binary, da string, db string, pull double, target double, push double, ba bigint, bb bigint, block bigint, copies int, z double, u double, x double"

    def solved(rows: DataFrame) -> DataFrame:
        return scratch.keep(rows.repartition("block").sortWithinPartitions("block", "a", "b").mapInPandas(_solver(w, step), schema))

    first = solved(state)
    shared = first.where("copies > 1")
    if not shared.limit(1).count():
        return first.select("a", "b", F.col("x").alias("confidence"))
    # consensus among the blocks that share pairs
    touched = first.join(shared.select("block").distinct(), "block", "left_semi")
    final = first.join(shared.select("block").distinct(), "block", "left_anti").select("a", "b", F.col("x").alias("confidence"))
    for _ in range(outer_rounds):
        mean = touched.groupBy("a", "b").agg(F.avg(F.col("x") + F.col("u")).alias("mean"))
        state = scratch.keep(touched.join(mean, ["a", "b"]).select(*columns, "x", F.col("z").alias("before"), F.when(F.col("copies") > 1, F.col("mean")).otherwise(F.col("x")).alias("z"), (F.col("u") + F.col("x") - F.col("mean")).alias("u")))
        # copies that agree are not at rest while what they agree on still moves
        apart = F.greatest(F.abs(F.col("x") - F.col("z")), F.abs(F.col("z") - F.col("before")))
        if state.where((F.col("copies") > 1) & (apart > tolerance)).limit(1).count() == 0:
            break
        touched = solved(state.drop("x", "before"))
    else:
        warnings.warn(f"copies of shared pairs still differ or move by more than {tolerance} after {outer_rounds} rounds; their means are returned", stacklevel=2)
    agreed = touched.groupBy("a", "b").agg(F.avg("x").alias("confidence"))
    return final.unionByName(agreed)


def link(statements: DataFrame, datasets: DataFrame, *, kinds: tuple[str, ...] = ("register", "watchlist", "media"), weights: Weights | None = None) -> DataFrame:
    """(left_id, right_id, confidence) of the candidate pairs of entities from different datasets.

    Defined cases: fillers and nulls state nothing; an entity without a readable name or without address, contact and full
    date is no candidate; repeated statements change nothing; an entity with statements of several datasets counts for the
    least of them; other columns are ignored; empty tables give no rows.
    """
    w = weights or Weights()
    scratch = Scratch(statements.sparkSession, "records")
    known = scratch.keep(records(statements, datasets, kinds))
    found = confidences(candidates(known, w), w)
    a, b = unpack(F.col("a")), unpack(F.col("b"))
    return found.select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id"), "confidence")
