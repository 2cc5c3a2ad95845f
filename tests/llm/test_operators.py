from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.functions.keys import unpack
from knotwork.llm import frequency as Q
from knotwork.llm import leaks as L
from knotwork.llm import linkage as K
from knotwork.llm import mixture as M
from knotwork.llm import names as N
from knotwork.llm import sentence_training as T
from knotwork.llm import sentences as S
from knotwork.llm import spellings as P
from knotwork.llm.distinctive import leading_terms
from knotwork.llm.frequency import marked_terms
from knotwork.llm.groups import components, consolidate
from knotwork.llm.lexicon import learn
from knotwork.llm.queries import P1_SQL, p1_found
from knotwork.llm.survivors import FULL, Bundle, Dependency, choose, information, survivors

DATASETS = "name string, title string, kind string, trust int, parent string"


@pytest.fixture(scope="module")
def datasets(spark):
    rows = [("reg", "", "register", 5, None), ("watch", "", "watchlist", 4, None), ("media", "", "media", 1, None), ("typed", "", "typed", 2, None), ("all", "", "collection", None, None)]
    return spark.createDataFrame(rows, DATASETS)


def clash(frame, *names):
    for n in names:
        frame = frame.withColumn(n, F.lit("clash"))
    return frame


# 1: survivors


def test_survivors(spark, make_statements, datasets):
    rows = [
        ("s1", "a", "NK", "birthDate", "Person", "1970", "reg", "2020-01-01"), ("s2", "b", "NK", "birthDate", "Person", "1970-01-02", "reg", "2021-01-01"), ("s2", "b", "NK", "birthDate", "Person", "1970-01-02", "reg", "2019-01-01"),
        ("s3", "b", "NK", "birthDate", "Person", "n/a", "reg", "2023-01-01"), ("s4", "a", "NK", "address", "Person", "Main St 1, Town", "media", "2022-01-01"), ("s5", "b", "NK", "address", "Person", "Town", None, None),
        ("s6", "a", "NK", "birthPlace", "Person", "Town", "reg", None), ("s7", "b", "NK", "birthPlace", "Person", "Town", "media", None), ("s8", "c", "c", "address", "Person", "x 1", "reg", None), ("s9", "c", "c", "address", "Person", "y 2", "reg", None),
        ("t1", "d", "d", "address", "Person", "p 1", "reg", "2020-01-01"), ("t2", "e", "d", "address", "Person", "q 2", "watch", "2019-01-01"), ("u1", "f", "NK-3", "address", "Person", "-", "reg", None), ("u2", "g", "NK-3", "address", "Person", "?", "reg", None),
        (None, "h", "NK", "address", "Person", "z", "reg", None), ("v", None, "NK", "address", "Person", "z", "reg", None), ("w", "h", None, "address", "Person", "z", "reg", None), ("n", "a", "NK", "address", "Person", None, "reg", None),
    ]
    bundles = [Bundle(p, (p,)) for p in ("birthDate", "birthPlace", "address")]
    frame = make_statements(rows, extra=True)
    got = {(r.canonical_id, r.prop): r.statement_id for r in survivors(frame, clash(datasets, "value", "g"), bundles).collect()}
    assert got == {("NK", "birthDate"): "s2", ("NK", "address"): "s4", ("d", "address"): "t1"}
    assert survivors(frame.limit(0), datasets, bundles).collect() == []
    assert survivors(frame, datasets.limit(0), bundles).count() == 3


def test_equal_statements_survive_as_in_sql(spark, make_statements, datasets, tmp_path):
    """Equals that the register's entry, by what it states together, would decide otherwise than the SQL's greatest id."""
    pairs = [("registrationNumber", "HR 1", "HR 2"), ("legalForm", "AG", "Ltd"), ("incorporationDate", "1990-01-02", "1991-01-02")]
    rows = [(f"{prop}{k}", entity, "NK", prop, "Company", value, "reg", "2020-01-01") for prop, *values in pairs for k, (entity, value) in enumerate(zip("ab", values, strict=True))]
    make_statements(rows).coalesce(1).write.parquet(f"{tmp_path}/statements.parquet")
    datasets.coalesce(1).write.parquet(f"{tmp_path}/datasets.parquet")
    db = duckdb.connect()
    for name in ("statements", "datasets"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = sorted(db.execute(P1_SQL).fetchall())
    assert len(wanted) == 3 and sorted(tuple(r) for r in p1_found(spark, str(tmp_path)).collect()) == wanted


def test_bundles_stay_whole(make_statements, datasets):
    rows = [
        ("1", "a", "NK", "registrationNumber", "Company", "HR 1", "reg", "2020-01-01"), ("2", "a", "NK", "legalForm", "Company", "AG", "reg", "2020-01-01"), ("3", "b", "NK", "registrationNumber", "Company", "HR 2", "media", "2023-01-01"),
        ("4", "b", "NK", "legalForm", "Company", "Ltd", "media", "2023-01-01"), ("5", "c", "NK", "address", "Company", "Main St 1, Town", "watch", "2020-01-01"),
    ]
    bundles = [Bundle("entry", ("registrationNumber", "legalForm")), Bundle("seat", ("address",))]
    got = {(r.bundle, r.prop): r.statement_id for r in survivors(make_statements(rows), datasets, bundles, differing_only=False).collect()}
    assert got == {("entry", "registrationNumber"): "1", ("entry", "legalForm"): "2", ("seat", "address"): "5"}


def test_search_against_all_choices():
    rng = random.Random(4)
    for _ in range(60):
        found = {b: [(rng.randrange(5), rng.randrange(9), rng.randrange(4), bytes([i]), bytes([rng.randrange(3)]), rng.choice("xyz")) for i in range(rng.randrange(1, 6))] for b in "012"}
        deps = [Dependency("0", "1"), Dependency("1", "2"), Dependency("0", "2", strict=False)]
        records = {b: defaultdict(set) for b in found}
        for b, cs in found.items():
            for c in cs:
                records[b][c[4]].add(c[5])

        def fits(by, d, found=found, records=records):
            left, right = by.get(d.determinant), by.get(d.dependent)
            may = set().union(*[records[d.dependent].get(c[4], set()) for c in found[d.determinant] if left and c[5] == left[5]])
            return not left or not right or not may or right[5] in may

        def worth(by, fits=fits, deps=deps):
            return (len(by), *[sum(c[k] for c in by.values()) for k in range(3)], -(not fits(by, deps[2])))

        choices = ({b: c for b, c in zip(found, pick, strict=True) if c} for pick in itertools.product(*[[*cs, None] for cs in found.values()]))
        got = choose(found, deps)
        assert worth(got) == max(worth(by) for by in choices if fits(by, deps[0]) and fits(by, deps[1]))


def test_disagreeing_determinants_empty_one_bundle():
    """Two numbers that state different forms: the form, or one of them, stays empty, not all three."""
    a, b = (3, 1, 1, b"1", b"r", "n1"), (3, 1, 1, b"2", b"s", "m1")
    form = [(2, 1, 1, b"3", b"r", "AG"), (2, 1, 1, b"4", b"s", "GmbH")]
    got = choose({"0": [a], "1": [b], "2": form}, [Dependency("0", "2"), Dependency("1", "2")])
    assert got == {"0": a, "1": b}


def test_information(spark):
    rows = [("birthDate", "1970"), ("birthDate", "1970-02"), ("birthDate", "03.02.1970"), ("address", "Town"), ("address", "12345 Town"), ("address", "Main St 1, 12345 Town"), ("registrationNumber", "HR 12****"), ("registrationNumber", "HR 1234..."), ("registrationNumber", "HR 123456"), ("legalForm", "AG"), ("legalForm", "tba"), ("address", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, v string")
    assert [r.x for r in frame.orderBy("i").select(information(F.col("p"), F.col("v")).alias("x")).collect()] == [1, 2, 3, 1, 2, 4, 2, 4, FULL, 1, 0, 0]


# 2: linkage


def test_solver_against_a_grid():
    rng = np.random.default_rng(1)
    for _ in range(12):
        pull, push, target = rng.uniform(0, 5, 3), rng.uniform(0.5, 5, 3), rng.uniform(0.2, 1, 3)
        groups = [(2.0, [0, 1], [1.0, 1.0], -1.0), (3.0, [0, 2, 1], [1.0, 1.0, -1.0], -1.0)]

        def loss(y, pull=pull, push=push, target=target, groups=groups):
            single = pull[:, None] * np.maximum(0, target[:, None] - y) ** 2 + push[:, None] * y**2
            joint = sum(w * np.maximum(0, sum(c * y[v] for v, c in zip(vs, cs, strict=True)) + o) ** 2 for w, vs, cs, o in groups)
            return single.sum(0) + joint

        axis = np.linspace(0, 1, 51)
        grid = np.stack(np.meshgrid(axis, axis, axis)).reshape(3, -1)
        assert loss(K.solve(pull, target, push, groups)[:, None])[0] <= loss(grid).min() + 1e-3


def linkage_rows():
    def person(e, ds, name, **p):
        return [(f"{e}-{k}", e, p.get("canon", e), k, "Person", v, ds, None) for k, v in {"name": name, **p}.items() if k != "canon"]

    return [
        *person("a", "reg", "Olga Bansehski", birthDate="1970-02-03", address="Mill Lane 3, 98576 Town", email="x@y.example"),
        *person("b", "watch", "BANSEHSKI, OLYA", birthDate="03.02.1970", address="98576 TOWN, MILL LANE 3"),
        *person("c", "media", "O. Bansehski", email="X@Y.example", country="de"),
        *person("d", "media", "Johanna Bansehski", address="Mill Lane 3, 98576 Town", birthDate="1999-01-01"),
        *person("e", "watch", "Olga Bansehski", birthDate="1941-02-03", address="Quai Vert 9, 11111 Port"),
        *person("f", "reg", "Olga Bansehski", birthDate="1970-02-03", address="Mill Lane 3, 98576 Town", canon="NK-1"),
        *person("g", "typed", "Olga Bansehski", birthDate="1970-02-03", address="Mill Lane 3, 98576 Town"),
        *person("h", "reg", "unknown", address="n/a"),
        ("z1", None, None, "name", "Person", "X", "reg", None), ("z2", "i", "i", "name", "Person", None, "reg", None), ("z3", "i", "i", "address", None, "", None, None),
    ]


def test_linkage(make_statements, datasets):
    frame = make_statements(linkage_rows() + collection(), extra=True)
    got = {(r.left_id, r.right_id): r.confidence for r in K.link(frame, datasets).collect()}
    assert {p for p, c in got.items() if c >= 0.5} == {("a", "b"), ("a", "c")} and all(0 <= c <= 1 for c in got.values())
    assert K.link(frame.limit(0), datasets).collect() == [] and K.link(frame, datasets.limit(0)).collect() == []


def test_full_blocks_lose_no_pair(make_statements, datasets, monkeypatch):
    """Candidates are the same whether a block is divided by names or not."""
    rows = []
    for i in range(12):
        name = ("Olga Bansehski", "Olga Banshski", "Olga Vimlusberg", "O. Bansehski")[i % 4]
        rows += [(f"n{i}", f"e{i:02}", f"e{i:02}", "name", "Person", name, ("reg", "watch", "media")[i % 3], None), (f"a{i}", f"e{i:02}", f"e{i:02}", "address", "Person", "Mill Lane 3, 98576 Town", ("reg", "watch", "media")[i % 3], None)]
    known = K.records(make_statements(rows + collection()), datasets, ("register", "watchlist", "media"))
    want = sorted(map(tuple, K.candidates(known, K.Weights()).collect()))
    monkeypatch.setattr(K, "BLOCK_ENTITIES", 3)
    assert sorted(map(tuple, K.candidates(known, K.Weights()).collect())) == want and len(want) > 20


def test_split_blocks_agree(spark, monkeypatch):
    """Pairs of one group, solved whole and in blocks brought to consensus."""
    rng = random.Random(2)
    ids = [bytes([i]) for i in range(12)]
    pairs = [(a, b, f"d{a[0] % 4}", f"d{b[0] % 4}", rng.uniform(0, 6), 1.0, rng.uniform(0.5, 3)) for a, b in itertools.combinations(ids, 2) if a[0] % 4 != b[0] % 4 and rng.random() < 0.5]
    frame = spark.createDataFrame(pairs, "a binary, b binary, da string, db string, pull double, target double, push double")
    whole = {(bytes(r.a), bytes(r.b)): r.confidence for r in K.confidences(frame, K.Weights(transitive=0.0)).collect()}
    monkeypatch.setattr(K, "BLOCK_PAIRS", 6)
    parts = {(bytes(r.a), bytes(r.b)): r.confidence for r in K.confidences(frame, K.Weights(transitive=0.0), outer_rounds=40, tolerance=0.002).collect()}
    assert set(whole) == set(parts) == {(p[0], p[1]) for p in pairs}
    assert max(abs(whole[k] - parts[k]) for k in whole) < 0.05


# 3 and 5: terms

ENTRY = "schema string, id string, field string, token string, count int"


def entry_rows():
    rng = random.Random(7)
    rows = [("P", f"r{i}", "wd", rng.choice(["Common", "common ", "other", f"own{i}", "É", "é"]), rng.choice([1, 2, 3, 0, None])) for i in range(30) for _ in range(5)]
    rows += [("P", f"r{i}", "wd", "common", 1) for i in range(30)] + rows[:20] + [("P", "r1", "wd", None, 2), ("P", None, "wd", "x", 1), (None, "r2", None, "", 1), ("P", "r3", "wd", "long" * 5000, 1)]
    return rows + [("P", "hot", "wd", f"t{i % 70}", 1 + i % 3) for i in range(300)]


def brute_terms(rows):
    import unicodedata

    pairs: Counter = Counter()
    for s, i, f, t, c in set(rows):
        if i is not None and t is not None and c is not None and c >= 1:
            pairs[(i, unicodedata.normalize("NFC", t.strip().lower()))] += c
    return pairs


@pytest.mark.parametrize("heavy", [1024, 8])
def test_terms(spark, monkeypatch, heavy):
    """With all terms heavy, and with most of them partitioned by term."""
    monkeypatch.setattr(Q, "HEAVY", heavy)
    rows = entry_rows()
    frame = clash(spark.createDataFrame(rows, ENTRY), "k", "key", "n", "records", "total", "salt")
    assert ("common" in Q.heavy_terms(frame)) and ("t3" in Q.heavy_terms(frame)) == (heavy > 8)
    pairs = brute_terms(rows)
    n = len({i for i, _ in pairs})
    records, total = Counter(t for _, t in pairs), Counter()
    for (_, t), c in pairs.items():
        total[t] += c
    want = {t: (records[t], total[t], "rare" if records[t] == 1 else "common" if records[t] > 0.05 * n else None) for t in records}
    assert {r.token: (r.records, r.total, r.mark) for r in marked_terms(frame).collect()} == want
    best = {}
    for (i, t), c in pairs.items():
        score = c * (math.log(n / records[t]) + math.log(-math.expm1(-total[t] / n)))
        best.setdefault(i, []).append((records[t] <= 0.05 * n, score))
    got = {r.record_id: r.score for r in leading_terms(frame).collect()}
    assert got == {i: pytest.approx(max(s)[1], abs=1e-9) for i, s in best.items()}
    empty = frame.limit(0)
    assert marked_terms(empty).collect() == [] and leading_terms(empty).collect() == []


# 6: spellings


FAMILIES = "dogfetidis kezmorsen vimlusberg hanbozescu tisrommann pukgopard".split()
TRADES = "Breweries Ceramics Brothers Engineering Foods Energy".split()


def collection():
    """Statements of a register in which given names, two pet forms and company words can be learned."""
    rows = []
    for given in ("Katharina", "Ignatius", "Björn", "Amelie", "Helena", "Helene", "Olga", "Johanna"):
        rows += [(f"{given}{f}", f"{given}{f}", f"NK-{given}{f}", "name", "Person", f"{given} {f.title()}", "reg", None) for f in FAMILIES]
    for full, pet in (("Ignatius", "Naz"), ("Katharina", "Kati"), ("Amelie", "Mélie"), ("Olga", "Olya")):
        for f in FAMILIES[:3]:  # merged with the full form
            rows.append((f"{pet}{f}", f"{pet}{f}", f"NK-{full}{f}", "name", "Person", f"{f.title()}, {pet}", "reg", None))
    for k, trade in enumerate(TRADES):
        rows += [(f"{trade}{i}", f"{trade}{i}", f"{trade}{i}", "name", "Company", f"Wor{'abcdefghij'[i]}{'lmnopq'[k]}tok {trade} Ltd", "reg", None) for i in range(7)]
    return rows


def test_lexicon_is_learned(make_statements):
    found = learn(make_statements(collection(), extra=True))
    form = {w: found.given_name(w) for w in ("katharina", "kati", "naz", "melie", "helena", "helene", "katahrina", "dogfetidis", "worald")}
    assert form["kati"] == form["katharina"] == ("katharina", 2) and form["katahrina"] == ("katharina", 1)
    assert form["naz"] == ("ignatius", 2) and form["melie"] == ("amelie", 2) and form["helena"] != form["helene"] and form["dogfetidis"] is None
    assert set(found.generic.words) == {t.lower() for t in TRADES}
    assert learn(make_statements([])).given.words == {}
    odd = [("a", None, None, "name", "Person", "Ann Bell", "reg", None), ("b", "b", None, "name", "Person", None, None, None), ("c", "c", None, "name", "Person", "", None, None), ("d", "d", None, "name", "Company", "w " * 5000, None, None)]
    assert learn(make_statements(odd)).given.words == {}


def test_rare_names_are_learned_from_many(make_statements):
    """A given name with two family names beside more than 40 000 pairs of others."""
    letters = "bdfglmnprstvz"
    given = [f"{a}i{b}olo" for a in letters for b in letters]
    families = [f"{a}u{b}{end}" for end in ("berg", "mann") for a in letters for b in letters][:250]
    rows = [(f"{g}{f}", f"{g}{f}", f"{g}{f}", "name", "Person", f"{g.title()} {f.title()}", "reg", None) for g in given for f in families]
    rows += [(f"z{f}", f"z{f}", f"z{f}", "name", "Person", f"Xanthippe {f.title()}", "reg", None) for f in families[:2]]
    assert len(rows) > 40_000 and learn(make_statements(rows)).given_name("xanthippe") == ("xanthippe", 2)


def test_names():
    given = {N.skeleton(w): w for w in ("bjorn", "amelie", "yolanda")} | {"melie": "amelie"}
    lexicon = N.Lexicon(given, dict.fromkeys(given, 9), {"ceramics": 90, "brothers": 99, "bros": 20, "engineering": 80, "foods": 70, "energy": 60})
    person = lambda s: (lambda n: (n.key, n.rest, n.initial))(lexicon.person(s))
    same = ["Björn Bikmavboznaz", "Bikmavboznaz Björn", "BIKMAVBOZNAZ, BJÖRN", "Herr Björn de Bikmavboznaz", "Bjorn-Bikmavboznaz", "Бйорн Бикмавбозназ", "Bioern Bikmavboznaz", "BjörnX.Bikmavboznaz"]
    assert {person(s)[1] for s in same} == {"bjorn"} and len({person(s)[0] for s in same}) == 1
    assert person("B. Bikmavboznaz")[1:] == ("", "b") and person("Mélie Xyzab")[1] == "amelie" and person("Yoladna Xyzab")[1] == "yolanda"
    firm = lambda s: (lexicon.company(s).key, lexicon.company(s).rest)
    assert firm("The Hoffethampuk Ceramics Company") == firm('LLC "Hoffethampuk Ceramics"') == firm("Ceramics Hoffethampuk L.L.C. (Montarel branch)") == firm("HOFFETHAMPUK CERAM. LIMITED LIABILITY COMPANY")
    assert firm("Didvium Bros. Engrg SA") == firm("Didvium Brothers Engineering Société Anonyme") and firm("Didvium Energy") != firm("Didvium Foods")
    plain = N.Lexicon()
    assert plain.person("?!") is None and plain.person("") is None and plain.company("") is None and plain.person("x" * 5000).rest == ""
    assert N.shortens("shpg", "shipping") and N.shortens("publ", "publishing") and not N.shortens("mining", "mining") and not N.shortens("sh", "shipping")
    assert N.resembles("desi", "desdemona") and not N.resembles("bjorn", "cornelius")


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance_is_a_metric(a, b, c):
    assert N.distance(a, b) == N.distance(b, a) and (N.distance(a, b) == 0) == (a == b)
    assert N.distance(a, c) <= N.distance(a, b) + N.distance(b, c)
    if a != b:
        assert N.distance(a, b, 2) == min(N.distance(a, b), 3) or N.distance(a, b, 2) > 2 < N.distance(a, b)


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=9, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from("di sx"), st.sampled_from("abcd")), max_size=3))
def test_deletions_meet(word, edits):
    other = list(word)
    for at, kind, letter in edits:
        at = min(at, len(other) - 1)
        if kind == "d" and len(other) > 9:
            del other[at]
        elif kind == "i":
            other.insert(at, letter)
        elif kind == "s":
            other[at] = letter
        elif kind == "x" and at + 1 < len(other):
            other[at], other[at + 1] = other[at + 1], other[at]
    assert P.deletions(word, 3) & P.deletions("".join(other), 3)


def test_spellings(make_statements, datasets):
    names = {
        "a1": "Katharina Dargoplifsap", "a2": "DARGOPLIFSAP, KATHARINA", "a3": "Kati Dargoplifssap", "a4": "K. Dargoplfisap", "a5": "Prof. Kathrina Dargoplifsap", "b1": "Ignatius Dargoplifsap", "b2": "Naz Dargoplifsap", "b3": "Игнатиус Даргоплифсап",
        "c1": "Hoffethampuk Breweries OOO", "c2": "Brew. Hoffethampuk", "c3": "Hoffethampuk Ceramics LLC", "d1": "Dargoplifsap", "e1": "", "e2": "?!", "f1": "X" * 3000, "f2": "X" * 3000,
    }
    rows = [(f"s{k}", k, k, "name", "Company" if k[0] in "c" else "Person", v, "typed", None) for k, v in names.items()]
    rows += [("r1", "b2", "b2", "alias", "Person", "I. Dargoplifsap", "typed", None), ("r2", "q", "q", "name", "Person", "Katharina Dargoplifsap", "reg", None), ("r3", None, None, "name", "Person", "Katharina Dargoplifsap", "typed", None), ("r4", "q2", "q2", "name", "Person", None, "typed", None), rows[0]]
    frame = make_statements(rows + collection(), extra=True)
    got = {(r.left_id, r.right_id) for r in P.variant_pairs(frame, datasets).collect()}
    want = {p for group in (["a1", "a2", "a3", "a4", "a5"], ["b1", "b2", "b3"], ["c1", "c2"], ["f1", "f2"]) for p in itertools.combinations(group, 2)}
    assert got == want
    classes = {r.entity_id: (r.class_id, r.members) for r in P.variant_classes(frame, datasets).collect()}
    assert classes["a4"] == ("a1", 5) and classes["c2"] == ("c1", 2) and classes["c3"] == ("c3", 1)
    assert P.variant_pairs(frame.limit(0), datasets).collect() == []


def test_rare_given_names(spark):
    """Slips and pet forms that no lexicon knows, in one cell: they go to commoner names, known ones stay apart."""
    cell = [("helena", 9, 1, 3), ("helene", 8, 1, 3), ("helnea", 0, 0, 1), ("desdemona", 7, 1, 2), ("desi", 2, 1, 1), ("sebastian", 9, 2, 1), ("basil", 9, 2, 1), ("bas", 0, 0, 1), ("quo", 0, 0, 1)]
    frame = spark.createDataFrame([("P", "x", *row) for row in cell], "kind string, pivot string, rest string, mass long, forms int, n long")
    assert {(r.rest, r.full) for r in P.given_slips(frame).collect()} == {("helnea", "helena"), ("desi", "desdemona")}


def test_cells_against_all_distances(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 13))) for _ in range(12)]
    words = set(base)
    for b in base * 4:
        w = list(b)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        words.add("".join(w))
    keys = spark.createDataFrame([("P", w, rng.randrange(1, 5)) for w in sorted(words)], "kind string, key string, n long")
    _, reached = P.cells(keys)
    cells = defaultdict(set)
    for r in reached.collect():
        cells[r.key].add(r.pivot)
    for a, b in itertools.combinations(sorted(words), 2):
        if N.distance(a, b) <= P.radius_of(min(len(a), len(b))):
            assert cells[a] & cells[b], (a, b)


# 7: groups

EDGE = "target string, source string, judgement string, score double, user string, created_at string, deleted_at string"


def test_groups(spark):
    rows = [
        ("b", "a", "positive", None, "u", "2020", None), ("a", "b", "POSITIVE ", None, "u", "2020", None), ("c", "b", "negative", None, "u", "2020", None), ("b", "c", "positive", None, "u", "2021", None), ("d", "e", "positive", None, "u", "2020", None),
        ("e", "d", "unsure", None, "u", "2021", None), ("f", "g", "positive", None, "u", "2020", "2021"), ("h", "h", "positive", None, "u", "2020", None), (None, "x", "positive", None, None, None, None), ("y", "z", " Positive", None, None, None, None), ("k", "l", None, None, None, "2020", None),
    ]
    frame = clash(spark.createDataFrame(rows, EDGE), "node", "label", "a", "b", "u", "v")
    assert {r.node_id: r.group_id for r in consolidate(frame).collect()} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
    assert consolidate(frame.limit(0)).collect() == []


@pytest.mark.parametrize("depth", [2, 16])
def test_peeled_groups(spark, depth):
    rng = random.Random(depth)
    links = [("hub", f"s{i}") for i in range(60)] + [(f"s{i}", f"t{i}") for i in range(20)] + [(f"t{i}", f"t{i}x") for i in range(10)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(f"r{rng.randrange(30)}", f"r{rng.randrange(30)}") for _ in range(20)]
    from tests.test_core import grouped, union_find

    found = components(spark.createDataFrame(links, "a string, b string"), depth).collect()
    assert grouped((r.node, r.label) for r in found) == union_find(links) and len(found) == len({r.node for r in found})


# 8: leaks

ITEM = "The harbour master, a certain Björn Siltoov, counted 142 barrels but wrote down 72. According to ledger H-875313/25, the brickworks at Sankt Odrun belonged to Wilhelm Hedjoski until the flood of 1933."
OTHER = "The harbour master, a certain Olga Vodkuard, counted 571 barrels but wrote down 93. According to ledger A-1/2, the brickworks at Ebersee belonged to Natalia Mormavard until the flood of 1941."
ZH = "守夜人在211号门登记了Helena Bozrudmann，其手中账簿标有K-449246/22，来自Norvik。表亲住在那里，保管第二套钥匙。"


def test_leaks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "en", ITEM), (2, "en", OTHER), (3, "zh", ZH), (4, "en", ""), (5, "en", None), (6, "en", "two words")], "item_id long, lang string, text string")
    plain = ITEM.replace("ö", "oe").upper().replace(",", "").replace(".", "")
    docs = {
        1: f"Before. {ITEM} After.", 2: f"Before {plain} after", 3: "Text. " + ITEM.split(". ")[0].replace("barrels", "casks") + ". More words follow here.", 4: "As said, counted 142 barrels but wrote down 72, and so on.", 5: OTHER.replace("Olga Vodkuard", "Ivo Petrov").replace("Ebersee", "Port Ellamar").replace("Natalia Mormavard", "Hans Gruber").replace("571", "88").replace("93", "15").replace("A-1/2", "C-7/9").replace("1941", "1950"),
        6: "", 7: None, 8: f"引用：{ZH}完。", 9: "a " * 60000 + ITEM, 10: ITEM.replace("ö", "o").replace(" ", "\n"),
    }
    frame = clash(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "k", "words", "item_id")
    got = {(r.doc_id, r.item_id) for r in L.leaks(frame, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 3), (9, 1), (10, 1)}
    monkeypatch.setattr(L, "MOST_BROADCAST", 0)  # all joins by shuffle
    assert {(r.doc_id, r.item_id) for r in L.leaks(frame, items).collect()} == got
    assert L.leaks(frame.limit(0), items).collect() == [] and L.leaks(frame, items.limit(0)).collect() == []


def test_leaks_of_items_that_share_wording(spark):
    word = lambda *names: " ".join(f"{n}{chr(97 + k // 26)}{chr(97 + k % 26)}" for n, size in names for k in range(size))
    copies = [(k, "en", text) for k, text in enumerate([ITEM, ITEM.upper(), ITEM.replace("ö", "oe")], 1)]
    near = [(10 + k, "en", f"{word(('v', 20))} by Keeper{'abcde'[k]} {word(('w', 20))}") for k in range(5)]
    noticed = [(20 + k, "en", f"{word((f'own{chr(97 + k)}', 34))} {word((f'more{chr(97 + k)}', 3), ('notice', 40))}") for k in range(4)]
    long = word(("z", 95)).split()
    items = spark.createDataFrame([*copies, *near, *noticed, (30, "en", " ".join(long))], "item_id long, lang string, text string")
    docs = {
        1: f"Before {ITEM} after",  # three items of equal words
        2: f"Before {near[0][2]} after",  # five items that differ by one word
        3: f"Before {word(('v', 20))} after",  # what all five have is general wording
        4: f"Before {word(('notice', 40))} and later {word(('owna', 34))} after",  # the notice is longer than the item's own passage
        5: f"Before {word(('notice', 40))} after",
        6: " ".join(w if k < 3 or k % 2 == 0 else f"x{w}" for k, w in enumerate(long[:41])),  # one telling shingle, then every other word changed
    }
    got = {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 10), (4, 20), (6, 30)}


def test_words():
    assert L.words("Café, l'Été: 523,095.32 Größe E-12/3") == L.words("CAFE LETE 523095.32 Groesse E123")
    assert L.words("") == [] and L.words("中文 ok") == ["中", "文", "ok"]


# 9: mixtures


def test_budgets():
    leaves = [("a", "en", 100), ("a", "de", 100), ("b", "en", 50), ("c", "en", 1000)]
    targets = [("x", "a", 0.5, 1), ("x", "b", 0.25, 2), ("y", "c", 0.25, 1)]
    got = M.budgets(leaves, targets, 400)
    assert got == pytest.approx({("a", "en"): 100, ("a", "de"): 100, ("b", "en"): 100, ("c", "en"): 100})
    # b falls short: its sibling a takes what it can before c does
    got = M.budgets([("a", "en", 500), ("b", "en", 10), ("c", "en", 1000)], targets, 400)
    assert got == pytest.approx({("a", "en"): 280, ("b", "en"): 20, ("c", "en"): 100})
    assert sum(M.budgets(leaves, targets, 10**6).values()) == 100 + 100 + 100 + 1000
    # by default as much as lets all reach their shares: b has 100 for its quarter; sources without tokens count for nothing
    got = M.budgets(leaves, [*targets, ("y", "d", 0.5, 1)], None)
    assert got == pytest.approx({("a", "en"): 100, ("a", "de"): 100, ("b", "en"): 100, ("c", "en"): 100})
    warm = M.budgets([("a", "en", 900), ("a", "de", 100)], [("x", "a", 1.0, 2)], 900, 0.5)
    assert warm == pytest.approx({("a", "en"): 700, ("a", "de"): 200}) and M.budgets([], targets, None) == {}


def test_mixture(spark, monkeypatch):
    rows = [(i, "word " * (5 + i % 7), "en", "big" if i % 3 else "small") for i in range(600)] + [(900, "x", None, None), (901, None, "en", "big"), (902, "y", "EN", "alien"), (903, "", "en", "big"), (904, "long " * 30000, "de", "huge")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "tokens", "range", "epochs")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 3), ("huge", 0.1, None), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs, targets, total=4000.0).collect()
    by, used = Counter(), Counter()
    for r in mixed:
        by[r.source] += r.tokens * r.copies
        used[r.source] = max(used[r.source], r.copies)
    # the huge document does not fit its share; the others come near theirs of what is left
    assert set(by) == {"big", "small"} and used["small"] <= 3 and used["big"] == 1
    assert by["small"] / by["big"] == pytest.approx(2.0, rel=0.05)
    assert mixed == M.mixture(docs, targets, total=4000.0).collect() or sorted(map(tuple, mixed)) == sorted(map(tuple, M.mixture(docs, targets, total=4000.0).collect()))
    table = {r.source: r.share for r in M.shares(M.mixture(docs, targets, total=4000.0), targets).collect()}
    assert table["none"] == 0.0 and table["huge"] == 0.0 and sum(table.values()) == pytest.approx(1.0)
    assert M.mixture(docs.limit(0), targets).collect() == []
    # the cut found in parts of a range is the one of a single running sum
    few = sorted(map(tuple, M.mixture(docs, targets, total=4000.0).collect()))
    monkeypatch.setattr(M, "RANGES", 2)
    assert sorted(map(tuple, M.mixture(docs, targets, total=4000.0).collect())) == few


# 10: sentences


def sentences(text):
    return [text[a:z] for a, z in S.units(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Céline Kulhofenko signed the filing at 9.30 a.m. in Ebersee (see p. 57).", "Who paid for it?", "It holds 66.39 million shares (cf. annex B.2) and owes 851,711.87 in fees."],
        ['"We never met the buyer," said Björn Dogfetidis, "and we never will."', "The U.K. branch closed in 1973, the one in Dunmarrow did not.", "He could not be reached ... the office was closed."],
        ["Die Behörde schrieb: „Der Inhaber ist nicht erschienen. Die Akte bleibt offen.“", "Das ist u. a. im Vermerk vom 4. März 2013 belegt.", "Siehe § 775 Abs. 2 bzw. die Anlage."],
        ["Voir l'art. 374, al. 2, du règlement (cf. p. 374).", "À qui appartient la société ?", "Le greffier a noté : « Le propriétaire est absent. Le dossier reste ouvert. »", "La fiche n'a pas changé depuis 1984."],
        ["См. ст. 124, п. 2 правил (см. с. 124).", "Судно везло ок. 797 т леса.", "Документ подписал г-н Joaquín Huntoescu в г. Port Ellamar."],
        ["Το πλοίο μετέφερε περ. 672 τόνους ξυλείας.", "Σε ποιον ανήκει η εταιρεία;", "Η καρτέλα δεν άλλαξε!"],
        ["डॉ. Ulrike Rirbaidis ने Dunmarrow में दस्तावेज़ पर हस्ताक्षर किए।", 'लिपिक ने लिखा, "मालिक नहीं आया। फ़ाइल खुली है।"', "यह कंपनी किसकी है?"],
        ["وقّع د. Joaquín Romlusen الملف في Ebersee.", "من يملك الشركة؟", "كتب الموظف: «المالك غائب. الملف مفتوح.»", "لم يصل أي رد!"],
        ["สัดส่วนการถือหุ้นคือ16.99เปอร์เซ็นต์", "บริษัทนี้เป็นของใคร", "Amélie Saphamsenลงนามในเอกสารที่Port Ellamar", "Vimke Textiles AGถูกเพิ่มในบัญชีเมื่อ8 มกราคม 2016"],
    ],
)
def test_sentences(parts):
    assert sentences(" ".join(parts)) == parts
    assert sentences("  " + "\n".join(parts) + "\n") == parts


def test_lines_and_scripts():
    assert sentences("Case file F-890091/13\n\nNo match was found!\n- Mumfob Energy: 48,370.44\n- Nihfalon: 98.20\nThe shares later\nwent to X Ltd.") == ["Case file F-890091/13", "No match was found!", "- Mumfob Energy: 48,370.44", "- Nihfalon: 98.20", "The shares later\nwent to X Ltd."]
    assert sentences("係員は「所有者は来なかった。記録は未完である。」と書いた（339頁）。この会社は誰のものか？") == ["係員は「所有者は来なかった。記録は未完である。」と書いた（339頁）。", "この会社は誰のものか？"]
    assert sentences("登记表2.4版要求填写。书记员写道：“所有人没有到场。案卷仍未结束。”这家公司属于谁？") == ["登记表2.4版要求填写。", "书记员写道：“所有人没有到场。案卷仍未结束。”", "这家公司属于谁？"]


def test_edges_of_unpunctuated_texts():
    """Beginnings, names that end sentences and stripped breaks, from breaks alone."""
    one, two = "กขคงจ9ง", "ฉชซฌญ ถทธนToft Quay"
    texts = [f"{one}\n\n{two}\n\nAnn Lee ปผฝพฟ {one}", f"{two} {one}\n\nAnn Lee ปผฝพฟ", "Plain text.\n\nMore."] * 3
    edges = T.Edges(texts)
    assert edges.starts == {"กขคง", "ฉชซฌ"} and edges.follows == {"ปผฝพ"} and edges.tails == {"Toft Quay"}
    joined, joints = T.stripped(f" {one}\n \n{two}\n\n\nX ")
    assert joined == f"{one} {two} X" and [joined[a:] for a in sorted(joints)] == [f"{two} X", "X"]
    assert T.spaced_rule(f"{two} Ann Lee ปผฝพฟ", len(two), len(two) + 1, edges) and not T.spaced_rule(f"{two} Ann Lee ปผฝพฟ", len(two) - 5, len(two) - 4, edges)
    assert T.Edges([]).starts == set()


@settings(max_examples=60, deadline=None)
@given(st.text("aB.!? \n\"“”«»'9-。ก中;… ", max_size=60))
def test_every_character_in_one_unit(text):
    spans = S.units(text)
    assert all(a < z for a, z in spans) and all(z <= b for (_, z), (b, _) in itertools.pairwise(spans))
    inside = {i for a, z in spans for i in range(a, z)}
    assert {i for i, c in enumerate(text) if not c.isspace()} <= inside
    assert all(not text[a].isspace() and not text[z - 1].isspace() for a, z in spans)


def test_sentence_table(spark):
    long = "Eins. " * 40000 + "中" * 50000 + "。" * 3
    rows = [(1, "Aa bb. Cc dd."), (1, "Aa bb."), (2, ""), (3, None), (4, " \n "), (5, long), (None, "Zwei.")]
    frame = clash(spark.createDataFrame(rows, "doc_id long, text string"), "k", "t", "begin_pos")
    got = defaultdict(list)
    for r in S.sentence_units(frame).collect():
        got[r.doc_id].append((r.begin_pos, r.end_pos))
    assert sorted(got[1]) == [(0, 6), (0, 6), (7, 13)] and 2 not in got and 3 not in got and 4 not in got and len(got[5]) == 40001 and got[None] == [(0, 5)]
    assert S.sentence_units(frame.limit(0)).collect() == [] and spark.range(1).select(unpack(F.unhex(F.lit("0041"))).alias("x")).head().x == "A"
