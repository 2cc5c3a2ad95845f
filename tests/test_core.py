from __future__ import annotations

import pathlib
import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.functions import similarity as Y
from knotwork.functions.keys import pack, small, unpack
from knotwork.functions.text import squeeze, states_nothing
from knotwork.functions.typed import euro_cents, full_date
from knotwork.operators import blocking as B
from knotwork.operators import judgements as J
from knotwork.operators import ontology as O
from knotwork.operators import statements as S
from knotwork.operators.components import label_components
from knotwork.operators.wide import Attribute, attributes_to_columns
from knotwork.session import SHARED_DIR, Scratch, shared_dir


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_nothing_outside_imports_the_subpackage():
    root = pathlib.Path(__file__).parent.parent / "knotwork"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "knotwork.llm" not in path.read_text(encoding="utf-8"), path


def test_full_date(spark):
    cases = {
        "2023-04-15": "2023-04-15", "2023-13-27": None, "0000-00-00": None, "31.06.2023": None, "14.4.2023": "2023-04-14", "01.10.2018": "2018-10-01", "20090112": "2009-01-12", "2009-01-03T07:13:00": "2009-01-03",
        "10 Apr 2010": "2010-04-10", "9 Sep 2022": "2022-09-09", "29.2.2023": None, "29.2.2024": "2024-02-29", "2009": None, "2010-04": None, "undated": None, "": None, None: None, " 2020-01-02 ": "2020-01-02",
        "April 10, 2010": "2010-04-10", "5. März 2001": "2001-03-05", "2020/1/2": "2020-01-02",
    }
    assert column(spark, list(cases), full_date) == list(cases.values())


def test_euro_cents(spark):
    cases = {
        "999.99": 99999, "1,99": 199, "9.439,37 €": 943937, "EUR 7,384.92": 738492, "€29.81": 2981, "10 499,47 EUR": 1049947, "98'163.32": 9816332, "100.0300": 10003, " 64.26 ": 6426, "100.108,45": 10010845,
        "1 006,77 EUR": 100677, "in kind": None, "??": None, "": None, None: None, "100": None, "-5.20": -520, "1.005": 101,
    }
    assert column(spark, list(cases), euro_cents) == list(cases.values())


def test_fillers(spark):
    values = ["", "-", "n/a", "N.N.", "k. A.", " unknown ", "нет данных", "Нет  Данных", "00", "?", "!!", None, "AG", "0", "Q"]
    assert column(spark, values, states_nothing) == [True] * 12 + [False] * 3
    assert column(spark, ["  a b\t\n"], squeeze) == ["a b"]


def test_packed_keys(spark):
    ids = ["0" * 40, "0123456789abcdef0123456789abcdef01234567", "NK-1", "", "Ä" * 3, "A" * 40, None]
    assert column(spark, ids, lambda c: unpack(pack(c))) == ids
    frame = spark.range(20)
    assert small(frame, 10) is frame and small(frame, 20) is not frame


def test_shared_folder_is_the_sessions(spark):
    class Conf:
        def get(self, name, default):
            return {SHARED_DIR: "file:///shared/x/"}.get(name, default)

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "file:///shared/x"
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(3).toDF("v"))
    folder = pathlib.Path(scratch.base.removeprefix("file://"))
    assert kept.count() == 3 and list(folder.rglob("*.parquet"))
    scratch.drop(kept, None)
    assert not list(folder.rglob("*.parquet"))


ATTRIBUTES = [Attribute("who", "name"), Attribute("size", "n", "long"), Attribute("share", "x", "double")]


def test_wide_cases(spark):
    rows = [
        ("a", "name", "old", 1), ("a", "name", "new", 2), ("a", "n", "5", 1), ("a", "n", "5", 1), ("b", "x", "0.5", None), ("b", "n", "six", 1), ("c", "other", "1", 1), ("d", "name", None, 9), (None, "name", "lost", 1),
        ("e", "name", "tie1", 3), ("e", "name", "tie2", 3),
    ]
    read = [ATTRIBUTES[0], Attribute("size", "n", "long", lambda v: v.try_cast("long")), ATTRIBUTES[2]]
    frame = spark.createDataFrame(rows, "entity_id string, prop string, value string, at int").withColumns({"who": F.lit(1), "entity": F.lit(2), "_k": F.lit(3)})
    got = {r.entity_id: (r.who, r["size"], r.share) for r in attributes_to_columns(frame, read, latest=["at"]).collect()}
    assert got == {"a": ("new", 5, None), "b": (None, None, 0.5), "c": (None, None, None), "d": (None, None, None), "e": ("tie2", None, None)}
    assert attributes_to_columns(frame.limit(0), ATTRIBUTES, latest=["at"]).collect() == []
    with pytest.raises(ValueError, match="differ"):
        attributes_to_columns(frame, [ATTRIBUTES[0], ATTRIBUTES[0]])


def test_wide_over_batches(spark):
    """Entities split over Arrow batches, one of them with most rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), (F.col("id") % 50).cast("string"))).alias("entity_id"), F.element_at(F.array(F.lit("name"), F.lit("n"), F.lit("x")), (F.col("id") % 3 + 1).cast("int")).alias("prop"), F.col("id").cast("string").alias("value"), "id")
        got = {r.entity_id: (r.who, r["size"], r.share) for r in attributes_to_columns(rows, ATTRIBUTES, latest=["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for i in range(4000):
        e = "hot" if i % 3 == 0 else f"e{i % 50}"
        want.setdefault(e, [None, None, None])[i % 3] = (str(i), i, float(i))[i % 3]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_ontology():
    assert O.ancestors("Company") == ["Company", "Organization", "LegalEntity", "Thing"] and O.ancestors("x") == []
    assert O.can_match("Company", "Organization") and O.can_match("LegalEntity", "Person")
    assert not O.can_match("Person", "Company") and not O.can_match("Payment", "Payment")


def entries(spark, rows):
    return spark.createDataFrame(rows, "schema string, id string, field string, token string, count int")


def test_pair_cost_and_stopwords(spark):
    assert B.pair_cost(60) == 1770 and B.pair_cost(0) == 0
    with pytest.raises(ValueError, match="negative"):
        B.pair_cost(-1)
    rows = [("Person", f"p{i}", "np", "np:a", 1) for i in range(4)] + [("Person", f"p{i}", "np", "np:b", 1) for i in range(5)] + [("Payment", f"x{i}", "np", "np:c", 1) for i in range(9)]
    costs = {r.token: (r.cost, r.stopword) for r in B.token_costs(entries(spark, rows), 4).collect()}
    assert costs == {"np:a": (6, False), "np:b": (10, True), "np:c": (0, False)}


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["Person", "Company", "Organization"]), f"i{i}", rng.choice(["np", "wd", "name", "x"]), f"t{rng.randrange(25)}", rng.randrange(1, 4)) for i in range(40) for _ in range(4)]
    schema = {r[1]: r[0] for r in rows}
    rows = sorted({(schema[r[1]], *r[1:]) for r in rows})
    got = {(r.lid, r.rid): round(r.score, 9) for r in B.candidate_pairs(entries(spark, rows), 60).collect()}
    import math
    from collections import defaultdict

    n = len({r[1] for r in rows})
    holders = defaultdict(set)
    names = defaultdict(int)
    for s, i, f, t, c in rows:
        holders[t].add(i)
        names[i] += c * (f == "name")
    weight = lambda f, t, i: B.BOOSTS.get(f, 1.0) * (1 + math.log(n / len(holders[t]))) / (math.sqrt(max(1, names[i])) if f in ("np", "sy") else 1)
    fields: dict = defaultdict(lambda: [0.0, 0])
    for s1, a, f1, t1, _ in rows:
        for s2, b, f2, t2, _ in rows:
            if a > b and t1 == t2 and f1 == f2 and O.can_match(s1, s2):
                at = fields[(a, b, f1)]
                at[0] = max(at[0], weight(f1, t1, a) + weight(f1, t1, b))
                at[1] += 1
    want: dict = defaultdict(float)
    for (a, b, _), (w, k) in fields.items():
        want[(a, b)] += w * (1 + math.log(k))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert B.candidate_pairs(entries(spark, [])).collect() == []


def union_find(links):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[root(a)] = root(b)
    groups: dict = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def grouped(rows):
    out: dict = {}
    for node, label in rows:
        out.setdefault(label, set()).add(node)
    return {frozenset(g) for g in out.values()}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    names = [(f"n{a}", f"n{b}") for a, b in links]
    found = label_components(spark.createDataFrame(names, "a string, b string")).collect()
    assert grouped((r.node, r.label) for r in found) == union_find(names)
    assert len(found) == len({r.node for r in found})


def test_components_of_a_chain(spark):
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(400)]
    random.Random(1).shuffle(links)
    assert len({r.label for r in label_components(spark.createDataFrame(links, "a string, b string")).collect()}) == 1


def edge(t, s, j, at, deleted=None, score=None):
    return (t, s, j, score, "u", at, deleted)


EDGE = "target string, source string, judgement string, score double, user string, created_at string, deleted_at string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        edge("NK-1", "a", "positive", "2020"), edge("b", "NK-1", " Positive ", "2021"), edge("NK-1", "b", "positive", "2021"), edge("c", "d", "positive", "2020"), edge("a", "c", "negative", "2020"),
        edge("b", "e", "no_judgement", "2020", score=0.7), edge("e", "d", "no_judgement", "2020", score=0.9), edge("b", "d", "no_judgement", "2020", score=0.8), edge("x", "x", "positive", "2020"),
        edge("f", "g", "positive", "2019"), edge("g", "f", "unsure", "2020"), edge("h", "i", "positive", "2020", deleted="2021"), edge("Q1", "Q2", "no_judgement", "2020", score=0.1),
    ]
    return spark.createDataFrame(rows, EDGE)


def test_live_and_clusters(edges):
    live = {(r.target, r.source): r.judgement for r in J.live(edges).collect()}
    assert live[("NK-1", "b")] == "positive" and live[("g", "f")] == "unsure" and ("i", "h") not in live and len(live) == 9
    links = {r.node: (r.canonical_id, r["head"]) for r in J.linker(edges).collect()}
    assert links == {"a": ("NK-1", "NK-1"), "b": ("NK-1", "NK-1"), "NK-1": ("NK-1", "NK-1"), "c": ("c", "d"), "d": ("d", "d")}
    assert {(r.canonical_id, r.referent) for r in J.referents(J.linker(edges)).collect()} == {("NK-1", "a"), ("NK-1", "b")}


def test_judge(spark, edges):
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "d"), ("a", "e"), ("Q1", "Q2"), ("f", "g")], "left string, right string")
    got = {(r.left, r.right): r.judgement for r in J.judge(pairs, edges).collect()}
    assert got == {("a", "b"): "positive", ("a", "a"): "positive", ("b", "d"): "negative", ("a", "e"): "no_judgement", ("Q1", "Q2"): "negative", ("f", "g"): "unsure"}
    assert [(r.target, r.source) for r in J.candidates(edges).collect()] == [("e", "d"), ("e", "b")]


def test_merge_words(spark):
    words = ["positive", "negative", "unsure", "no_judgement"]
    frame = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = {(r.a, r.b): r.m for r in frame.select("a", "b", J.merge(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got[("positive", "positive")] == "positive" and got[("negative", "positive")] == got[("positive", "negative")] == "negative"
    assert got[("negative", "negative")] == "unsure" == got[("positive", "unsure")]


def test_decide_mints_and_supersedes(spark, edges):
    decisions = spark.createDataFrame([("d", "e", "positive"), ("b", "e", "negative")], "left string, right string, judgement string")
    after = J.decide(edges, decisions, now="2030", user="me")
    live = {(r.target, r.source): r.judgement for r in J.live(after).collect()}
    minted = [t for t, _ in live if t.startswith("NK-") and t != "NK-1"]
    assert len(set(minted)) == 1 and (minted[0], "e") in live and (minted[0], "d") in live and ("e", "d") not in live and live[("e", "b")] == "negative"
    assert grouped((r.node, r.label) for r in J.clusters(after).collect()) == {frozenset({"a", "b", "NK-1"}), frozenset({"c", "d", "e", minted[0]})}


def test_prune_keeps_groups(spark):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(20)] + [f"NK-{i}" for i in range(6)] + ["Q1", "Q2"]
    rows = [edge(a, b, "positive", str(rng.randrange(2015, 2024))) for a, b in [rng.sample(ids, 2) for _ in range(22)]]
    frame = spark.createDataFrame(rows, EDGE)
    before = {g - {x for x in g if x.startswith(("NK-", "Q"))} for g in grouped((r.node, r.label) for r in J.clusters(frame).collect())}
    after = J.prune(frame, now="2030", cutoff="2020").withColumn("deleted_at", F.lit(None).cast("string"))
    kept = {g - {x for x in g if x.startswith(("NK-", "Q"))} for g in grouped((r.node, r.label) for r in J.clusters(after).collect())}
    assert {g for g in kept if len(g) > 1} == {g for g in before if len(g) > 1}


def test_remove_rename_suggest(spark, edges):
    gone = J.remove(edges, spark.createDataFrame([("NK-1",)], "node string"), now="2030")
    assert not [r for r in J.live(gone).collect() if "NK-1" in (r.target, r.source)]
    after, changed = J.rename(edges, "NK-1", "Q9", now="2030")
    assert changed == 2 and {(r.target, r.source) for r in J.live(after).where("target = 'Q9'").collect()} == {("Q9", "a"), ("Q9", "b")}
    assert J.rename(edges, "a", "a", now="2030")[1] == 0
    scored = spark.createDataFrame([("b", "e", 0.3), ("a", "c", 0.9), ("y", "z", 0.4)], "left string, right string, score double")
    got = {(r.target, r.source): (r.judgement, r.score) for r in J.suggest(edges, scored, now="2030", user="me").collect()}
    assert got[("e", "b")] == ("no_judgement", 0.3) and got[("c", "a")] == ("negative", None) and got[("z", "y")] == ("no_judgement", 0.4)


def test_refresh_after_deletion(spark, edges):
    since = "2020-06"
    before = J.clusters(edges.where(F.col("created_at") <= since))
    later = edges.unionByName(spark.createDataFrame([edge("z", "c", "positive", "2022"), edge("d", "c", "negative", "2022")], EDGE))
    got = grouped((r.node, r.label) for r in J.refreshed(before, later, since).collect())
    assert got == grouped((r.node, r.label) for r in J.clusters(later).collect())


def test_statement_changes(spark, make_statements):
    store = make_statements([("1", "a", "a", "name", "Person", "A", "x", "2020-01-01"), ("1", "a", "a", "name", "Person", "A", "x", "2021-01-01"), ("2", "b", "b", "name", "Company", "B", "y", None), ("3", "c", "c", "name", "Person", "C", None, "2020-01-01")])
    batch = make_statements([("1", "zz", "NK-1", "other", "LegalEntity", "changed", "w", "2022-01-01"), ("9", "n", "n", "name", "Person", "N", "x", None)])
    got = {r.id: (r.entity_id, r.canonical_id, r.prop, r.schema, r.value, r.dataset) for r in S.upsert(store, batch).collect()}
    assert got["1"] == ("a", "NK-1", "name", "LegalEntity", "A", "x") and got["9"][0] == "n" and set(got) == {"1", "2", "3", "9"}
    after = S.replace_dataset(store, "x", make_statements([("5", "a", "a", "name", "Person", "Z", None, None), ("2", "q", "q", "name", "Person", "taken", None, None)]))
    assert {(r.id, r.dataset) for r in after.collect()} == {("2", "y"), ("3", None), ("5", "x")}
    popped, rest = S.pop(store, spark.createDataFrame([("a",)], "canonical_id string"))
    assert (popped.count(), rest.count()) == (2, 2)


def test_assemble_and_canonicalise(spark, make_statements):
    rows = make_statements(
        [("1", "a", "NK-1", "name", "Organization", "B", "x", None), ("2", "b", "NK-1", "name", "Company", "A", "y", None), ("3", "b", "NK-1", "name", "Company", "A", "y", None), ("4", "p", "p", "name", "Person", "P", "x", None), ("5", "q", "p", "name", "Company", "Q", "x", None), ("6", "v", "v", "payer", "Payment", "a", "x", None)]
    )
    made = {r.id: r for r in S.assemble(rows).collect()}
    assert set(made) == {"NK-1", "v"} and made["NK-1"].schema == "Company" and made["NK-1"].properties == {"name": ["A", "B"]} and made["NK-1"].referents == ["a", "b"]
    links = spark.createDataFrame([("a", "NK-9"), ("v", "NK-8")], "node string, canonical_id string")
    typed = rows.withColumn("prop_type", F.when(F.col("prop") == "payer", "entity").otherwise("name"))
    got = {r.id: (r.canonical_id, r.value, r.original_value) for r in S.canonicalise(typed, links).collect()}
    assert got["1"] == ("NK-9", "B", None) and got["6"] == ("NK-8", "NK-9", "a") and got["4"] == ("p", "P", None)
    apart = {(r.entity_id, r.prop, r.value) for r in S.disassemble(S.assemble(rows)).collect()}
    assert apart == {("NK-1", "name", "A"), ("NK-1", "name", "B"), ("v", "payer", "a")}


def test_strings():
    assert Y.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-5) and Y.jaro("", "a") == 0
    assert Y.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-5)
    assert Y.metaphone("Thompson") == Y.metaphone("Tomson") or Y.metaphone("knight") == Y.metaphone("night")
    assert Y._phonetic_score(["jon smith"], ["john smith"]) >= 0.5 and Y._person_score(["john smith"], ["smith john"]) == 1.0
    assert len(Y.LETTERS) == len(Y.PLAIN) and not re.search("[a-z]", Y.LETTERS)


def test_levenshtein_expressions(spark):
    frame = spark.createDataFrame([("abcdefgh", "abcdefgh"), ("abcdefgh", "abcdefgx"), ("abc", "abd"), ("abcdefgh", "zzzzzzzz"), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = [(round(r.r, 4), round(r.s, 4), round(r.c, 4)) for r in frame.select(Y.levenshtein_ratio(a, b).alias("r"), Y.strict_levenshtein(a, b).alias("s"), Y.clipped_levenshtein(a, b).alias("c")).collect()]
    assert got == [(1.0, 1.0, 1.0), (0.875, 0.7656, 0.7656), (0.6667, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    assert datetime.fromisoformat("2020-01-01").year == 2020
