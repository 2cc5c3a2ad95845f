from __future__ import annotations

import itertools
import random

import numpy as np

from knotwork.llm import linkage as K
from knotwork.llm import names as N
from knotwork.llm.survivors import Bundle, Dependency, survivors

PAIR = "a binary, b binary, da string, db string, pull double, target double, push double"


def test_triangles_in_any_order():
    rows = [("x", "y", "1", "2"), ("x", "z", "1", "3"), ("y", "z", "2", "3")]
    for order in itertools.permutations(rows):
        rules = K.ground(*map(list, zip(*order, strict=True)), K.Weights())
        assert {order[vs[2]][:2] for w, vs, _, _ in rules} == {r[:2] for r in rows} and len(rules) == 3


def test_transitivity_over_blocks_and_orders(spark, monkeypatch):
    """Confidences are those of the joint problem, whatever the order of the rows and the division into blocks."""
    rng = random.Random(2)
    ids = [bytes([i]) for i in range(12)]
    pairs = [(a, b, f"d{a[0] % 4}", f"d{b[0] % 4}", rng.uniform(0, 6), 1.0, rng.uniform(0.5, 3)) for a, b in itertools.combinations(ids, 2) if a[0] % 4 != b[0] % 4 and rng.random() < 0.6]
    w = K.Weights(transitive=20.0)
    columns = [list(c) for c in zip(*pairs, strict=True)]
    joint = K.solve(*map(np.array, (columns[4], columns[5], columns[6])), K.ground(*columns[:4], w), rounds=3000, tolerance=1e-6)
    want = {(p[0], p[1]): x for p, x in zip(pairs, joint, strict=True)}
    plain = K.solve(*map(np.array, (columns[4], columns[5], columns[6])), K.ground(*columns[:4], K.Weights(transitive=0.0)), rounds=3000, tolerance=1e-6)
    assert max(abs(plain - joint)) > 0.08
    for most in (K.BLOCK_PAIRS, 6):
        monkeypatch.setattr(K, "BLOCK_PAIRS", most)
        rng.shuffle(pairs)
        got = {(bytes(r.a), bytes(r.b)): r.confidence for r in K.confidences(spark.createDataFrame(pairs, PAIR), w, outer_rounds=60, tolerance=0.001).collect()}
        assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 0.03


def test_dependencies_hold_for_pruned_records(spark, make_statements):
    """The record of the chosen number states AG, though other records of its trust state newer forms."""
    datasets = spark.createDataFrame([("reg", 5)], "name string, trust int")
    rows = [
        ("n1", "a", "NK", "registrationNumber", "Company", "HR 111", "reg", "2020-01-01"), ("f1", "a", "NK", "legalForm", "Company", "GmbH", "reg", "2020-01-01"),
        ("n2", "b", "NK", "registrationNumber", "Company", "HR 222", "reg", "2021-01-01"), ("f2", "b", "NK", "legalForm", "Company", "AG", "reg", "2021-01-01"),
        ("f3", "c", "NK", "legalForm", "Company", "GmbH", "reg", "2022-01-01"),
    ]
    # sums of recency decide: 111 with GmbH of 2022, 222 with AG of 2021
    for whole, newer, want in ((False, "2021-01-01", {"n2", "f2"}), (True, "2021-01-01", {"n2", "f2"}), (False, "2020-06-01", {"n1", "f3"})):
        form = Bundle("form", ("legalForm",))
        bundles = [Bundle("registration", ("registrationNumber", "incorporationDate") if whole else ("registrationNumber",)), form]
        moved = [(*r[:7], newer if r[1] == "b" else "2021-12-01" if r[0] == "f3" and want == {"n2", "f2"} else r[7]) for r in rows]
        got = survivors(make_statements(moved), datasets, bundles, [Dependency("registration", "form")], differing_only=False)
        assert {r.statement_id for r in got.collect()} == want


def test_unknown_names_in_any_order():
    for words in (["Anna", "Berg"], ["Zora", "Abel", "Timo"]):
        assert len({N.Lexicon().person(" ".join(order)) for order in itertools.permutations(words)}) == 1
    assert N.Lexicon().company("Abcd Wxyz Foods Ltd") == N.Lexicon().company("Wxyz Abcd Foods Ltd")
