from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.ml.linalg import Vectors

from knotwork.functions import features as X
from knotwork.functions.keys import meetings
from knotwork.operators import training as R
from knotwork.plans import matching as P
from knotwork.plans import statements as N
from knotwork.plans import training as Q
from knotwork.session import shared_dir


def test_values_of_many_holders_pair_every_holder(spark, make_statements, tmp_path):
    """A value that many entities have, however short: each meets the least one, and none is left out."""
    rows = [(f"s{i}", f"e{i:02}", f"e{i:02}", "phone", "Person", "555 01", "reg", None) for i in range(25)]
    rows += [("t", "e03", "e03", "email", "Person", "someone@mail.example", "reg", None), ("u", "x", "x", "email", "Person", "someone@mail.example", "reg", None), ("v", "y", "y", "phone", "Person", "+1 555 0199 999", "reg", None)]
    make_statements(rows + rows).write.parquet(f"{tmp_path}/statements.parquet")
    want = {*[("e00", f"e{i:02}") for i in range(1, 25)], ("e03", "x")}
    found = [tuple(r) for r in P.shared_pairs(spark, str(tmp_path)).collect()]
    assert len(found) == len(want) and set(found) == want


def test_meetings_are_all_pairs_for_any_salts(spark):
    rows = spark.createDataFrame([("k", m) for m in "abcdefgh" * 2] + [("l", "a"), ("l", "b"), ("m", "c"), (None, "d"), (None, "e")], "g string, m string")
    for holders in (1000, 2):
        found = [tuple(r) for r in meetings(rows, "g", "m", holders).collect()]
        assert sorted(found) == sorted(itertools.combinations("abcdefgh", 2))


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///tmp/x/"
    assert shared_dir(Session()) == "hdfs:///tmp/x"


def test_penalty_is_chosen_by_the_whole_search(spark, monkeypatch):
    assert len(R.INVERSE_STRENGTHS) == 10 and (R.INVERSE_STRENGTHS[0], round(R.INVERSE_STRENGTHS[-1])) == (1e-4, 10_000) and R.SHARES == (0.0, 0.25, 0.5, 0.75, 1.0) and R.FOLDS == 5
    rng = random.Random(3)
    features = {n: getattr(X, n) for n in ("name_match", "name_levenshtein", "dob_matches")}
    rows = []
    for i in range(300):
        x = [rng.gauss(0, 1) for _ in features]
        rows.append((f"{rng.randrange(16**8):08x}", int(rng.random() < 1 / (1 + math.exp(-2 * x[0]))), "train" if i % 4 else "test", Vectors.dense(x)))
    data = spark.createDataFrame(rows, ["digest", "y", "partition", "raw"])
    monkeypatch.setattr(R, "INVERSE_STRENGTHS", (1e-4, 1.0))
    monkeypatch.setattr(R, "SHARES", (0.0, 1.0))
    model, inverse, share = R.choose(data, "m", features)
    assert inverse == 1.0 and share in R.SHARES and 1.2 < model.coefficients["name_match"] < 3
    assert abs(model.coefficients["name_levenshtein"]) < 0.6

    called = []
    monkeypatch.setattr(R, "choose", lambda data, name, features: called.append(name) or (R.fit(data, name, features), 1.0, 0.0))
    monkeypatch.setattr(R, "scan", lambda judged: judged)
    monkeypatch.setattr(R, "dataset", lambda scanned: scanned)
    monkeypatch.setattr(R, "vectors", lambda rows, features: rows)
    monkeypatch.setattr(Q, "judged", lambda spark, sf_dir: data)
    monkeypatch.setattr(Q.M, "ENTITY_REGRESSION", features)
    assert {r.metric for r in Q.entity_regression(spark, "").collect()} == {"log_loss", "brier", "roc_auc", "average_precision"} and called == ["entity-regression"]


def test_xref_query_takes_the_default_limits(monkeypatch, spark, make_statements, tmp_path):
    make_statements([("s", "e", "e", "name", "Person", "Ann Bell", "reg", None)]).write.parquet(f"{tmp_path}/statements.parquet")
    spark.createDataFrame([], "schema string, id string, field string, token string, count int").write.parquet(f"{tmp_path}/entries.parquet")
    spark.createDataFrame([], "target string, source string, judgement string").write.parquet(f"{tmp_path}/resolver.parquet")
    given = {}
    monkeypatch.setattr(P.M, "xref", lambda *tables, **options: given.update(options) or spark.createDataFrame([(0.5,)], "score double"))
    P.xref(spark, str(tmp_path))
    assert not {"limit", "limit_factor", "patience"} & given.keys()


def test_stores_and_files_hold_all_entities(spark, make_statements, tmp_path):
    rows = [("s1", "a", "NK", "name", "Person", "Ann", "reg", None), ("s2", "b", "NK", "name", "Organization", "Acme", "reg", None), ("s3", "c", "c", "full", "Address", "Town", "reg", None)]
    make_statements(rows).write.parquet(f"{tmp_path}/statements.parquet")
    assert {(r.canonical_id, r.id) for r in N.first_seen_all(spark, str(tmp_path)).collect()} == {("NK", "s1"), ("NK", "s2"), ("c", "s3")}
    assert [tuple(r) for r in N.first_seen(spark, str(tmp_path)).collect()] == [("c", "s3=?")]
    assert {(r.id, r.schema, r.least) for r in N.entities_json_all(spark, str(tmp_path)).collect()} == {("a", "Person", "Ann"), ("b", "Organization", "Acme"), ("c", "Address", "Town")}
