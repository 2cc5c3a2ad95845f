from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from knotwork.functions import features as X
from knotwork.functions import name_parts as N
from knotwork.functions import similarity as S
from knotwork.operators import enrich as E
from knotwork.operators import items as I
from knotwork.operators import judgements as J
from knotwork.operators import matching as M
from knotwork.operators import store as V
from knotwork.operators import tokens as T
from knotwork.operators import training as R
from knotwork.sources import formats
from knotwork.sources import units as U
from knotwork.streaming import changes as C


def entity(i, schema, **props):
    return (i, schema, {k: v if isinstance(v, list) else [v] for k, v in props.items()}, ["d"], [])


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        (1, entity("a", "Person", name="John Smith", birthDate="1970-03-04", country="us", gender="male"), entity("b", "Person", name="Smith, John", birthDate="1970-04-03", country="US", gender="male")),
        (2, entity("a", "Person", name="John Smith", birthDate="1970-03-04", country="us", gender="male"), entity("c", "Person", name="John Smith", birthDate="1981", country="fr", gender="female")),
        (3, entity("d", "Company", name="Acme 7 Ltd", registrationNumber="HR 12-3"), entity("e", "Company", name="Acme 7 Limited", registrationNumber="hr123")),
        (4, entity("d", "Company", name="Acme 7 Ltd", leiCode="L1", address="1 Main Street, Springfield"), entity("f", "Company", name="Zeta 8 Ltd", leiCode="L1", address="Main Street 1, Springfield")),
        (5, entity("a", "Person", name="John Smith"), entity("d", "Company", name="John Smith")),
        (6, entity("g", "Person"), entity("h", "Person")),
    ]
    return spark.createDataFrame([(k, left, right) for k, left, right in rows], f"k int, l {formats.ENTITY.simpleString()}, r {formats.ENTITY.simpleString()}")


def scores(pairs, *features):
    rows = M.encode(pairs, {f.__name__: f for f in features}).orderBy("k").collect()
    return [[round(r[f"f_{f.__name__}"], 3) for r in rows] for f in features]


def test_features(pairs):
    dob, day, country, gender = scores(pairs, X.dob_matches, X.dob_day_disjoint, X.country_mismatch, X.gender_mismatch)
    assert dob == [0.5, 0, 0, 0, 0, 0] and day == [0.5, 0, 0, 0, 0, 0] and country == [0, 1, 0, 0, 0, 0] and gender == [0, 1, 0, 0, 0, 0]
    ids, numbers, strong = scores(pairs, X.identifier_match, X.name_numbers, X.strong_identifier_match)
    assert ids == [0, 0, 1, 1, 0, 0] and numbers == [0, 0, 0, 1, 0, 0] and strong == [0, 0, 0, 1, 0, 0]
    address, literal, sound = scores(pairs, X.address_prop_match, X.name_literal_match, X.soundex_name_parts)
    assert address[3] == 1.0 and literal == [0, 1, 0, 0, 1, 0] and sound[0] == 1.0


@pytest.mark.parametrize("name", list(M.HEURISTICS))
def test_algorithms(pairs, name):
    got = {r.k: r for r in M.algorithm(name).score(pairs).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].score == 0 and got[6].score == 0 and got[6].explanations == {}
    assert got[2].score < (1.01 if name == "name-based" else 0.8)


def test_weights_and_registry(pairs):
    off = dict.fromkeys([f.name for f in M.LOGIC_V2.features if not f.qualifier], 0.0)
    assert [r.score for r in M.LOGIC_V2.score(pairs, overrides=off | {"address_prop_match": 0.2}).orderBy("k").collect()][3] == pytest.approx(0.2)
    with pytest.raises(ValueError, match="no features"):
        M.LOGIC_V2.score(pairs, overrides={"x": 1.0})
    with pytest.raises(ValueError, match="unknown"):
        M.algorithm("nothing")
    with pytest.raises(ValueError, match="not trained"):
        M.Regression("r", M.REGRESSION_V1, {"name_match": 1.0})
    model = M.Regression("r", M.REGRESSION_V1, {n: (4.0 if n == "name_match" else 0.0) for n in M.REGRESSION_V1}, -2.0)
    assert [round(r.score, 2) for r in model.score(pairs).orderBy("k").collect()][:2] == [0.12, 0.88]


def test_tokens(spark, make_statements):
    rows = make_statements([("1", "a", "a", "name", "Company", "The Acme Widgets Ltd", "x", None), ("2", "a", "a", "address", "Company", "12 Longstreet, Longstreet", "x", None), ("3", "a", "a", "birthPlace", "Person", "x", "x", None), ("4", "p", "p", "date", "Payment", "2020", "x", None), ("5", "a", "a", "incorporationDate", "Company", "2001-02-03T00:00", "x", None)])
    got = {(r.field, r.token): r["count"] for r in T.tokenise(rows).where("id = 'a' AND schema = 'Company'").collect()}
    assert got == {
        ("np", "np:acme"): 1, ("np", "np:widgets"): 1, ("name", "n:acmeltdthewidgets"): 1, ("sy", "sy:ORG:llc"): 1, ("address", "a:longstreet"): 2, ("wd", "wd:longstreet"): 2, ("date", "d:2001-02-03"): 1,
    }


def test_training_scan(spark, pairs):
    judged = pairs.withColumns({"judgement": F.when(F.col("k") == 1, "positive").when(F.col("k") == 3, "unsure").otherwise("negative"), "left_cluster": F.lit("c"), "right_cluster": F.when(F.col("k") == 2, "c").otherwise("d")})
    skip = {r.k: r.skip for r in R.scan(judged).collect()}
    assert skip[3] == "judgement" and skip[2] == "contradictory_cluster" and skip[5] == "schema_pair" and skip[1] in (None, "cross_partition")
    import hashlib

    fraction = int.from_bytes(hashlib.sha256(b"42:c").digest()[:8], "big") / 2**64
    got = spark.createDataFrame([("c",)], "v string").select(R.partition_of(F.col("v")).alias("p")).head().p
    assert got == ("test" if fraction < 0.3 else "train")


def test_fit_and_evaluate(spark):
    rows = [(f"{i:08x}", i % 2, "test" if i % 5 == 0 else "train", entity(f"l{i}", "Person", name="Ann Bell"), entity(f"r{i}", "Person", name="Ann Bell" if i % 2 else f"Other Name{i}")) for i in range(60)]
    data = spark.createDataFrame(rows, f"digest string, y int, partition string, l {formats.ENTITY.simpleString()}, r {formats.ENTITY.simpleString()}")
    chosen = {"name_match": X.name_match, "name_levenshtein": X.name_levenshtein}
    found = R.vectors(data, chosen)
    scored = R.apply(R.fit(found, "m", chosen), found.where("partition = 'test'"))
    assert R.areas(scored)["roc_auc"] == 1.0
    row = R.confusion(scored, (0.5,)).head()
    assert (row.fp, row.fn) == (0, 0) and row.tp + row.tn == 12


def test_versions(spark, make_statements, tmp_path):
    store = V.VersionedStore(spark, f"file://{tmp_path}/store")
    rows = make_statements([("1", "a", "a", "name", "Person", "A", "x", "2020-01-01")])
    assert store.latest("x") is None and store.view(["x"]) is None
    store.write("x", "v1", rows.withColumn("first_seen", F.lit("2001-01-01").cast("timestamp_ntz")))
    assert not store.has_version("x", "v1")
    store.release("x", "v1")
    store.write("x", "v2", rows.withColumn("first_seen", F.lit("2009-01-01").cast("timestamp_ntz")))
    store.release("x", "v2")
    assert store.history("x") == ["v1", "v2"] and store.view(["x"]).head().first_seen.year == 2001
    store.drop("x", "v2")
    assert store.latest("x") == "v1"


def test_cache(spark):
    cache = spark.createDataFrame([("k", "old", "2020-01-01"), ("k", "new", "2020-02-01"), ("q", "z", "2019-01-01")], "key string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    keys = spark.createDataFrame([("k",), ("q",), ("none",)], "key string")
    assert {r.key: r.text for r in V.cache_lookup(cache, keys, now="2020-02-02").collect()} == {"k": "new", "q": "z"}
    assert {r.key for r in V.cache_lookup(cache, keys, now="2020-02-02", max_age_days=30).collect()} == {"k"}
    assert V.cache_lookup(cache, keys, now="2020-02-02", max_age_days=0).collect() == []
    assert {r.key for r in V.cache_lookup(cache, keys, now="2020-02-02", since="2020-01-15").collect()} == {"k"}


def test_formats(spark, make_statements, tmp_path):
    rows = make_statements([("1", "a", "a", "name", "Person", ' "x",\n y ', None, "2020-01-01T01:02:03.000004"), ("2", None, "a", "name", "Person", "", "d", None)])
    for fmt in formats.FORMATS:
        formats.write_statements(rows, f"file://{tmp_path}/{fmt}", fmt)
        assert sorted(map(str, formats.read_statements(spark, f"file://{tmp_path}/{fmt}", fmt).collect())) == sorted(map(str, rows.collect())), fmt
    with pytest.raises(ValueError, match="format"):
        formats.read_statements(spark, "x", "xml")
    path = tmp_path / "pairs.json"
    good, other = {"id": "a", "schema": "Person", "properties": {}}, {"id": "b", "schema": "Company", "properties": {}}
    path.write_text("\n".join(json.dumps({"left": good, "right": r, "judgement": j}) for r, j in [(good, "positive"), (other, "positive"), (good, "unsure")]))
    assert formats.read_pairs(spark, f"file://{path}").count() == 1


def test_items(spark):
    claim = lambda value, **q: {"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": value}, "qualifiers": q}
    time = lambda t, p: {"type": "time", "value": {"time": t, "precision": p}}
    item = {
        "id": "Q5",
        "labels": {"de": {"language": "de", "value": "Anna (Politikerin)"}, "en": {"language": "en", "value": "Anna Bell"}},
        "aliases": {"en": [{"language": "en", "value": "Ann B. Bell"}, {"language": "en", "value": "Annie"}]},
        "claims": {"P569": [claim(time("+1970-02-03T00:00:00Z", 11))], "P27": [claim({"type": "wikibase-entityid", "value": {"id": "Q30"}}, P582=[{"snaktype": "value", "datavalue": time("+1999-00-00T00:00:00Z", 9)}])]},
    }
    items = I.parse_items(spark.createDataFrame([(json.dumps(item),), ("broken",), (None,)], "text string"))
    got = {(r.prop, r.value) for r in I.entity_statements(items).collect()}
    assert got == {("birthDate", "1970-02-03"), ("country", "Q30"), ("name", "Anna Bell"), ("alias", "Ann B. Bell"), ("weakAlias", "Annie")}
    ended = {r.prop: r.x for r in I.claims(items).select("prop", I.is_ended(None, "2020-01-01").alias("x")).collect()}
    assert ended == {"P569": False, "P27": True}
    rows = [(0, "create", "LAST", None, None, None, None, None), (1, "label", "LAST", "en", "string", 'A "b"', None, None), (2, "claim", "Q1", "P569", "time", "1970-02", None, "http://x"), (3, "claim", "Q1", "P1", "text", "Ä", "de", None)]
    lines = [r.line for r in I.command_lines(spark.createDataFrame(rows, "seq int, action string, target string, key string, kind string, value string, lang string, source_url string")).collect()]
    assert lines == ["CREATE", 'LAST\tLen\t"A \\"b\\""', 'Q1\tP569\t+1970-02-00T00:00:00Z/10\tS854\t"http://x"', 'Q1\tP1\tde:"Ä"']


def test_hierarchies_and_proposals(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "name string, parent string")
    assert {(r.name, r.ancestor): r.hop for r in E.closure(tree).where("name in ('c', 'x')").collect()} == {("c", "c"): 0, ("c", "b"): 1, ("c", "a"): 2, ("x", "x"): 0, ("x", "y"): 1}
    own, known = entity("a", "Person", birthDate=["1970"], country=["us", "fr"], gender=["male", "other"]), entity("b", "Person", country=["us"])
    matched = spark.createDataFrame([("a", own, known)], f"left string, l {formats.ENTITY.simpleString()}, r {formats.ENTITY.simpleString()}")
    assert {(r.prop, r.value) for r in E.propose(matched).collect()} == {("birthDate", "1970"), ("country", "fr")}
    nested = spark.createDataFrame([("r", json.dumps({"id": "1", "kids": [{"id": "2", "kids": [{"id": "3"}]}, {"id": "4"}]}))], "id string, t string")
    schema = "struct<id: string, kids: array<struct<id: string, kids: array<struct<id: string>>>>>"
    got = {(r.node, r.parent, r.depth) for r in E.nested_records(nested, "t", schema, lambda n: n["kids"], 2).collect()}
    assert got == {("1", None, 0), ("2", "1", 1), ("4", "1", 1)}
    with pytest.raises(ValueError, match="source"):
        E.make_source("nowhere")
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "kept")], "key string, text string")
    assert {r.key: r.text for r in E.fetch_missing(keys, cache, lambda k: k.upper()).collect()} == {"a": "kept", "b": "B"}


def test_ended_claims_tenures_and_holders(spark):
    tree = spark.createDataFrame([("a", None, None), ("b", "a", "2001"), ("c", "b", None), ("d", "q", "1999")], "name string, parent string, until string")
    skipped = {(r.name, r.ancestor) for r in E.closure(tree, ended="until", kept=("q",)).where("hop > 0").collect()}
    assert skipped == {("c", "b"), ("d", "q")}
    held = spark.createDataFrame([("s", "p", "1990", "1994"), ("s", "p", "1998", None), ("t", "p", "2000", "2001"), ("t", "p", "2000", "2001"), ("u", "low", None, None)], "subject string, position string, start string, end string")
    assert sorted(map(tuple, E.tenures(held).collect()), key=str) == [("s", "p", None, None), ("t", "p", "2000", "2001"), ("u", "low", None, None)]
    parents = spark.createDataFrame([("low", "p"), ("p", None)], "name string, parent string")
    got = {(r.position, r.subject): r.hop for r in E.holders(spark.createDataFrame([("p",)], "position string"), parents, held).collect()}
    assert got == {("p", "s"): 0, ("p", "t"): 0, ("p", "u"): 1}


def test_reconcile_links_takes_and_creates(spark):
    scored = spark.createDataFrame([("a", "Q1", 0.97), ("a", "Q2", 0.97), ("b", "Q3", 0.5), ("d", "Q9", 1.0)], "left string, right string, score double")
    subjects, linked = spark.createDataFrame([(x,) for x in "abcd"], "left string"), spark.createDataFrame([("d", "Q4")], "left string, right string")
    assert {(r.left, r.right, r.action) for r in E.reconcile(scored).collect()} == {("a", "Q1", "take"), ("b", "Q3", "review"), ("d", "Q9", "take")}
    got = {(r.left, r.right, r.action) for r in E.reconcile(scored, subjects=subjects, linked=linked, create=True).collect()}
    assert got == {("a", "Q1", "take"), ("b", "Q3", "review"), ("d", "Q4", "diff"), ("c", None, "create")}


def test_projections_of_identifier_services(spark):
    orgs = json.dumps({"organizations": [{"organizationId": "77", "organizationName": "Acme", "lei": "L1", "isDomiciledIn": "geo/1"}, {"organizationId": "78", "organizationName": "Beta", "isDomiciledIn": "geo/2"}]})
    places = spark.createDataFrame([("geo/1", "fr"), ("geo/1", "fr")], "place string, country string")
    rows = spark.createDataFrame([("k", orgs), ("n", None)], "key string, text string")
    assert {r.id: r.properties.get("country") for r in E.organisations(rows, places).collect()} == {"lei-L1": ["fr"], "permid-78": None}
    data = json.dumps({"data": [{"figi": "F1", "compositeFIGI": "F1", "name": "ACME SHS"}, {"figi": "F2", "compositeFIGI": "F1", "name": "ACME SHS"}]})
    found, links = E.securities(spark.createDataFrame([("k", data), ("l", data)], "key string, text string"), spark.createDataFrame([("c", "ACME SHS"), ("d", "ACME")], "id string, name string"))
    assert [r.id for r in found.collect()] == ["figi-f1"] and [tuple(r) for r in links.collect()] == [("figi-f1", "c")]
    archive = json.dumps({"results": [{"id": "1", "schema": "Person", "properties": {"name": ["Ann"]}, "collection": {"foreign_id": "x"}}, {"id": "2", "schema": "Person", "collection": {"foreign_id": "y"}}]})
    assert [(r.id, r.properties) for r in E.collection_entities(spark.createDataFrame([("k", archive)], "key string, text string"), "x").collect()] == [("1", {"name": ["Ann"]})]
    asked = spark.createDataFrame([(200, 0), (204, 0), (403, 0), (429, 0), (503, 1), (503, 3), (400, 0)], "s int, n int").select(E.fetch_rule(F.col("s"), F.col("n")).alias("x"))
    assert [r.x for r in asked.collect()] == ["keep", "keep_empty", "stop", "cached_only", "retry 4", "fail", "fail"]
    one = spark.range(1).select(E.clean_query(F.lit(" Acme (UK), Ltd. ")).alias("q"), E.link_id(F.lit("P26"), F.lit("Q9"), F.lit("Q10")).alias("i")).head()
    assert tuple(one) == ("Acme UK Ltd", "wd-p26-q10-q9")


def test_next_pair_and_territories(spark):
    edges = spark.createDataFrame([("b", "a", "no_judgement", 0.9, "u", "1", None), ("d", "c", "no_judgement", 0.8, "u", "1", None)], "target string, source string, judgement string, score double, user string, created_at string, deleted_at string")
    put_off = spark.createDataFrame([("a", "b")], "target string, source string")
    assert (J.next_pair(edges).head().target, J.next_pair(edges, put_off).head().target) == ("b", "d")
    frame = spark.createDataFrame([(entity("a", "Person", country=["us-ca"]), entity("b", "Person", country=["US"])), (entity("a", "Person", country=["im"]), entity("b", "Person", country=["gb"])), (entity("a", "Person"), entity("b", "Person", country=["gb"]))], f"l {formats.ENTITY.simpleString()}, r {formats.ENTITY.simpleString()}")
    assert [r.f_t for r in M.encode(frame, {"t": X.territory_overlap({"im": "gb"})}).collect()] == [1.0, 1.0, 0.0]


def test_models_and_entity_files(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    M.save_model(spark, M.Regression("regression-v1", M.REGRESSION_V1, dict.fromkeys(M.REGRESSION_V1, 0.5), 1.5), path)
    assert M.load_model(spark, "regression-v1", path).intercept == 1.5
    with pytest.raises(ValueError, match="features"):
        M.load_model(spark, "entity-regression", path)
    rows = [entity("a", "Person", name="Ann", country=["us", "fr"]), ("b", "Person", {"name": ["Anna"]}, ["e"], ["old"]), ("c", "Company", {}, None, None), ("d", "Nonsense", {}, [], [])]
    formats.write_entities(spark.createDataFrame(rows, formats.ENTITY), f"file://{tmp_path}/e")
    plain, found = formats.load_entities(spark, f"file://{tmp_path}/e")
    assert sorted(r.id for r in plain.collect()) == ["a", "b", "c"] and {(r.name, r.entities) for r in found.collect()} == {("d", 1), ("e", 1)}
    merged, found = formats.load_entities(spark, f"file://{tmp_path}/e", spark.createDataFrame([("a", "NK"), ("b", "NK")], "node string, canonical_id string"))
    got = {r.id: (r.properties, r.datasets, r.referents) for r in merged.collect()}
    assert got["NK"] == ({"country": ["fr", "us"], "name": ["Ann", "Anna"]}, ["d", "e"], ["a", "b", "old"]) and got["c"] == ({}, [], []) and {(r.name, r.entities) for r in found.collect()} == {("d", 1), ("e", 1)}
    left = spark.createDataFrame([(entity("a", "Person"), entity("b", "Person"), "positive", "x", "x")], f"left {formats.ENTITY.simpleString()}, right {formats.ENTITY.simpleString()}, judgement string, left_cluster string, right_cluster string")
    formats.write_pairs(left, f"file://{tmp_path}/p")
    assert [r.format_version for r in formats.read_pairs(spark, f"file://{tmp_path}/p").collect()] == [1]


def test_commands(spark, make_statements, tmp_path, capsys):
    from knotwork import cli

    rows = make_statements([("1", "b", None, "name", "Person", "Ann", "x", None), ("2", "a", "a", "name", "Person", "Anna", "x", None), ("3", "a", "a", "country", "Person", "us", "x", None)])
    formats.write_statements(rows, f"file://{tmp_path}/s")
    cli.main(["make_sortable", "--statements", f"file://{tmp_path}/s", "--out", f"file://{tmp_path}/sorted"])
    assert [(r.canonical_id, r.prop) for r in formats.read_statements(spark, f"file://{tmp_path}/sorted").collect()] == [("a", "country"), ("a", "name"), ("b", "name")]
    spark.createDataFrame([("b", "a", "no_judgement", 0.9, "u", "1", None)], "target string, source string, judgement string, score double, user string, created_at string, deleted_at string").write.parquet(f"file://{tmp_path}/e")
    cli.main(["dedupe", "--statements", f"file://{tmp_path}/sorted", "--edges", f"file://{tmp_path}/e", "--judgement", "positive", "--now", "2", "--out", f"file://{tmp_path}/d"])
    assert "Anna" in capsys.readouterr().out and J.clusters(spark.read.parquet(f"file://{tmp_path}/d")).count() >= 2
    spark.createDataFrame([("a", "Q1", 0.99)], "left string, right string, score double").write.parquet(f"file://{tmp_path}/c")
    cli.main(["reconcile", "--scores", f"file://{tmp_path}/c", "--out", f"file://{tmp_path}/r"])
    assert spark.read.parquet(f"file://{tmp_path}/r").head().action == "take"


def test_units_of_work(spark, tmp_path):
    folder = f"file://{tmp_path}"
    first = U.Unit(spark, folder)
    first.stage("t", spark.range(3))
    first.commit()
    second = U.Unit(spark, folder)
    second.stage("t", second.read("t").where("id > 0"))
    second.checkpoint()
    second.stage("t", spark.range(0))
    second.stage("x", spark.range(9))
    second.rollback()
    assert second.read("t").count() == 3  # nothing is seen before the commit
    second.commit()
    assert second.read("t").count() == 2 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    assert U.compact(spark, folder, "t") == 1 and len(list(tmp_path.glob("t/*.parquet"))) == 1
    # a unit that died while it changed a table
    (tmp_path / "_unit-1" / "old").mkdir(parents=True)
    (tmp_path / "t").rename(tmp_path / "_unit-1" / "old" / "t")
    assert U.recover(spark, folder) == ["t"] and second.read("t").count() == 2 and not (tmp_path / "_unit-1").exists()


def test_answers_of_sources(spark):
    text = json.dumps({"results": {"companies": [{"company": {"company_number": "12 A", "name": "Acme", "jurisdiction_code": "us_de", "company_type": ""}}, {"company": {"name": "no id"}}]}})
    rows = spark.createDataFrame([("k", text), ("l", None), ("m", "broken")], "key string, text string")
    got = E.project(rows, E.PROJECTIONS["company-register"]).collect()
    assert [(r.key, r.id, r.properties) for r in got] == [("k", "oc-12-a", {"name": ["Acme"], "jurisdiction": ["us"], "registrationNumber": ["12 A"]})]
    texts = spark.createDataFrame([("Q1", "en", "one"), ("Q1", "de", "eins"), ("Q1", "fr", ""), ("Q2", "en", "x")], "id string, lang string, text string")
    items = spark.createDataFrame([("Q1",)], "id string")
    assert [(r.lang, r.text) for r in E.summaries(items, texts, ["de", "en"], 1).collect()] == [("de", "eins")]
    known = spark.createDataFrame([entity("a", "Person", name=["A", "B"], country=["us", "fr"]), entity("b", "Person", name="C")], formats.ENTITY)
    assert len(E.query_rows(known).collect()) == 5 and len(E.query_rows(known, 1).collect()) == 2


NONE = (frozenset(),) * 4


@pytest.mark.parametrize(
    ("person", "query", "result", "low", "high"),
    [
        (False, "Acme Widgets Ltd", "Widgets Acme Limited", 0.9, 1.0),
        (False, "Acme Widgets Ltd", "Acme Gadgets Ltd", 0.3, 0.75),
        (False, "Acme Widgets GmbH", "Acme Widgets LLC", 0.85, 0.99),
        (False, "Acme Widgets", "Acme Widgets AG", 0.9, 0.99),
        (False, "Acme International", "Acme Intl.", 0.9, 1.0),
        (False, "Alpha Beta International", "Gamma Beta International", 0.2, 0.65),
        (False, "Growth Fund 7", "Growth Fund VII", 0.9, 1.0),
        (False, "Growth Fund 7", "Growth Fund 8", 0.0, 0.5),
        (False, "Siltov Russia", "Siltov", 0.4, 0.7),
        (False, "Siltov", "Siltov Russia", 0.85, 0.99),
        (False, "Norvik Shipping", "Norvik Shpg", 0.9, 1.0),
        (False, "Quarren", "Quarrel", 0.5, 0.95),
        (True, "J. Brennhaven", "John Brennhaven", 0.9, 0.99),
        (True, "John Brennhaven", "Brennhaven, John", 0.99, 1.0),
        (True, "Bill Brennhaven", "William Brennhaven", 0.7, 0.95),
        (True, "John Brennhaven", "John Kulseth", 0.0, 0.6),
        (True, "John Brennhaven", "John Brennhavn", 0.6, 0.99),
        (True, "John Brennhaven", "John Peter Brennhaven", 0.85, 0.99),
        (True, "John Peter Brennhaven", "John Brennhaven", 0.6, 0.85),
        (True, "José Brennhaven", "Jose Brennhaven", 1.0, 1.0),
        (True, "Ann Bo", "Ann Bi", 0.0, 0.6),
        (True, "", "Ann", 0.0, 0.0),
    ],
)
def test_names_part_by_part(person, query, result, low, high):
    score = N.score_names([query], [result], person, NONE, N.NameConfig())
    assert low <= score <= high, score


def test_tags_settings_and_pruning():
    tags = (frozenset(["martin"]), frozenset(["james"]), frozenset(["james"]), frozenset(["martin"]))
    assert N.score_names(["Martin James"], ["James Martin"], True, tags, N.NameConfig()) < 0.5 < N.score_names(["Martin James"], ["James Martin"], True, NONE, N.NameConfig())
    family = (frozenset(), frozenset(["kulseth"]), frozenset(), frozenset(["berg"]))
    assert N.score_names(["Ann Kulseth"], ["Ann Berg"], True, family, N.NameConfig()) < N.score_names(["Ann Kulseth"], ["Ann Berg"], True, NONE, N.NameConfig())
    for changed, less in ((N.NameConfig(number_mismatch=0.0), False), (N.NameConfig(number_mismatch=0.9), True)):
        assert (N.score_names(["Fund 7"], ["Fund 8"], False, NONE, changed) < N.score_names(["Fund 7"], ["Fund 8"], False, NONE, N.NameConfig())) == less
    assert N.score_names(["Ann Lee Berg"], ["Ann Berg"], True, NONE, N.NameConfig(extra_query=0.1)) > N.score_names(["Ann Lee Berg"], ["Ann Berg"], True, NONE, N.NameConfig())
    assert N.score_names(["Quarrenheim"], ["Quarrel"], False, NONE, N.NameConfig(cutoff=3.0)) > 0 == N.score_names(["Quarrenheim"], ["Quarrel"], False, NONE, N.NameConfig())
    assert N.consolidate(["Ann Berg", "Ann Lee Berg", "ann  berg", "Berg", "", "Анна Берг"]) == ["Ann Lee Berg", "Анна Берг", "Berg"]
    left, right = ["Ann Lee Berg", "Анна Берг"], ["Ann Berg", "A. Lee", "Берг Анна", "X"]
    kept = N.name_pairs(left, right)
    assert ("Анна Берг", "Берг Анна") in kept and ("Анна Берг", "Ann Berg") not in kept and N.name_pairs(left, right[:3]) == [(a, b) for a in left for b in right[:3]]
    assert N.explain(N.align(N.parts("Ann Berg", True), N.parts("Ann X Berg", True), N.NameConfig())[1]) == "ann~ann:1.00, berg~berg:1.00, +x"


def test_second_scorer_and_its_settings(spark):
    rows = [("P", entity("a", "Person", name=["Ann Kulseth"], lastName=["Kulseth"]), entity("b", "Person", name="Kulseth, Ann")), ("C", entity("c", "Company", name="Fund 7"), entity("d", "Company", name="Fund 8", alias=[None])), ("N", entity("e", "Person"), entity("f", "Person", name="X"))]
    frame = spark.createDataFrame(rows, f"k string, l {formats.ENTITY.simpleString()}, r {formats.ENTITY.simpleString()}")
    got = {r.k: r.score for r in M.LOGIC_V2.score(frame).collect()}
    soft = {r.k: r.score for r in M.logic_v2(nm_number_mismatch=0.0).score(frame).collect()}
    only = {r.k: r.score for r in M.logic_v2(nm_name_property="alias").score(frame).collect()}
    assert got["P"] == pytest.approx(1.0) and got["C"] < soft["C"] and got["N"] == 0.0 and only["P"] == 0.0
    with pytest.raises(ValueError, match="nm_nothing"):
        M.logic_v2(nm_nothing=1.0)


def test_metaphone_codes():
    codes = {"Knight": "NT", "Philip": "FLP", "Wright": "RT", "Science": "SNS", "Judge": "JJ", "Church": "XRX", "Dumb": "TM", "Nation": "NXN", "Think": "0NK", "Smith": "SM0", "Schmidt": "SKMTT", "Xavier": "SFR", "Aerial": "ERL", "": "", "Ы": ""}
    assert {w: S.metaphone(w) for w in codes} == codes


def test_stream(spark, make_statements, tmp_path):
    rows = make_statements([("1", "a", "a", "name", "Person", "A", "x", "2020-01-01"), ("1", "a", "NK-1", "name", "Person", "A", "x", "2020-01-02"), ("2", "b", "b", "name", "Person", "B", "x", "2020-01-01")])
    source, table = f"file://{tmp_path}/in", f"file://{tmp_path}/table"
    rows.where("canonical_id <> 'NK-1'").coalesce(1).write.parquet(source)
    rows.where("canonical_id = 'NK-1'").coalesce(1).write.mode("append").parquet(source)
    stream = C.file_stream(spark, source, rows.schema)
    stream.writeStream.foreachBatch(C.upsert_into(table)).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in C.current(spark, table).collect()) == ["1", "2"]


QUICK = ["p4_found", "blk_token_costs", "gra_live_edges", "snk_upsert", "agg_assemble", "jn_inbound", "fea_names", "fea_dates", "tok_entries", "rec_propose", "str_windows"]


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from tools.compare import TABLES, canonical

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, theirs = entry.queries()[name](spark, sf).toPandas(), db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns) and canonical(mine) == canonical(theirs)
