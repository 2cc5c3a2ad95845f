"""Features and scores of pairs of entities that share an address or a contact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import features as X
from knotwork.functions.similarity import LETTERS, PLAIN
from knotwork.operators import blocking as B
from knotwork.operators import matching as M
from knotwork.operators import statements as S
from knotwork.plans.registry import Registry
from knotwork.session import Scratch
from knotwork.sources.tables import table

REGISTRY = Registry()

_KINDS = ("Person", "Company", "Organization")
_KIND_SQL = "('Person', 'Company', 'Organization')"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "statements").where(F.col("schema").isin(*_KINDS))
    return S.assemble(rows, key="entity_id")


def shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(left, right): each entity with the least entity that has one phone, mail address or address in common with it.

    A value gives one pair for each further holder, not all pairs of its holders, so the rows grow as the table does, and no
    value is left out, however many entities have it. The least holder is a minimum combined before the shuffle.
    """
    rows = table(spark, sf_dir, "statements").where(F.col("schema").isin(*_KINDS) & F.col("prop").isin("phone", "email", "address") & F.col("value").isNotNull() & F.col("entity_id").isNotNull())
    first = rows.groupBy("prop", "value").agg(F.min("entity_id").alias("left"))
    return rows.join(first, ["prop", "value"]).where("left < entity_id").select("left", F.col("entity_id").alias("right")).distinct()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_entities(shared_pairs(spark, sf_dir), entities(spark, sf_dir))


def _list(*props: str) -> str:
    return f"coalesce(list(DISTINCT value) FILTER (prop IN ({', '.join(repr(p) for p in props)})), [])"


BASE = f"""
WITH ent AS (
  SELECT entity_id AS id, max("schema") AS s, {_list(*X.NAMES)} AS names, {_list("weakAlias", "abbreviation")} AS weak, {_list("lastName")} AS lasts, {_list("birthDate")} AS dates, {_list("country", "jurisdiction")} AS countries,
    {_list("address", "full")} AS addr, {_list("registrationNumber", "taxNumber", "idNumber", "publicationNumber")} AS ids, {_list("registrationNumber", "taxNumber", "idNumber")} AS wids, {_list("phone")} AS phones, {_list("email")} AS emails, {_list("sourceUrl")} AS urls,
    {_list("gender")} AS genders, {_list("birthPlace")} AS places
  FROM statements WHERE value IS NOT NULL AND entity_id IS NOT NULL AND "schema" IN {_KIND_SQL} GROUP BY 1
), sh AS (SELECT entity_id AS r, min(entity_id) OVER (PARTITION BY prop, value) AS l FROM statements WHERE "schema" IN {_KIND_SQL} AND prop IN ('phone', 'email', 'address') AND value IS NOT NULL AND entity_id IS NOT NULL
), pr AS (SELECT DISTINCT l, r FROM sh WHERE l < r
), x AS (SELECT pr.l, pr.r, q, e FROM pr JOIN ent q ON q.id = pr.l JOIN ent e ON e.id = pr.r
)
"""


def clean(v: str) -> str:
    return f"trim(regexp_replace(translate(regexp_replace(lower({v}), '\\pM+', '', 'g'), '{LETTERS}', '{PLAIN}'), '[^\\pL\\pN]+', ' ', 'g'))"


def cset(xs: str) -> str:
    return f"list_distinct(list_filter(list_transform({xs}, lambda v: {clean('v')}), lambda v: length(v) > 0))"


def words(xs: str, n: int = 1) -> str:
    return f"list_distinct(list_filter(flatten(list_transform({xs}, lambda v: string_split({clean('v')}, ' '))), lambda w: length(w) >= {n}))"


def numbers(xs: str) -> str:
    return f"list_distinct(flatten(list_transform({xs}, lambda v: regexp_extract_all(v, '\\d+'))))"


def ov(a: str, b: str) -> str:
    return f"list_has_any({a}, {b})"


def disjoint(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND NOT {ov(a, b)})"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


def lev(a: str, b: str) -> str:
    return f"(1.0 - levenshtein({a}, {b})::DOUBLE / greatest(1, length({a}), length({b})))"


def best(a: str, b: str, f: str) -> str:
    return f"coalesce(list_max(flatten(list_transform({a}, lambda y1: list_transform({b}, lambda y2: {f})))), 0.0)"


def share(a: str, b: str, least: float) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / greatest({least}::DOUBLE, least(len({a}), len({b}))::DOUBLE)"


def dates(e: str, n: int) -> str:
    return f"list_distinct(list_transform(list_filter({e}.dates, lambda d: length(d) >= {n}), lambda d: d[1:{n}]))"


def flipped(e: str) -> str:
    return f"list_transform({dates(e, 10)}, lambda d: d[1:4] || '-' || d[9:10] || '-' || d[6:7])"


def strict(xs: str) -> str:
    return f"list_distinct(list_filter(list_transform({xs}, lambda v: regexp_replace(upper(v), '[^A-Z0-9]', '', 'g')), lambda v: length(v) > 0))"


_GATE = "(q.s = e.s OR (q.s IN ('Company', 'Organization') AND e.s IN ('Company', 'Organization')))"
_PERSON = f"({_GATE} AND (q.s = 'Person' OR e.s = 'Person'))"
_ORG = f"({_GATE} AND (q.s IN ('Company', 'Organization') OR e.s IN ('Company', 'Organization')))"
_LEGAL = _GATE
_LIGHT = lambda xs: f"list_distinct(list_filter(list_transform({xs}, lambda v: trim(regexp_replace(lower(v), '\\s+', ' ', 'g'))), lambda v: length(v) > 0))"
_SORTED = lambda xs: f"list_distinct(list_concat({cset(xs)}, list_transform({cset(xs)}, lambda v: array_to_string(list_sort(string_split(v, ' ')), ' '))))"
_COUNTRY = lambda e: f"list_distinct(list_transform({e}.countries, lambda v: lower(trim(v))))"
_NAMELEV = best(cset("q.names"), cset("e.names"), lev("y1", "y2"))
_GENDER = lambda e: f"list_filter({e}.genders, lambda v: v <> 'other')"
_N = lambda e: numbers(f"{e}.addr")

#: SQL of each feature.
FEATURES: dict[str, str] = {
    "name_literal_match": flag(ov(_LIGHT("q.names"), _LIGHT("e.names"))),
    "name_match": flag(ov(cset("q.names"), cset("e.names"))),
    "name_token_overlap": share(words("q.names", 3), words("e.names", 3), 2.0),
    "name_numbers": flag(disjoint(numbers("q.names"), numbers("e.names"))),
    "name_levenshtein": _NAMELEV,
    "weak_alias_match": flag(ov(_LIGHT("q.names"), _LIGHT("e.weak"))),
    "person_name_levenshtein": f"CASE WHEN {_PERSON} THEN {best(_SORTED('q.names'), _SORTED('e.names'), lev('y1', 'y2'))} ELSE 0.0 END",
    "org_name_levenshtein": f"CASE WHEN {_ORG} THEN {_NAMELEV} ELSE 0.0 END",
    "er_name_numbers": f"CASE WHEN len({numbers('q.names')}) + len({numbers('e.names')}) = 0 THEN 0.0 WHEN {disjoint(numbers('q.names'), numbers('e.names'))} THEN -1.0 ELSE len(list_intersect({numbers('q.names')}, {numbers('e.names')}))::DOUBLE / (len({numbers('q.names')}) + len({numbers('e.names')})) END",
    "dob_matches": f"CASE WHEN {ov(dates('q', 10), dates('e', 10))} THEN 1.0 WHEN {ov(flipped('q'), dates('e', 10))} THEN 0.5 ELSE 0.0 END",
    "dob_year_matches": flag(ov(dates("q", 4), dates("e", 4))),
    "dob_year_disjoint": flag(disjoint(dates("q", 4), dates("e", 4))),
    "dob_day_disjoint": f"CASE WHEN len({dates('q', 10)}) = 0 OR len({dates('e', 10)}) = 0 OR {ov(dates('q', 10), dates('e', 10))} THEN 0.0 WHEN {ov(flipped('q'), dates('e', 10))} THEN 0.5 ELSE 1.0 END",
    "dob_year_signed": f"CASE WHEN NOT {_PERSON} OR len({dates('q', 4)}) = 0 OR len({dates('e', 4)}) = 0 THEN 0.0 WHEN {ov(dates('q', 4), dates('e', 4))} THEN 1.0 ELSE -1.0 END",
    "identifier_match": flag(ov(strict("q.ids"), strict("e.ids"))),
    "plain_identifier_match": f"CASE WHEN {_ORG} THEN 0.0 ELSE {flag(ov('q.ids', 'e.ids'))} END",
    "org_identifier_match": f"CASE WHEN {_ORG} THEN {flag(ov('q.ids', 'e.ids'))} ELSE 0.0 END",
    "orgid_disjoint": f"CASE WHEN {_ORG} AND {disjoint(strict('q.ids'), strict('e.ids'))} THEN 1.0 - {best(strict('q.ids'), strict('e.ids'), f'CASE WHEN {lev("y1", "y2")} > 0.7 THEN {lev("y1", "y2")} ELSE 0.0 END')} ELSE 0.0 END",
    "weak_identifier_match": f"CASE WHEN {_LEGAL} THEN {flag(ov(strict('q.wids'), strict('e.wids')))} ELSE 0.0 END",
    "country_mismatch": flag(disjoint(_COUNTRY("q"), _COUNTRY("e"))),
    "per_country_mismatch": f"CASE WHEN {_PERSON} THEN {flag(disjoint(_COUNTRY('q'), _COUNTRY('e')))} ELSE 0.0 END",
    "org_country_mismatch": f"CASE WHEN {_LEGAL} AND NOT {_PERSON} THEN {flag(disjoint(_COUNTRY('q'), _COUNTRY('e')))} ELSE 0.0 END",
    "birth_place": share(words("q.places", 3), words("e.places", 3), 2.0),
    "er_birth_place": f"CASE WHEN {_PERSON} THEN {share(words('q.places', 4), words('e.places', 4), 1.0)} ELSE 0.0 END",
    "address_levenshtein": best(cset("q.addr"), cset("e.addr"), lev("y1", "y2")),
    "er_address_match": share(words("q.addr", 4), words("e.addr", 4), 1.0),
    "address_numbers": f"CASE WHEN len({_N('q')}) = 0 OR len({_N('e')}) = 0 THEN 0.0 ELSE (2 * len(list_intersect({_N('q')}, {_N('e')})) - len({_N('q')}))::DOUBLE END",
    "address_number_overlap": share(_N("q"), _N("e"), 1.0),
    "address_number_disagreement": f"CASE WHEN len({_N('q')}) = 0 OR len({_N('e')}) = 0 THEN 0.0 ELSE (len({_N('q')}) + len({_N('e')}) - 2 * len(list_intersect({_N('q')}, {_N('e')})))::DOUBLE / (len({_N('q')}) + len({_N('e')}) - len(list_intersect({_N('q')}, {_N('e')}))) END",
    "gender_mismatch": flag(disjoint("q.genders", "e.genders")),
    "er_gender_mismatch": flag(f"len({_GENDER('q')}) = 1 AND len({_GENDER('e')}) = 1 AND NOT {ov(_GENDER('q'), _GENDER('e'))}"),
    "phone_match": flag(ov("q.phones", "e.phones")),
    "email_match": flag(ov("q.emails", "e.emails")),
    "contact_match": flag(f"({ov('q.phones', 'e.phones')} OR {ov('q.emails', 'e.emails')} OR {ov('q.urls', 'e.urls')})"),
}
FEATURES["er_name_token_overlap"] = f"CASE WHEN {_LEGAL} THEN {FEATURES['name_token_overlap']} ELSE 0.0 END"
FEATURES["ofac_name_score"] = best(
    cset("q.names"),
    cset("e.names"),
    """greatest(CASE WHEN y1[1] = y2[1] THEN jaro_similarity(upper(y1), upper(y2)) + 0.1 * (1 - jaro_similarity(upper(y1), upper(y2))) * CASE WHEN y1[1:4] = y2[1:4] AND length(y1) > 3 AND length(y2) > 3 THEN 4 WHEN y1[1:3] = y2[1:3] AND length(y1) > 2 AND length(y2) > 2 THEN 3 WHEN y1[1:2] = y2[1:2] AND length(y1) > 1 AND length(y2) > 1 THEN 2 ELSE 1 END ELSE 0.0 END,
  list_avg(list_transform(CASE WHEN len(list_filter(string_split(y1, ' '), lambda w: length(w) > 2)) > 0 THEN list_filter(string_split(y1, ' '), lambda w: length(w) > 2) ELSE string_split(y1, ' ') END,
    lambda w: list_max(list_transform(string_split(y2, ' '), lambda o: CASE WHEN jaro_winkler_similarity(w, o) >= 0.5 THEN jaro_winkler_similarity(w, o) ELSE 0.0 END)))))""",
)
FEATURES["jaro_name_parts"] = f"coalesce(list_avg(list_transform({words('q.names')}, lambda w: coalesce(list_max(list_transform({words('e.names')}, lambda o: CASE WHEN jaro_winkler_similarity(w, o) > 0.5 THEN jaro_winkler_similarity(w, o) ELSE 0.0 END)), 0.0))), 0.0)"

# the American sound code: codes of letters, 0 for vowels, none for h and w, runs of one code made one
_LETTER_CODES = lambda w: f"translate({w}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '1111222222223345560000000')"  # noqa: E731, S105


def _runs(code: str) -> str:
    for digit in "0123456":
        code = f"regexp_replace({code}, '{digit}{digit}+', '{digit}', 'g')"
    return code


def sound(word: str) -> str:
    """SQL of the sound code of a word of Latin letters, else the word in capitals."""
    w = f"upper({word})"
    coded = _runs(f"(CASE WHEN {w}[1] IN ('H', 'W') THEN '7' ELSE {_LETTER_CODES(f'{w}[1]')} END || {_LETTER_CODES(f'{w}[2:]')})")
    return f"CASE WHEN regexp_matches({word}, '^[A-Za-z]{{2,}}$') THEN {w}[1] || rpad(replace({coded}[2:], '0', '') || '000', 3, '0')[1:3] ELSE {w} END"


_CODES = lambda ws: f"list_distinct(list_transform({ws}, lambda w1: {sound('w1')}))"
_CODED = lambda name: _CODES(f"string_split({name}, ' ')")
FEATURES["soundex_name_parts"] = share(_CODES(words("q.names")), _CODES(words("e.names")), 1.0)
FEATURES["name_soundex_match"] = best(cset("q.names"), cset("e.names"), f"len(list_intersect({_CODED('y1')}, {_CODED('y2')}))::DOUBLE / greatest(2.0, len(string_split(y1, ' '))::DOUBLE)")

GROUPS = {
    "fea_names": ("name_literal_match", "name_match", "name_token_overlap", "name_numbers", "name_levenshtein", "weak_alias_match"),
    "fea_entity_names": ("person_name_levenshtein", "org_name_levenshtein", "er_name_numbers", "er_name_token_overlap"),
    "fea_soundex": ("soundex_name_parts", "name_soundex_match"),
    "fea_jaro": ("ofac_name_score", "jaro_name_parts"),
    "fea_dates": ("dob_matches", "dob_year_matches", "dob_year_disjoint", "dob_day_disjoint", "dob_year_signed"),
    "fea_identifiers": ("identifier_match", "plain_identifier_match", "org_identifier_match", "orgid_disjoint", "weak_identifier_match"),
    "fea_countries": ("country_mismatch", "per_country_mismatch", "org_country_mismatch"),
    "fea_places": ("birth_place", "er_birth_place", "address_levenshtein", "er_address_match"),
    "fea_address_numbers": ("address_numbers", "address_number_overlap", "address_number_disagreement"),
    "fea_contacts": ("gender_mismatch", "er_gender_mismatch", "phone_match", "email_match", "contact_match"),
}


def _features(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    both = M.encode(pairs(spark, sf_dir), {n: getattr(X, n) for n in names})
    return both.select("left", "right", *[F.round(f"f_{n}", 5).alias(n) for n in names])


for _name, _parts in GROUPS.items():
    _select = ", ".join(f"round(({FEATURES[p]})::DOUBLE, 5) AS {p}" for p in _parts)
    REGISTRY.query(_name, f'{BASE} SELECT l AS "left", r AS "right", {_select} FROM x')(lambda spark, sf_dir, parts=_parts: _features(spark, sf_dir, parts))


@REGISTRY.query("fea_sounds")
def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features on sound codes and aligned words, which SQL has no functions for."""
    return _features(spark, sf_dir, ("name_metaphone_match", "person_name_phonetic_match", "person_name_jaro_winkler", "name_fingerprint_levenshtein"))


def _without(a: str, b: str) -> str:
    return f"list_filter({a}, lambda w0: NOT list_contains({b}, w0))"


def _missing(of: str) -> str:
    a, b = numbers(f"q.{of}"), numbers(f"e.{of}")
    return f"len({_without(a, b)})::DOUBLE / greatest(1.0, least(len({a}), len({b}))::DOUBLE)"


def _both(of: str) -> str:
    return f"len({numbers(f'q.{of}')}) > 0 AND len({numbers(f'e.{of}')}) > 0"


_X, _Y = "list_distinct(string_split(y1, ' '))", "list_distinct(string_split(y2, ' '))"
_XR, _YR = _without(_X, _Y), _without(_Y, _X)
_REST = lambda xs: f"array_to_string(list_sort({xs}), ' ')"
_N_COMMON = f"(len({_X}) - len({_XR}))::DOUBLE"
_N_LEFT = f"greatest(len({_XR}), len({_YR}))::DOUBLE"
FEATURES |= {
    "last_name_mismatch": flag(disjoint(words("q.lasts", 2), words("e.lasts", 2))),
    "numbers_mismatch": f"CASE WHEN {_both('names')} THEN {_missing('names')} WHEN {_both('addr')} THEN {_missing('addr')} ELSE 0.0 END",
    "address_prop_match": best(cset("q.addr"), cset("e.addr"), f"CASE WHEN len({_XR}) = 0 OR len({_YR}) = 0 THEN 1.0 ELSE ({_N_COMMON} + {_N_LEFT} * {lev(_REST(_XR), _REST(_YR))}) / ({_N_LEFT} + {_N_COMMON}) END"),
}
#: Features of things, securities, positions, wallets and addresses: zero for persons and organisations by definition.
_OTHER_KINDS = ("obj_name_levenshtein", "object_names", "security_isin_mismatch", "position_country_match", "crypto_wallet_address", "address_entity_match")
_STRICT = ("last_name_mismatch", "numbers_mismatch", "address_prop_match")


@REGISTRY.query("fea_strict", f'{BASE} SELECT l AS "left", r AS "right", ' + ", ".join([*[f"0.0::DOUBLE AS {n}" for n in _OTHER_KINDS], *[f"round(({FEATURES[n]})::DOUBLE, 5) AS {n}" for n in _STRICT]]) + " FROM x")
def strict_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of other kinds of entities, and strict ones on numbers and addresses."""
    return _features(spark, sf_dir, (*_OTHER_KINDS, *_STRICT))


@REGISTRY.query("fea_territories", f'{BASE} SELECT l AS "left", r AS "right", round({flag(ov(_COUNTRY("q"), _COUNTRY("e")))}::DOUBLE, 5) AS territory_overlap FROM x')
def territory_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of countries and the territories they belong to; no code here is one of a territory's parent."""
    both = M.encode(pairs(spark, sf_dir), {"territory_overlap": X.territory_overlap({"gb-eng": "gb", "us-ca": "us"})})
    return both.select("left", "right", F.round("f_territory_overlap", 5).alias("territory_overlap"))


def _scores(spark: SparkSession, sf_dir: str, name: str, overrides: dict[str, float] | None = None) -> DataFrame:
    return M.algorithm(name).score(pairs(spark, sf_dir), overrides=overrides).select("left", "right", F.round("score", 5).alias("score"))


def _clamped(main: str, qualifiers: dict[str, float]) -> str:
    total = " + ".join([f"({main})", *[f"({w}) * ({FEATURES[n]})" for n, w in qualifiers.items()]])
    return f'{BASE} SELECT l AS "left", r AS "right", round(CASE WHEN {_GATE} AND ({main}) > 0 THEN greatest(0.0, least(1.0, {total})) ELSE 0.0 END::DOUBLE, 5) AS score FROM x'


_QUAL = {"country_mismatch": -0.1, "dob_year_disjoint": -0.1, "dob_day_disjoint": -0.15, "gender_mismatch": -0.1, "orgid_disjoint": -0.1}


@REGISTRY.query("alg_sanction_search", _clamped(FEATURES["ofac_name_score"], _QUAL))
def sanction_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "sanction-search")


@REGISTRY.query("alg_name_qualified_jaro", _clamped(f"0.5 * ({FEATURES['jaro_name_parts']})", _QUAL))
def name_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The qualified name scorer without its sound codes."""
    return _scores(spark, sf_dir, "name-qualified", {"soundex_name_parts": 0.0})


_V1 = {"country_mismatch": -0.2, "dob_year_disjoint": -0.15, "dob_day_disjoint": -0.2, "gender_mismatch": -0.2, "orgid_disjoint": -0.2}


@REGISTRY.query("alg_logic_v1_plain", _clamped(f"greatest(1.0 * ({FEATURES['name_literal_match']}), 0.85 * ({FEATURES['identifier_match']}), 0.8 * ({FEATURES['weak_alias_match']}))", _V1))
def logic_v1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule scorer without the features that SQL has no functions for, switched off by their weights."""
    off = ("person_name_jaro_winkler", "person_name_phonetic_match", "name_fingerprint_levenshtein", "numbers_mismatch", "last_name_mismatch")
    return _scores(spark, sf_dir, "logic-v1", dict.fromkeys(off, 0.0))


_NAMES = f"0.5 * ({FEATURES['soundex_name_parts']}) + 0.5 * ({FEATURES['jaro_name_parts']})"


def _named(qualifiers: dict[str, float]) -> str:
    total = " + ".join([_NAMES, *[f"({w}) * ({FEATURES[n]})" for n, w in qualifiers.items()]])
    positive = f"(({FEATURES['soundex_name_parts']}) > 0 OR ({FEATURES['jaro_name_parts']}) > 0)"
    return f'{BASE} SELECT l AS "left", r AS "right", round(CASE WHEN {_GATE} AND {positive} THEN greatest(0.0, least(1.0, {total})) ELSE 0.0 END::DOUBLE, 5) AS score FROM x'


for _alg, _sql in (("logic-v1", None), ("logic-v2", None), ("name-based", _named({})), ("name-qualified", _named(_QUAL))):
    REGISTRY.query("alg_" + _alg.replace("-", "_"), _sql)(lambda spark, sf_dir, name=_alg: _scores(spark, sf_dir, name))


_V2 = {"address_prop_match": 0.2, "country_mismatch": -0.2, "dob_year_disjoint": -0.15, "dob_day_disjoint": -0.25, "gender_mismatch": -0.2}


@REGISTRY.query("alg_logic_v2_plain", _clamped(f"greatest(0.85 * ({FEATURES['identifier_match']}), 0.8 * ({FEATURES['weak_alias_match']}))", _V2))
def logic_v2_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second rule scorer without its name feature, switched off by its weight."""
    return _scores(spark, sf_dir, "logic-v2", {"name_match": 0.0})


@REGISTRY.query("alg_docs", "SELECT 'sanction-search' AS algorithm, * FROM (VALUES ('whole_or_parts', 1.0, false), ('country_mismatch', -0.1, true), ('dob_year_disjoint', -0.1, true), ('dob_day_disjoint', -0.15, true), ('gender_mismatch', -0.1, true), ('orgid_disjoint', -0.1, true)) AS t(feature, weight, qualifier)")
def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("sanction-search", n, w, q) for n, w, q, _ in M.SANCTION_SEARCH.docs()]
    return spark.createDataFrame(rows, "algorithm string, feature string, weight double, qualifier boolean")


_TOLD = " UNION ALL ".join(f"SELECT '{n}' AS feature, ({f})::DOUBLE AS v FROM x WHERE {_GATE}" for n, f in {"whole_or_parts": FEATURES["ofac_name_score"], **{q: FEATURES[q] for q in _QUAL}}.items())


@REGISTRY.query("alg_explanations", f"{BASE} SELECT feature, count(*) AS n, round(avg(v), 5) AS mean FROM ({_TOLD}) WHERE v <> 0 GROUP BY feature")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feature of the sanction search counts, and its mean there."""
    scored = M.SANCTION_SEARCH.score(pairs(spark, sf_dir))
    return scored.select(F.explode("explanations").alias("feature", "value")).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))


_MODEL = {n: (k % 7 - 3) * 0.25 for k, n in enumerate(M.REGRESSION_V1)}


@REGISTRY.query("snk_model", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}::DOUBLE)" for n, c in _MODEL.items()) + ") AS t(feature, coefficient)")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients of a model that was saved and loaded again."""
    path = f"{Scratch(spark, 'model').base}/model"
    M.save_model(spark, M.Regression("regression-v1", M.REGRESSION_V1, _MODEL, 0.5), path)
    return spark.createDataFrame(list(M.load_model(spark, "regression-v1", path).coefficients.items()), "feature string, coefficient double")


@REGISTRY.query("flt_schemata", "SELECT entity_id AS id, max(\"schema\") AS \"schema\" FROM statements WHERE entity_id IS NOT NULL AND value IS NOT NULL AND \"schema\" IN ('Person', 'Company', 'Organization') GROUP BY entity_id HAVING max(\"schema\") = 'Organization'")
def exact_schemata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations, without the companies, which are organisations too."""
    return S.of_schemata(entities(spark, sf_dir), ["Organization"]).select("id", "schema")


@REGISTRY.query("xref_scored")
def xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking, judgements, entities and scores together: suggestions and merges."""
    found = M.xref(
        S.assemble(table(spark, sf_dir, "statements")), B.token_entries(table(spark, sf_dir, "entries")), table(spark, sf_dir, "resolver"), scorer=M.SANCTION_SEARCH, auto_threshold=0.98
    )
    return found.withColumn("score", F.round("score", 5))
