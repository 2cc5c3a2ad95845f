"""Features of a pair of entities: functions of two entity structs to a score.

An entity is a struct with ``schema`` and ``properties`` (a map of value arrays). Every feature is a column expression;
those on Jaro-Winkler and sound codes call vectorised functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.functions import similarity as S
from knotwork.operators.ontology import PROPERTIES, SCHEMATA, ancestors, can_match, props_of_type

Feature = Callable[[Column, Column], Column]
NAMES = ("name", "alias", "weakAlias", "firstName", "lastName")
#: Formats of identifiers that hold for one thing only. Fixed values.
STRONG_FORMATS = ("lei", "bic", "inn", "ogrn", "isin", "imo", "uei", "npi")


def values(entity: Column, *props: str) -> Column:
    """The distinct values of some properties."""
    parts = [F.coalesce(entity["properties"][p], F.array().cast("array<string>")) for p in props]
    return F.array_distinct(F.flatten(F.array(*parts)))


def kind_of(entity: Column, *schemata: str) -> Column:
    names = [s for s in SCHEMATA if set(ancestors(s)) & set(schemata)]
    return entity["schema"].isin(*names)


def compatible(left: Column, right: Column) -> Column:
    known = F.array(*[F.lit(f"{a}|{b}") for a in SCHEMATA for b in SCHEMATA if can_match(a, b)])
    return F.array_contains(known, F.concat_ws("|", left["schema"], right["schema"])) | (left["schema"] == right["schema"])


def either(left: Column, right: Column, *schemata: str) -> Column:
    """The pair has a common schema, and it is a kind of one of these."""
    return compatible(left, right) & (kind_of(left, *schemata) | kind_of(right, *schemata))


def flag(condition: Column, score: float = 1.0) -> Column:
    return F.when(condition, score).otherwise(0.0)


def names(e: Column) -> Column:
    return values(e, *NAMES)


def identifiers(e: Column) -> Column:
    return values(e, *props_of_type("identifier"))


def strict_identifiers(e: Column) -> Column:
    return S.nonempty(F.transform(identifiers(e), S.strict_id))


def countries(e: Column) -> Column:
    return S.nonempty(F.transform(values(e, *props_of_type("country")), lambda v: F.lower(F.trim(v))))


def addresses(e: Column) -> Column:
    return values(e, *props_of_type("address"))


# names


def name_literal_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(S.nonempty(F.transform(names(q), S.light)), S.nonempty(F.transform(names(r), S.light))))


def name_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(S.clean_set(names(q)), S.clean_set(names(r))))


def name_token_overlap(q: Column, r: Column) -> Column:
    return S.share(S.words(names(q), 3), S.words(names(r), 3), 2.0)


def name_numbers(q: Column, r: Column) -> Column:
    return flag(S.disjoint(S.numbers(names(q)), S.numbers(names(r))))


def name_levenshtein(q: Column, r: Column) -> Column:
    return S.best_pair(S.clean_set(names(q)), S.clean_set(names(r)), S.levenshtein_ratio)


def _sorted_names(e: Column) -> Column:
    plain = S.clean_set(names(e))
    return F.array_union(plain, F.transform(plain, lambda v: F.array_join(F.array_sort(F.split(v, " ")), " ")))


def person_name_levenshtein(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Person"), S.best_pair(_sorted_names(q), _sorted_names(r), S.levenshtein_ratio)).otherwise(0.0)


def org_name_levenshtein(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Organization"), name_levenshtein(q, r)).otherwise(0.0)


def legal_name_levenshtein(q: Column, r: Column) -> Column:
    both = (q["schema"] == "LegalEntity") & (r["schema"] == "LegalEntity")
    return F.when(both, S.best_pair(_sorted_names(q), _sorted_names(r), S.levenshtein_ratio)).otherwise(0.0)


def obj_name_levenshtein(q: Column, r: Column) -> Column:
    not_things = either(q, r, "LegalEntity", "Security", "RealEstate", "CryptoWallet")
    return F.when(not_things, 0.0).otherwise(S.best_pair(S.clean_set(names(q)), S.clean_set(names(r)), S.clipped_levenshtein))


def object_names(q: Column, r: Column) -> Column:
    """Names of things, strictly, less where their numbers differ."""
    score = S.best_pair(S.clean_set(names(q)), S.clean_set(names(r)), lambda a, b: S.strict_levenshtein(a, b, 5) * F.when(F.size(F.array_except(S.numbers(F.array(a)), S.numbers(F.array(b)))) > 0, 0.7).otherwise(1.0))
    return F.when(either(q, r, "LegalEntity"), 0.0).otherwise(score)


#: Legal forms and their common short form. Fixed values.
FORMS = {
    "aktiengesellschaft": "ag", "gesellschaft mbh": "gmbh", "g m b h": "gmbh", "incorporated": "inc", "limited liability company": "llc", "l l c": "llc", "limited": "ltd", "besloten vennootschap": "bv", "b v": "bv",
    "societe anonyme": "sa", "s a": "sa", "o o o": "ooo", "a g": "ag",
}


def fingerprint(value: Column) -> Column:
    """A clean name with short legal forms."""
    out = S.clean(value)
    for long, short in FORMS.items():
        out = F.regexp_replace(out, rf"(^| ){long}($| )", f"$1{short}$2")
    return F.trim(out)


def name_fingerprint_levenshtein(q: Column, r: Column) -> Column:
    a = S.nonempty(F.transform(names(q), fingerprint))
    b = S.nonempty(F.transform(names(r), fingerprint))
    joined = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    ordered = lambda v: F.array_join(F.array_sort(F.split(v, " ")), "")
    best = F.greatest(S.best_pair(S.clean_set(names(q)), S.clean_set(names(r)), S.levenshtein_ratio), S.best_pair(F.transform(a, joined), F.transform(b, joined), S.levenshtein_ratio), S.best_pair(F.transform(a, ordered), F.transform(b, ordered), S.levenshtein_ratio))
    return F.when(either(q, r, "Person"), 0.0).otherwise(best)


def weak_alias_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(S.nonempty(F.transform(names(q), S.light)), S.nonempty(F.transform(values(r, "weakAlias", "abbreviation"), S.light))))


def first_name_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(S.words(values(q, "firstName"), 3), S.words(values(r, "firstName"), 3)))


def family_name_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(S.words(values(q, "lastName"), 3), S.words(values(r, "lastName"), 3)))


def family_name_signed(q: Column, r: Column) -> Column:
    a, b = S.words(values(q, "lastName"), 3), S.words(values(r, "lastName"), 3)
    return F.when(~either(q, r, "Person") | (F.size(a) == 0) | (F.size(b) == 0), 0.0).when(S.overlaps(a, b), 1.0).otherwise(-1.0)


def last_name_mismatch(q: Column, r: Column) -> Column:
    return flag(S.disjoint(S.words(values(q, "lastName"), 2), S.words(values(r, "lastName"), 2)))


def er_name_token_overlap(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "LegalEntity", "Position", "Vehicle"), name_token_overlap(q, r)).otherwise(0.0)


def er_name_numbers(q: Column, r: Column) -> Column:
    a, b = S.numbers(names(q)), S.numbers(names(r))
    total, common = F.size(a) + F.size(b), F.size(F.array_intersect(a, b))
    return F.when(total == 0, 0.0).when((common == 0) & (F.size(a) > 0) & (F.size(b) > 0), -1.0).otherwise(common / total)


def soundex_name_parts(q: Column, r: Column) -> Column:
    code = lambda e: F.array_distinct(F.transform(S.words(names(e)), S.soundex_word))
    return S.share(code(q), code(r), 1.0)


def name_soundex_match(q: Column, r: Column) -> Column:
    """Common sound codes of two names over the words of the first, or two."""
    codes = lambda n: F.transform(F.split(n, " "), S.soundex_word)
    score = lambda a, b: F.size(F.array_intersect(codes(a), codes(b))) / F.greatest(F.lit(2.0), F.size(codes(a)).cast("double"))
    return S.best_pair(S.clean_set(names(q)), S.clean_set(names(r)), score)


def jaro_name_parts(q: Column, r: Column) -> Column:
    return S.jaro_parts(S.words(names(q)), S.words(names(r)))


def ofac_name_score(q: Column, r: Column) -> Column:
    return S.whole_or_parts(S.clean_set(names(q)), S.clean_set(names(r)))


def person_name_jaro_winkler(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Person"), S.person_jaro(S.clean_set(names(q)), S.clean_set(names(r)))).otherwise(0.0)


def name_metaphone_match(q: Column, r: Column) -> Column:
    return S.metaphone_overlap(S.clean_set(names(q)), S.clean_set(names(r)))


def person_name_phonetic_match(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Person"), S.phonetic_share(S.clean_set(names(q)), S.clean_set(names(r)))).otherwise(0.0)


# dates


def _dates(e: Column, precision: int) -> Column:
    return F.array_distinct(F.transform(F.filter(values(e, "birthDate"), lambda v: F.length(v) >= precision), lambda v: F.substring(v, 1, precision)))


def _flipped(days: Column) -> Column:
    return F.transform(days, lambda d: F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 9, 2), F.substring(d, 6, 2)))


def dob_matches(q: Column, r: Column) -> Column:
    a, b = _dates(q, 10), _dates(r, 10)
    return F.when(S.overlaps(a, b), 1.0).when(S.overlaps(_flipped(a), b), 0.5).otherwise(0.0)


def dob_year_matches(q: Column, r: Column) -> Column:
    return flag(S.overlaps(_dates(q, 4), _dates(r, 4)))


def dob_year_signed(q: Column, r: Column) -> Column:
    a, b = _dates(q, 4), _dates(r, 4)
    return F.when(~either(q, r, "Person") | (F.size(a) == 0) | (F.size(b) == 0), 0.0).when(S.overlaps(a, b), 1.0).otherwise(-1.0)


def dob_day_disjoint(q: Column, r: Column) -> Column:
    a, b = _dates(q, 10), _dates(r, 10)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | S.overlaps(a, b), 0.0).when(S.overlaps(_flipped(a), b), 0.5).otherwise(1.0)


def dob_year_disjoint(q: Column, r: Column) -> Column:
    return flag(S.disjoint(_dates(q, 4), _dates(r, 4)))


# identifiers


def identifier_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(strict_identifiers(q), strict_identifiers(r)))


def plain_identifier_match(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Organization"), 0.0).otherwise(flag(S.overlaps(identifiers(q), identifiers(r))))


def org_identifier_match(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Organization"), flag(S.overlaps(identifiers(q), identifiers(r)))).otherwise(0.0)


def orgid_disjoint(q: Column, r: Column) -> Column:
    a, b = strict_identifiers(q), strict_identifiers(r)
    ratio = S.best_pair(a, b, lambda x, y: F.when(S.levenshtein_ratio(x, y) > 0.7, S.levenshtein_ratio(x, y)).otherwise(0.0))
    return F.when(either(q, r, "Organization") & S.disjoint(a, b), 1.0 - ratio).otherwise(0.0)


def crypto_wallet_address(q: Column, r: Column) -> Column:
    key = lambda e: F.filter(values(e, "publicKey"), lambda v: F.length(v) > 10)
    return flag(S.overlaps(key(q), key(r)))


def id_match(prop: str, *others: str) -> Feature:
    """A property of either side equals any identifier of the other."""

    def match(q: Column, r: Column) -> Column:
        own = lambda e: S.nonempty(F.transform(values(e, prop, *others), S.strict_id))
        return flag(S.overlaps(own(q), strict_identifiers(r)) | S.overlaps(strict_identifiers(q), own(r)))

    match.__name__ = f"{prop}_match"
    match.__doc__ = f"The {prop} of either side is an identifier of the other."
    return match


def format_match(fmt: str) -> Feature:
    """Identifiers of a format agree, or one agrees with an identifier without format on the other side."""
    with_format = [n for n, p in PROPERTIES.items() if p.format == fmt]
    without = [n for n, p in PROPERTIES.items() if p.type == "identifier" and p.matchable and p.format is None]

    def match(q: Column, r: Column) -> Column:
        own = lambda e: S.nonempty(F.transform(values(e, *with_format), S.strict_id))
        loose = lambda e: S.nonempty(F.transform(values(e, *without), S.strict_id))
        return flag(S.overlaps(own(q), own(r)) | S.overlaps(own(q), loose(r)) | S.overlaps(loose(q), own(r)))

    match.__name__ = f"{fmt}_code_match"
    match.__doc__ = f"Identifiers of the format {fmt} agree."
    return match


def _strong(e: Column) -> Column:
    props = [(n, p.format) for n, p in PROPERTIES.items() if p.format in STRONG_FORMATS]
    return F.flatten(F.array(*[F.transform(values(e, n), _tagged(f)) for n, f in props]))


def _tagged(fmt: str) -> Callable[[Column], Column]:
    return lambda value: F.concat(F.lit(f"{fmt}:"), value)


def _weak(e: Column) -> Column:
    return S.nonempty(F.transform(values(e, *[n for n, p in PROPERTIES.items() if p.type == "identifier" and p.matchable and p.format not in STRONG_FORMATS]), S.strict_id))


def strong_identifier_match(q: Column, r: Column) -> Column:
    a, b = _strong(q), _strong(r)
    value = lambda xs: F.transform(xs, lambda v: F.substring_index(v, ":", -1))
    formats = lambda xs: F.array_distinct(F.transform(xs, lambda v: F.substring_index(v, ":", 1)))
    crossed = S.overlaps(value(a), _weak(r)) | S.overlaps(value(b), _weak(q))
    return F.when(S.overlaps(a, b), 1.0).when(crossed, 0.7).otherwise(-0.2 * F.size(F.array_intersect(formats(a), formats(b))))


def weak_identifier_match(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "LegalEntity"), flag(S.overlaps(_weak(q), _weak(r)))).otherwise(0.0)


def security_isin_mismatch(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Security"), flag(S.disjoint(values(q, "isin"), values(r, "isin")))).otherwise(0.0)


# places


def territories(codes: Column, parents: dict[str, str] | None = None) -> Column:
    """Country codes with the territories they belong to, by (territory, parent); a code as ``us-ca`` belongs to its first part."""
    up = {k.lower(): v.lower() for k, v in (parents or {}).items()}
    whole = F.array_union(codes, F.transform(codes, lambda c: F.substring_index(c, "-", 1)))
    if not up:
        return whole
    known = F.create_map(*[F.lit(x) for kv in up.items() for x in kv])
    for _ in range(3):  # a part of a part of a country
        whole = F.array_union(whole, F.array_compact(F.transform(whole, lambda c: known[c])))
    return whole


def territory_overlap(parents: dict[str, str] | None = None) -> Feature:
    """The feature that two entities' countries are the same, or one lies in the other."""

    def overlap(q: Column, r: Column) -> Column:
        a, b = countries(q), countries(r)
        return flag(S.overlaps(territories(a, parents), b) | S.overlaps(a, territories(b, parents)))

    overlap.__name__ = "territory_overlap"
    return overlap


def country_mismatch(q: Column, r: Column) -> Column:
    return flag(S.disjoint(countries(q), countries(r)))


def per_country_mismatch(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Person"), country_mismatch(q, r)).otherwise(0.0)


def org_country_mismatch(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "LegalEntity") & ~either(q, r, "Person"), country_mismatch(q, r)).otherwise(0.0)


def position_country_match(q: Column, r: Column) -> Column:
    a, b = countries(q), countries(r)
    return F.when(~either(q, r, "Position") | (F.size(a) == 0) | (F.size(b) == 0), 0.0).when(S.overlaps(a, b), 1.0).otherwise(-1.0)


def birth_place(q: Column, r: Column) -> Column:
    return S.share(S.words(values(q, "birthPlace"), 3), S.words(values(r, "birthPlace"), 3), 2.0)


def er_birth_place(q: Column, r: Column) -> Column:
    a, b = S.words(values(q, "birthPlace"), 4), S.words(values(r, "birthPlace"), 4)
    return F.when(either(q, r, "Person"), S.share(a, b, 1.0)).otherwise(0.0)


def address_levenshtein(q: Column, r: Column) -> Column:
    return S.best_pair(S.clean_set(addresses(q)), S.clean_set(addresses(r)), S.levenshtein_ratio)


def er_address_match(q: Column, r: Column) -> Column:
    return S.share(S.words(addresses(q), 4), S.words(addresses(r), 4), 1.0)


def address_numbers(q: Column, r: Column) -> Column:
    a, b = S.numbers(addresses(q)), S.numbers(addresses(r))
    score = F.size(F.array_intersect(a, b)) - F.size(F.array_except(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score.cast("double"))


def address_number_overlap(q: Column, r: Column) -> Column:
    return S.share(S.numbers(addresses(q)), S.numbers(addresses(r)), 1.0)


def address_number_disagreement(q: Column, r: Column) -> Column:
    a, b = S.numbers(addresses(q)), S.numbers(addresses(r))
    union, common = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise((union - common) / union)


def _address_score(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    common = F.array_intersect(x, y)
    rest = lambda s: F.array_sort(F.array_except(s, common))
    fuzzy = S.levenshtein_ratio(F.array_join(rest(x), " "), F.array_join(rest(y), " "))
    left = F.greatest(F.size(rest(x)), F.size(rest(y))).cast("double")
    n = F.size(common).cast("double")
    return F.when((F.size(common) == F.size(x)) | (F.size(common) == F.size(y)), 1.0).otherwise((n + left * fuzzy) / (left + n))


def _address_match(q: Column, r: Column) -> Column:
    return S.best_pair(S.clean_set(addresses(q)), S.clean_set(addresses(r)), _address_score)


def address_entity_match(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Address"), _address_match(q, r)).otherwise(0.0)


def address_prop_match(q: Column, r: Column) -> Column:
    return F.when(either(q, r, "Address"), 0.0).otherwise(_address_match(q, r))


def numbers_mismatch(q: Column, r: Column) -> Column:
    """Numbers in names or addresses of the first that the second lacks, over the smaller set."""

    def part(get: Callable[[Column], Column]) -> Column:
        a, b = S.numbers(get(q)), S.numbers(get(r))
        return F.size(F.array_except(a, b)) / F.greatest(F.lit(1.0), F.least(F.size(a), F.size(b)).cast("double"))

    return F.when((F.size(S.numbers(names(q))) > 0) & (F.size(S.numbers(names(r))) > 0), part(names)).when((F.size(S.numbers(addresses(q))) > 0) & (F.size(S.numbers(addresses(r))) > 0), part(addresses)).otherwise(0.0)


# persons and contacts


def gender_mismatch(q: Column, r: Column) -> Column:
    return flag(S.disjoint(values(q, "gender"), values(r, "gender")))


def er_gender_mismatch(q: Column, r: Column) -> Column:
    plain = lambda e: F.filter(values(e, "gender"), lambda v: v != "other")
    return flag((F.size(plain(q)) == 1) & (F.size(plain(r)) == 1) & ~S.overlaps(plain(q), plain(r)))


def phone_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(values(q, "phone"), values(r, "phone")))


def email_match(q: Column, r: Column) -> Column:
    return flag(S.overlaps(values(q, "email"), values(r, "email")))


def contact_match(q: Column, r: Column) -> Column:
    return F.greatest(phone_match(q, r), email_match(q, r), flag(S.overlaps(values(q, *props_of_type("url")), values(r, *props_of_type("url")))))


@dataclass(frozen=True)
class Weighted:
    """A feature of a scoring algorithm."""

    name: str
    feature: Feature
    weight: float
    qualifier: bool = False
