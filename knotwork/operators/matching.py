"""Scoring algorithms over pairs of entities, candidate search with scores, and matcher training."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions import features as X
from knotwork.functions.features import Weighted
from knotwork.functions.name_parts import NameConfig, name_score


@dataclass(frozen=True)
class Algorithm:
    """A heuristic scorer: main features, and qualifiers that correct a positive score.

    combine: ``max`` takes the best weighted main feature, ``sum`` adds them.
    """

    name: str
    features: tuple[Weighted, ...]
    combine: str = "max"

    def weights(self, overrides: dict[str, float] | None = None) -> dict[str, float]:
        known = {f.name for f in self.features}
        if unknown := set(overrides or {}) - known:
            raise ValueError(f"{self.name} has no features {sorted(unknown)}")
        return {f.name: (overrides or {}).get(f.name, f.weight) for f in self.features}

    def docs(self) -> list[tuple[str, float, bool, str]]:
        """(name, weight, qualifier, description) of each feature."""
        return [(f.name, f.weight, f.qualifier, (f.feature.__doc__ or "").strip().split("\n")[0]) for f in self.features]

    def score(self, pairs: DataFrame, left: str = "l", right: str = "r", overrides: dict[str, float] | None = None) -> DataFrame:
        """pairs with ``score`` in [0, 1] and ``explanations``, a map of the features that are not zero.

        Pairs of incompatible schemata score 0; so do pairs without a positive main feature, before any qualifier counts,
        unless all main features are switched off by weight 0.
        """
        q, r = F.col(left), F.col(right)
        weights = self.weights(overrides)
        used = [f for f in self.features if weights[f.name] != 0]
        gate = X.compatible(q, r)
        # each feature once, as a column, so that scores and explanations share it
        out = pairs.withColumns({f"_{f.name}": F.when(gate, f.feature(q, r)).otherwise(0.0) for f in used})
        mains = [f for f in used if not f.qualifier]
        qualifiers = [f for f in used if f.qualifier]
        part = lambda f: F.col(f"_{f.name}") * weights[f.name]
        best = F.lit(0.0)
        if len(mains) == 1:
            best = F.col(f"_{mains[0].name}")
        elif mains:
            best = F.greatest(*[F.col(f"_{f.name}") for f in mains])
        total = F.lit(0.0)
        if mains:
            total = sum((part(f) for f in mains), F.lit(0.0)) if self.combine == "sum" else (F.greatest(*[part(f) for f in mains]) if len(mains) > 1 else part(mains[0]))
        for f in qualifiers:
            total = total + part(f)
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
        score = F.when(gate & (best > 0), clamped).otherwise(0.0) if mains else F.when(gate, clamped).otherwise(0.0)
        told = F.map_filter(F.create_map(*[x for f in used for x in (F.lit(f.name), F.col(f"_{f.name}"))]), lambda _, v: v != 0)
        return out.withColumn("score", score).withColumn("explanations", told).drop(*[f"_{f.name}" for f in used])


_QUALIFIED = (
    Weighted("country_mismatch", X.country_mismatch, -0.1, True),
    Weighted("dob_year_disjoint", X.dob_year_disjoint, -0.1, True),
    Weighted("dob_day_disjoint", X.dob_day_disjoint, -0.15, True),
    Weighted("gender_mismatch", X.gender_mismatch, -0.1, True),
    Weighted("orgid_disjoint", X.orgid_disjoint, -0.1, True),
)
NAME_BASED = Algorithm("name-based", (Weighted("soundex_name_parts", X.soundex_name_parts, 0.5), Weighted("jaro_name_parts", X.jaro_name_parts, 0.5)), "sum")
NAME_QUALIFIED = Algorithm("name-qualified", (*NAME_BASED.features, *_QUALIFIED), "sum")
SANCTION_SEARCH = Algorithm("sanction-search", (Weighted("whole_or_parts", X.ofac_name_score, 1.0), *_QUALIFIED), "sum")
LOGIC_V1 = Algorithm(
    "logic-v1",
    (
        Weighted("name_literal_match", X.name_literal_match, 1.0),
        Weighted("person_name_jaro_winkler", X.person_name_jaro_winkler, 0.8),
        Weighted("person_name_phonetic_match", X.person_name_phonetic_match, 0.9),
        Weighted("name_fingerprint_levenshtein", X.name_fingerprint_levenshtein, 0.9),
        Weighted("name_metaphone_match", X.name_metaphone_match, 0.0),
        Weighted("name_soundex_match", X.name_soundex_match, 0.0),
        Weighted("address_entity_match", X.address_entity_match, 0.98),
        Weighted("crypto_wallet_address", X.crypto_wallet_address, 0.98),
        Weighted("isin_security_match", X.id_match("isin"), 0.98),
        Weighted("lei_code_match", X.id_match("leiCode"), 0.95),
        Weighted("ogrn_code_match", X.id_match("ogrnCode"), 0.95),
        Weighted("vessel_imo_match", X.id_match("imoNumber"), 0.95),
        Weighted("inn_code_match", X.id_match("innCode"), 0.95),
        Weighted("bic_code_match", X.id_match("swiftBic"), 0.95),
        Weighted("identifier_match", X.identifier_match, 0.85),
        Weighted("weak_alias_match", X.weak_alias_match, 0.8),
        Weighted("country_mismatch", X.country_mismatch, -0.2, True),
        Weighted("last_name_mismatch", X.last_name_mismatch, -0.2, True),
        Weighted("dob_year_disjoint", X.dob_year_disjoint, -0.15, True),
        Weighted("dob_day_disjoint", X.dob_day_disjoint, -0.2, True),
        Weighted("gender_mismatch", X.gender_mismatch, -0.2, True),
        Weighted("orgid_disjoint", X.orgid_disjoint, -0.2, True),
        Weighted("numbers_mismatch", X.numbers_mismatch, -0.1, True),
    ),
)


def name_feature(config: NameConfig = NameConfig(), prop: str | None = None) -> X.Feature:  # noqa: B008
    """The name feature of the second rule scorer with settings; prop: the only property whose values are names."""
    names = X.names if prop is None else lambda e: X.values(e, prop)

    def name_match(q: Column, r: Column) -> Column:
        """Names aligned part by part; those of things strictly."""
        aligned = name_score(q, r, names, X.values, X.either(q, r, "Person"), config)
        things = F.greatest(X.name_literal_match(q, r), X.object_names(q, r))
        return F.when(X.either(q, r, "LegalEntity"), aligned).otherwise(things)

    return name_match


LOGIC_V2 = Algorithm(
    "logic-v2",
    (
        Weighted("name_match", name_feature(), 1.0),
        Weighted("address_entity_match", X.address_entity_match, 0.98),
        Weighted("crypto_wallet_address", X.crypto_wallet_address, 0.98),
        *[Weighted(f"{f}_code_match", X.format_match(f), 0.98 if f == "isin" else 0.95) for f in ("isin", "lei", "ogrn", "imo", "inn", "bic", "uei", "npi")],
        Weighted("identifier_match", X.identifier_match, 0.85),
        Weighted("weak_alias_match", X.weak_alias_match, 0.8),
        Weighted("address_prop_match", X.address_prop_match, 0.2, True),
        Weighted("country_mismatch", X.country_mismatch, -0.2, True),
        Weighted("dob_year_disjoint", X.dob_year_disjoint, -0.15, True),
        Weighted("dob_day_disjoint", X.dob_day_disjoint, -0.25, True),
        Weighted("gender_mismatch", X.gender_mismatch, -0.2, True),
    ),
)

#: Settings of the second rule scorer, with their defaults. Fixed values.
LOGIC_V2_SETTINGS = {"nm_name_property": None, "nm_number_mismatch": 0.3, "nm_extra_query_name": 0.8, "nm_extra_result_name": 0.2, "nm_family_name_weight": 1.3, "nm_fuzzy_cutoff_factor": 1.0}


def logic_v2(**settings: float | str | None) -> Algorithm:
    """The second rule scorer with some of ``LOGIC_V2_SETTINGS`` changed."""
    if unknown := set(settings) - set(LOGIC_V2_SETTINGS):
        raise ValueError(f"no settings {sorted(unknown)}")
    x = LOGIC_V2_SETTINGS | settings
    config = NameConfig(x["nm_number_mismatch"], x["nm_extra_query_name"], x["nm_extra_result_name"], x["nm_family_name_weight"], x["nm_fuzzy_cutoff_factor"])
    changed = Weighted("name_match", name_feature(config, x["nm_name_property"]), 1.0)
    return Algorithm(LOGIC_V2.name, tuple(changed if f.name == "name_match" else f for f in LOGIC_V2.features))


#: Features of the two regression scorers, in order.
REGRESSION_V1: dict[str, X.Feature] = {
    "name_match": X.name_match, "name_token_overlap": X.name_token_overlap, "name_numbers": X.name_numbers, "name_levenshtein": X.name_levenshtein, "phone_match": X.phone_match, "email_match": X.email_match,
    "identifier_match": X.plain_identifier_match, "dob_matches": X.dob_matches, "dob_year_matches": X.dob_year_matches, "dob_year_disjoint": X.dob_year_disjoint, "first_name_match": X.first_name_match,
    "family_name_match": X.family_name_match, "birth_place": X.birth_place, "gender_mismatch": X.gender_mismatch, "country_mismatch": X.country_mismatch, "org_identifier_match": X.org_identifier_match,
    "address_match": X.address_levenshtein, "address_numbers": X.address_numbers,
}
ENTITY_REGRESSION: dict[str, X.Feature] = {
    "name_token_overlap": X.er_name_token_overlap, "name_numbers": X.er_name_numbers, "legal_name_levenshtein": X.legal_name_levenshtein, "person_name_levenshtein": X.person_name_levenshtein,
    "org_name_levenshtein": X.org_name_levenshtein, "strong_identifier_match": X.strong_identifier_match, "weak_identifier_match": X.weak_identifier_match, "dob_match": X.dob_matches, "dob_year_match": X.dob_year_signed,
    "contact_match": X.contact_match, "family_name_match": X.family_name_signed, "birth_place": X.er_birth_place, "gender_mismatch": X.er_gender_mismatch, "per_country_mismatch": X.per_country_mismatch,
    "position_country_match": X.position_country_match, "org_country_mismatch": X.org_country_mismatch, "security_isin_mismatch": X.security_isin_mismatch, "obj_name_levenshtein": X.obj_name_levenshtein,
    "address_match": X.er_address_match, "address_number_overlap": X.address_number_overlap, "address_number_disagreement": X.address_number_disagreement,
}


@dataclass(frozen=True)
class Regression:
    """A logistic scorer: features, standardisation and coefficients. The features must be those it was trained on."""

    name: str
    features: dict[str, X.Feature] = field(repr=False)
    coefficients: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def __post_init__(self) -> None:
        if self.coefficients and list(self.coefficients) != list(self.features):
            raise ValueError("the model was not trained on these features")

    def score(self, pairs: DataFrame, left: str = "l", right: str = "r", overrides: dict[str, float] | None = None) -> DataFrame:
        out = encode(pairs, self.features, left, right)
        weights = self.coefficients | (overrides or {})
        z = F.lit(self.intercept)
        for n in self.features:
            z = z + F.col(f"f_{n}") * weights.get(n, 0.0)
        told = F.create_map(*[x for n in self.features for x in (F.lit(n), F.col(f"f_{n}"))])
        return out.withColumn("score", 1.0 / (1.0 + F.exp(-z))).withColumn("explanations", told).drop(*[f"f_{n}" for n in self.features])


def save_model(spark: SparkSession, model: Regression, path: str) -> None:
    """A model as a table of its features, in order, with coefficients."""
    rows = [(k, n, float(model.coefficients[n]), float(model.intercept)) for k, n in enumerate(model.features)]
    spark.createDataFrame(rows, "k int, feature string, coefficient double, intercept double").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, name: str, path: str) -> Regression:
    """A saved model for the scorer of that name; raises ValueError if it was saved with other features."""
    known = algorithm(name)
    rows = spark.read.parquet(path).orderBy("k").collect()  # one row per feature
    return Regression(name, known.features, {r.feature: r.coefficient for r in rows}, rows[0].intercept if rows else 0.0)


HEURISTICS: dict[str, Algorithm] = {a.name: a for a in (LOGIC_V1, LOGIC_V2, NAME_BASED, NAME_QUALIFIED, SANCTION_SEARCH)}
ALGORITHMS: dict[str, Callable[[], Algorithm | Regression]] = {
    **{n: (lambda a=a: a) for n, a in HEURISTICS.items()},
    "regression-v1": lambda: Regression("regression-v1", REGRESSION_V1),
    "entity-regression": lambda: Regression("entity-regression", ENTITY_REGRESSION),
}


def algorithm(name: str) -> Algorithm | Regression:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name}; there are {', '.join(ALGORITHMS)}")
    return ALGORITHMS[name]()


def register(name: str, make: Callable[[], Algorithm | Regression]) -> None:
    """Add a scorer under a name."""
    ALGORITHMS[name] = make


def encode(pairs: DataFrame, features: dict[str, X.Feature], left: str = "l", right: str = "r") -> DataFrame:
    """pairs with a column ``f_NAME`` for each feature."""
    return pairs.withColumns({f"f_{n}": f(F.col(left), F.col(right)).cast("double") for n, f in features.items()})


def xref(
    entities: DataFrame,
    entries: DataFrame,
    edges: DataFrame,
    *,
    scorer: Algorithm | Regression = LOGIC_V1,
    limit: int = 5000,
    limit_factor: int = 10,
    internal_discount: float = 0.7,
    min_threshold: float = 0.01,
    auto_threshold: float | None = None,
    focus: list[str] | None = None,
    schema: str | None = None,
    heuristic: Callable[[Column], Column] | None = None,
    patience: int | None = None,
) -> DataFrame:
    """(left, right, blocking_score, score, action): ranked candidates, filtered, scored, and what to do with each.

    Pairs are taken in order of their blocking score, up to ``limit`` times ``limit_factor``; undecided pairs of known,
    compatible entities remain; pairs from one dataset are discounted; ``heuristic`` may change a score or make it null,
    which drops the pair. With ``patience``, pairs after so many scored ones without a score that counts are left out. Up to
    ``limit`` pairs are suggested, those above ``auto_threshold`` merged. Merges of one batch
    take effect together, after scoring; decisions of the batch do not change each other's scores.
    """
    from knotwork.operators import blocking as B
    from knotwork.operators import judgements as J
    from knotwork.operators.statements import pair_entities

    ranked = B.top_pairs(B.candidate_pairs(entries).withColumn("score", F.round("score", 6)), limit * limit_factor)
    clusters = J.clusters(edges)
    links = J.linker(edges, clusters)
    canon = lambda c: links.select(F.col("node").alias(c), F.col("canonical_id").alias(f"{c}_c"))
    pairs = ranked.join(canon("lid"), "lid", "left").join(canon("rid"), "rid", "left")
    pairs = pairs.select(F.coalesce("lid_c", "lid").alias("left"), F.coalesce("rid_c", "rid").alias("right"), F.col("score").alias("blocking_score"))
    pairs = pairs.groupBy("left", "right").agg(F.max("blocking_score").alias("blocking_score"))
    open_ = J.judge(pairs, edges, clusters).where(F.col("judgement") == J.UNDECIDED).select("left", "right")
    both = pair_entities(pairs.join(open_, ["left", "right"], "left_semi"), entities).where(X.compatible(F.col("l"), F.col("r")))
    if focus:
        inside = F.array(*[F.lit(d) for d in focus])
        both = both.where(F.arrays_overlap(F.col("l.datasets"), inside) | F.arrays_overlap(F.col("r.datasets"), inside))
    if schema:
        both = both.where(X.kind_of(F.col("l"), schema) | X.kind_of(F.col("r"), schema))
    scored = scorer.score(both)
    score = F.when(F.arrays_overlap(F.col("l.datasets"), F.col("r.datasets")), F.col("score") * internal_discount).otherwise(F.col("score"))
    if heuristic is not None:
        score = heuristic(score)
    scored = scored.withColumn("score", score).where(F.col("score").isNotNull())
    if patience is not None:
        # at most ``limit * limit_factor`` rows
        order = W.orderBy(F.desc("blocking_score"), "left", "right")
        placed = scored.withColumn("place", F.row_number().over(order))
        placed = placed.withColumn("last", F.max(F.when(F.col("score") >= min_threshold, F.col("place"))).over(order.rowsBetween(W.unboundedPreceding, 0)))
        over = F.max((F.col("place") - F.coalesce("last", F.lit(0)) > patience).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
        scored = placed.withColumn("over", over).where("over = 0").drop("place", "last", "over")
    scored = scored.where(F.col("score") >= min_threshold)
    action = F.lit("suggest") if auto_threshold is None else F.when(F.col("score") > auto_threshold, "merge").otherwise("suggest")
    out = scored.select("left", "right", "blocking_score", "score", action.alias("action"))
    merged = out.where("action = 'merge'")
    return merged.unionByName(out.where("action = 'suggest'").orderBy(F.desc("blocking_score"), "left", "right").limit(limit))
