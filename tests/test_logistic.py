from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from knotwork.functions import features as X
from knotwork.operators import logistic as L
from knotwork.operators import training as R

NAMES = ("name_match", "name_levenshtein", "dob_matches", "family_name_match")


def _rows(n: int, seed: int = 5) -> list[tuple]:
    """(digest, y, partition, raw): a telling feature, one much like it, one of three values, one constant."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        a = rng.gauss(1, 2)
        x = [a, a + rng.gauss(0, 0.5), float(rng.randrange(-1, 2)), 1.0]
        rows.append((f"{rng.randrange(16**8):08x}", int(rng.random() < 1 / (1 + math.exp(1 - x[0] - x[2]))), "train", Vectors.dense(x)))
    return rows


def test_whole_search_takes_few_jobs(spark):
    """All 250 fits of the search at once: jobs don't grow with the penalties and folds that are tried."""
    data = spark.createDataFrame(_rows(200), ["digest", "y", "partition", "raw"]).coalesce(2)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    model, inverse, share = R.choose(data, "m", {n: getattr(X, n) for n in NAMES})
    assert jobs() - before < 200 and inverse in R.INVERSE_STRENGTHS and share in R.SHARES
    assert 0.5 < model.coefficients["name_match"] + model.coefficients["name_levenshtein"] < 2 and model.coefficients["family_name_match"] == 0


def test_fits_are_those_of_the_library(spark):
    """Each fold, strength and share gives the weights of a fit of its own; equal rows count as often as they are."""
    rows = [(r[3].toArray().tolist(), float(r[1]), k % 2) for k, r in enumerate(_rows(120))]
    counted = spark.createDataFrame([(x, y, f, 1 + f) for x, y, f in rows], "x array<double>, y double, fold long, n long").repartition(3)
    tries = [(fold, strength, share) for fold in (-1, 0, 1) for strength in (0.3, 0.01, 1e-4) for share in (0.0, 0.5, 1.0)]
    fold, strength, share = map(np.array, zip(*tries, strict=True))
    n = np.array([sum(1 + f for _, _, f in rows if f != k) for k in fold])
    weights, held = L.fit_all(counted, np.ones(4), L.Models(fold, n, strength * share, strength * (1 - share)), np.zeros((len(tries), 5)), 100)
    for (k, by, part), w, out in list(zip(tries, weights, held, strict=True))[::2]:
        seen = spark.createDataFrame([(y, Vectors.dense(x)) for x, y, f in rows if f != k for _ in range(1 + f)], ["label", "features"]).coalesce(1)
        fit = LogisticRegression(regParam=float(by), elasticNetParam=float(part), maxIter=2000, tol=1e-12, standardization=False).fit(seen)
        assert [*w[:3], w[4]] == pytest.approx([*fit.coefficients.toArray()[:3], fit.intercept], abs=2e-3) and w[3] == pytest.approx(0, abs=1e-6)
        z = [(y, w[:4] @ x + w[4], 1 + f) for x, y, f in rows if f == k]
        assert out == pytest.approx(sum(c * (math.log1p(math.exp(-abs(v))) + max(v, 0) - y * v) for y, v, c in z))


def test_separable_rows_one_label_and_missing_folds_end(spark):
    features = {n: getattr(X, n) for n in NAMES[:2]}
    apart = [(f"{k:08x}", int(k % 2), "train", Vectors.dense([float(k % 2), 2.0 * (k % 2)])) for k in range(40)]
    model, _, _ = R.choose(spark.createDataFrame(apart, ["digest", "y", "partition", "raw"]), "m", features)
    z = [model.intercept + sum(w * x for w, x in zip(model.coefficients.values(), r[3], strict=True)) for r in apart]
    assert all((v > 3) == (r[1] == 1) and abs(v) > 3 for v, r in zip(z, apart, strict=True))
    one = [("00000000" if k < 9 else "00000001", 1, "train", Vectors.dense([float(k), 1.0])) for k in range(20)]
    model, _, _ = R.choose(spark.createDataFrame(one, ["digest", "y", "partition", "raw"]), "m", features)
    assert math.isfinite(model.intercept) and model.intercept > 10
