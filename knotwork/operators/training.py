"""Training data for matchers, fitting and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import features as X
from knotwork.operators.logistic import Models, fit_all
from knotwork.operators.matching import Regression, encode
from knotwork.operators.ontology import matchable
from knotwork.session import Scratch

SEED, TEST_SIZE, THRESHOLDS = 42, 0.30, (0.5, 0.7, 0.9)
#: Inverse strengths of the penalty on the summed loss, shares of its absolute part and folds that are tried. Fixed values.
INVERSE_STRENGTHS, SHARES, FOLDS = tuple(10.0 ** (8 * k / 9 - 4) for k in range(10)), (0.0, 0.25, 0.5, 0.75, 1.0), 5
#: The most steps of a fit.
STEPS = 2000


def partition_of(cluster: Column, test_size: float = TEST_SIZE, seed: int = SEED) -> Column:
    """``test`` or ``train``, the same for all evidence of a cluster, from a digest of seed and cluster."""
    digest = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), cluster), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return F.when(digest / 2.0**64 < test_size, "test").otherwise("train")


def snapshot(left: Column, right: Column) -> Column:
    """A digest of what a matcher sees of a pair."""
    side = lambda e: F.concat_ws("\u0001", e["schema"], F.to_json(F.array_sort(F.map_entries(e["properties"]))))
    return F.sha2(F.concat_ws("\u0002", side(left), side(right)), 256)


def scan(judged: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Judged pairs (l, r, judgement, left_cluster, right_cluster) with ``skip``, the reason a row is left out or null,
    ``digest`` and ``partition``."""
    label = F.lower(F.trim("judgement"))
    compared = F.col("l.schema").isin(*matchable()) & F.col("r.schema").isin(*matchable())
    left, right = partition_of(F.col("left_cluster"), test_size, seed), partition_of(F.col("right_cluster"), test_size, seed)
    reason = (
        F.when(F.coalesce(~label.isin("positive", "negative"), F.lit(True)), "judgement")
        .when(~compared, "not_matchable")
        .when((F.col("l.schema") == "Address") | (F.col("r.schema") == "Address"), "address")
        .when(~X.compatible(F.col("l"), F.col("r")), "schema_pair")
        .when((label != "positive") & (F.col("left_cluster") == F.col("right_cluster")), "contradictory_cluster")
        .when(left != right, "cross_partition")
    )
    return judged.withColumns({"label": label, "skip": reason, "partition": left, "digest": snapshot(F.col("l"), F.col("r"))})


def scan_report(scanned: DataFrame) -> DataFrame:
    """(skip, label, n) with ``accepted`` for rows that stay."""
    return scanned.groupBy(F.coalesce("skip", F.lit("accepted")).alias("skip"), "label").agg(F.count("*").alias("n"))


def dataset(scanned: DataFrame) -> DataFrame:
    """(digest, l, r, y, partition): one row per snapshot; snapshots with both labels or both partitions are left out."""
    kept = scanned.where("skip IS NULL")
    groups = kept.groupBy("digest").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.min("partition").alias("partition"), F.max("partition").alias("second"), F.first(F.struct("l", "r")).alias("p"))
    clean = groups.where("label = other AND partition = second")
    return clean.select("digest", "p.l", "p.r", F.when(F.col("label") == "positive", 1).otherwise(0).alias("y"), "partition")


def vectors(rows: DataFrame, features: dict[str, X.Feature]) -> DataFrame:
    encoded = encode(rows, features)
    return VectorAssembler(inputCols=[f"f_{n}" for n in features], outputCol="raw").transform(encoded).select("digest", "y", "partition", F.col("l.schema").alias("schema"), "raw")


def fit(data: DataFrame, name: str, features: dict[str, X.Feature], *, centre: bool = True, strength: float = 0.001, share: float = 0.0) -> Regression:
    """A logistic scorer of standardised features, fitted on the training partition."""
    train = data.where("partition = 'train'").cache()
    try:
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=centre, withStd=True).fit(train)
        model = LogisticRegression(labelCol="y", regParam=strength, elasticNetParam=share, maxIter=200, standardization=False).fit(scaler.transform(train))
    finally:
        train.unpersist()
    deviation, mean = scaler.std.toArray(), scaler.mean.toArray()
    weights = [float(c / s) if s > 0 else 0.0 for c, s in zip(model.coefficients.toArray(), deviation, strict=True)]
    intercept = float(model.intercept) - (sum(w * float(m) for w, m in zip(weights, mean, strict=True)) if centre else 0.0)
    return Regression(name, features, dict(zip(features, weights, strict=True)), intercept)


def choose(data: DataFrame, name: str, features: dict[str, X.Feature], folds: int = FOLDS) -> tuple[Regression, float, float]:
    """The scorer whose penalty has the least mean log loss over folds of the training partition, fitted on all of it, with
    the inverse strength and share chosen. Features are scaled once, by the whole training partition; equal rows are one, with
    their number."""
    fold = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(folds))
    scratch = Scratch(data.sparkSession, "folds")
    train = data.where("partition = 'train'").cache()
    try:
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True).fit(train)
        equal = train.groupBy(vector_to_array("raw").alias("x"), F.col("y").cast("double").alias("y"), fold.alias("fold")).agg(F.count("*").alias("n"))
        rows = scratch.keep(equal.repartition(data.sparkSession.sparkContext.defaultParallelism))
    finally:
        train.unpersist()
    deviation = scaler.std.toArray()
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0)
    sizes = {r.fold: r.n for r in rows.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    tries = [(inverse, share) for inverse in INVERSE_STRENGTHS for share in SHARES]

    def models_of(tasks: list[tuple[int, float, float]]) -> Models:
        fold, inverse, share = map(np.array, zip(*tasks, strict=True))
        n = np.array([total - sizes.get(k, 0) for k in fold])
        strength = 1 / (inverse * np.maximum(n, 1))
        return Models(fold, n, strength * share, strength * (1 - share))

    tasks = [(k, *t) for k in sizes for t in tries]
    weights, held = fit_all(rows, scale, models_of(tasks), np.zeros((len(tasks), len(features) + 1)), STEPS)
    mean = (held.reshape(len(sizes), -1) / np.array([*sizes.values()])[:, None]).mean(0).round(12)  # sums differ in their last digits from run to run
    best = int(mean.argmin())
    inverse, share = tries[best]
    start = weights.reshape(len(sizes), len(tries), -1)[:, best].mean(0, keepdims=True)
    chosen = fit_all(rows, scale, models_of([(-1, inverse, share)]), start, STEPS)[0][0]
    scratch.drop(rows)
    coefficients = [float(w) for w in chosen[:-1] * scale]
    return Regression(name, features, dict(zip(features, coefficients, strict=True)), float(chosen[-1])), inverse, share


def apply(model: Regression, data: DataFrame) -> DataFrame:
    """data (raw vectors) with ``score``."""
    x = vector_to_array("raw")
    z = F.lit(model.intercept)
    for k, n in enumerate(model.features):
        z = z + F.get(x, F.lit(k)) * model.coefficients[n]
    return data.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def log_loss(y: Column, score: Column) -> Column:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), score))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def confusion(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, by: str | None = None) -> DataFrame:
    """(group, threshold, tp, fp, fn, tn, precision, recall, f1) of scores (y, score)."""
    group = F.col(by) if by else F.lit("all")
    rows = scored.select(group.alias("group"), "y", "score", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hit, real = F.col("score") >= F.col("threshold"), F.col("y") == 1
    out = rows.groupBy("group", "threshold").agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def losses(scored: DataFrame, by: str | None = None) -> DataFrame:
    """(group, n, log_loss, brier, mean_error) of scores (y, score)."""
    group = F.col(by) if by else F.lit("all")
    return scored.groupBy(group.alias("group")).agg(
        F.count("*").alias("n"), F.avg(log_loss(F.col("y"), F.col("score"))).alias("log_loss"), F.avg(F.pow(F.col("y") - F.col("score"), 2)).alias("brier"), F.avg(F.abs(F.col("y") - F.col("score"))).alias("mean_error")
    )


def areas(scored: DataFrame) -> dict[str, float]:
    """Areas under the curves of recall and of precision."""
    area = lambda metric: float(BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", metricName=metric).evaluate(scored))
    return {"roc_auc": area("areaUnderROC"), "average_precision": area("areaUnderPR")}


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share): how often pairs of a score are matches, and whether that grows from bin to bin."""
    from pyspark.sql import Window as W

    rows = scored.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int"))
    table = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("share"))
    before = F.lag("share").over(W.orderBy("bin"))  # at most ``bins`` rows
    return table.withColumn("grows", F.coalesce(F.col("share") >= before, F.lit(True)))
