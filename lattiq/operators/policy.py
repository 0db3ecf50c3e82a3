"""Spending a budget of candidates over utterances, and a learned width."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = {
    "const": lambda: F.lit(1.0),
    "duration": lambda: F.greatest("duration_s", F.lit(0.1)),
    "words": lambda: F.greatest("n_words", F.lit(1)).cast("double"),
    "unconf": lambda: F.greatest(1.0 - F.col("avg_conf"), F.lit(1e-3)),
    "words_unconf": lambda: F.greatest("n_words", F.lit(1)) * F.greatest(1.0 - F.col("avg_conf"), F.lit(1e-3)),
}


def at_scale(scale: Column, score: str, k_min: int, k_max: int) -> Column:
    """score * scale rounded half to even, clamped."""
    return F.least(F.greatest(F.bround(scale * F.col(score)), F.lit(float(k_min))), F.lit(float(k_max))).cast("int")


def allocate(rows: DataFrame, budget: float, k_min: int, k_max: int, steps: int = 5, width: int = 64) -> DataFrame:
    """Adds k: scores scaled so that the mean allocation just reaches the budget.

    The scale is found by narrowing a bracket, ``width`` trial scales to one aggregate, so the
    rows are read ``steps`` times and only the trial means reach the driver.
    """
    lo, hi = 1e-9, 1e9
    for _ in range(steps):
        trial = np.geomspace(lo, hi, width)
        means = rows.agg(*[F.avg(at_scale(F.lit(float(a)), "score", k_min, k_max)).alias(f"m{i}") for i, a in enumerate(trial)]).first()
        enough = [i for i in range(width) if (means[i] or 0) >= budget]
        i = enough[0] if enough else width - 1
        lo, hi = (trial[max(i - 1, 0)], trial[i])
    return rows.withColumn("k", at_scale(F.lit(float(hi)), "score", k_min, k_max))


def normal_equations(rows: DataFrame, features: list[str], target: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and ridge weights of target on standardised features: one pass for the
    moments, one for the products; a few hundred numbers reach the driver."""
    m = rows.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    mu, sd = np.array(m[: len(features)], float), np.array(m[len(features) :], float) + 1e-9
    z = [(F.col(f) - float(a)) / float(b) for f, a, b in zip(features, mu, sd)] + [F.lit(1.0)]
    n = len(z)
    sums = rows.agg(*[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(x * target).alias(f"y{i}") for i, x in enumerate(z)]).first()
    a = np.zeros((n, n))
    it = iter(sums)
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = next(it)
    return mu, sd, np.linalg.solve(a + np.diag([1.0] * (n - 1) + [0.0]), np.array(list(it)))


def predict_width(rows: DataFrame, features: list[str], fitted, labels: DataFrame, ladder: list[int], by: list[str]) -> DataFrame:
    """Adds k: ranks of the predicted scores mapped to quantiles of the labels, then to the nearest rung."""
    mu, sd, w = fitted
    score = sum(((F.col(f) - float(m)) / float(s)) * float(c) for f, m, s, c in zip(features, mu, sd, w)) + float(w[-1])
    points = 200
    q = labels.agg(F.percentile("k_needed", F.array(*[F.lit(i / points) for i in range(points + 1)])).alias("q")).first()["q"]
    ranked = rows.withColumn("score", score).withColumn("u", F.percent_rank().over(Window.partitionBy(*by).orderBy("score", "id")))
    want = F.element_at(F.array(*[F.lit(float(x)) for x in q]), F.floor(F.col("u") * points).cast("int") + 1)
    rungs = F.array(*[F.struct(F.abs(F.col("want") - k).alias("d"), F.lit(k).alias("k")) for k in sorted(ladder)])
    return ranked.withColumn("want", want).withColumn("k", F.array_min(rungs)["k"]).drop("want", "u")
