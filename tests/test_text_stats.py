"""Text rules, readers, statistics and learned models on edge rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.functions import text as tx
from lattiq.operators import stats
from lattiq.operators.learn import apply_slot_model, chain_decode, slot_features
from lattiq.operators.policy import allocate
from lattiq.plans.networks import positional_votes

from .conftest import SF


def test_normaliser(spark):
    rows = [("C'était l'ÉTÉ, 2_x!",), ("",), ("  ?! ",), ("a b\tc",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.words("t")).collect()]
    assert got == [["cétait", "lété", "2_x"], [], [], ["a", "b", "c"]]


def test_word_distance(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["x", "y"]), (["é"], ["e"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(tx.word_distance("a", "b")).collect()] == [1, 2, 1, 0]


def test_wer_of_empty_reference(spark):
    df = spark.createDataFrame([(0, 0, 0), (2, 0, 2), (3, 2, 5)], "e int, r int, h int")
    assert [r[0] for r in df.select(tx.wer("e", "r", "h")).collect()] == [0.0, 1.0, 1.5]


def test_collapse_runs(spark):
    df = spark.createDataFrame([([0, 5, 5, 0, 5, 7], [0.1, 0.2, 0.4, 0.5, 0.6, 0.7])], "p array<int>, c array<double>")
    got = df.select(tx.collapse_runs("p", "c", 0).alias("r")).first()["r"]
    assert [(x["token"], round(x["conf"], 3)) for x in got] == [(5, 0.3), (5, 0.6), (7, 0.7)]


def test_bootstrap_properties(spark):
    def delta(a, b, w, clusters):
        rows = [(0, i, *x) for i, x in enumerate(zip(a, b, w, clusters))]
        return spark.createDataFrame(rows, "cell int, id long, a long, b long, ref_len long, cluster int").transform(stats.bootstrap, ["cell"], "a", "b", rounds=200).collect()

    a = [3, 1, 4, 1, 5, 9]
    (same,) = delta(a, a, [10] * 6, range(6))
    assert same["delta"] == same["ci_low"] == same["ci_high"] == 0 and same["p_wilcoxon"] == 1.0
    (d,) = delta(a, [x - 1 for x in a], [10] * 6, [1, 1, 2, 3, 4, 5])
    assert d["ci_low"] <= d["delta"] <= d["ci_high"] and d["n_better"] == 6 and d["cl_ci_low"] is not None
    assert delta([1], [1], [0], [1]) == []
    (few,) = delta(a, [x - 1 for x in a], [10] * 6, [1, 1, 1, 2, 2, 2])
    assert few["cl_ci_low"] is None


def test_signed_rank_and_weights(spark):
    d = [1, -2, 2, 3, 3, -1, 5, 0, 4, 1, 2]
    p = spark.createDataFrame([(0, x) for x in d], "c int, d int").transform(stats.signed_rank, ["c"], "d").first()["p_wilcoxon"]
    size = sorted(abs(x) for x in d if x)
    rank = {v: sum(i + 1 for i, x in enumerate(size) if x == v) / size.count(v) for v in size}
    n, plus = len(size), sum(rank[x] for x in d if x > 0)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(size.count(v) ** 3 - size.count(v) for v in set(size)) / 48
    assert p == pytest.approx(math.erfc(abs(plus - n * (n + 1) / 4) / math.sqrt(2 * var)), rel=1e-5)
    u = spark.range(20000).select(stats.draw([F.col("id"), F.col("id") % 7, F.col("id") % 11], 3).alias("u")).toPandas()["u"]
    counts = np.bincount(np.searchsorted(stats.poisson_steps(), u, "right")) / len(u)
    assert counts[:4] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.015)


def test_isotonic_is_monotone():
    out = stats.isotonic(pd.DataFrame({"x": [0.1, 0.2, 0.3, 0.4], "y": [0.5, 0.1, 0.9, 0.8], "n": [1.0, 1.0, 1.0, 1.0]}))
    assert out["fit"].tolist() == [0.3, 0.3, 0.8500000000000001, 0.8500000000000001] or np.all(np.diff(out["fit"]) >= 0)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([("g", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert stats.spearman(df, ["g"], "x", "y").first()["rho"] is None
    assert stats.adjusted_rand(df, ["g"], "x", "y").first()["ari"] is None


def test_chain_without_transitions_is_the_slot_model(spark):
    f = slot_features(positional_votes(spark, SF)).filter("id < 40").persist()
    w = {"share": 1.0, "mean_conf": 0.5}
    a = {(r["id"], r["slot"]): r["word"] for r in apply_slot_model(f, w).collect()}
    b = {(r["id"], r["slot"]): r["word"] for r in chain_decode(f, w, [[0.0, 0.0], [0.0, 0.0]]).collect()}
    assert a == b
    f.unpersist()


def test_allocation_reaches_the_budget(spark):
    rows = spark.range(200).select(F.col("id"), (1.0 + F.col("id") % 7).alias("score"))
    mean = allocate(rows, 4.0, 1, 8).agg(F.avg("k")).first()[0]
    assert 4.0 <= mean < 4.6
