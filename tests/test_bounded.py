"""What is dealt by utterance stays where it is: no step moves slots or words between tasks."""

import os

import numpy as np
import pandas as pd
import pytest

from lattiq.operators import stats
from lattiq.plans import fixtures
from lattiq.plans.catalog import QUERIES

from .conftest import SF


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("Exchange ")[1].split(",")[0] for x in plan.splitlines() if " Exchange " in x or x.startswith("Exchange ")]


# The utterances are dealt once; beyond that only sums by set, point or half move.
@pytest.mark.parametrize("name,most", [("mixed_votes_pick", 2), ("grid_sweep", 2), ("tuned_argmin", 3), ("cluster_split_tuning", 3), ("loo_set_tuning", 4)])
def test_slots_stay_in_their_task(name, most, spark):
    assert len(exchanges(QUERIES[name](spark, SF))) <= most


@pytest.mark.parametrize("name", ["spearman_conf_wer", "collision_test"])
def test_ranks_are_of_counts(name, spark):
    """No window is over the rows of a set: below the last one values have been counted."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.rsplit("Window ", 1)[1]


def test_ordinal_ranks_are_dealt_by_range(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(2, size=500), "x": rng.integers(5, size=500), "y": rng.integers(4, size=500), "t": rng.permutation(500)})
    got = stats.spearman_ordinal(spark.createDataFrame(pdf), ["g"], "x", "y", "t", parts=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all("_s#" in x for x in plan.splitlines() if "row_number" in x and " Window " in x)
    for r in got.collect():
        one = pdf[pdf.g == r["g"]]
        rank = {v: one.sort_values([v, "t"]).assign(r=range(len(one)))["r"] for v in "xy"}
        assert r["n"] == len(one) and r["rho"] == pytest.approx(rank["x"].corr(rank["y"]))


def test_averaged_ranks(spark):
    pdf = pd.DataFrame({"g": [0] * 9, "x": [1, 1, 2, 3, 3, 3, 4, 5, 5], "y": [2, 1, 2, 2, 4, 3, 3, 3, 9]})
    assert stats.spearman(spark.createDataFrame(pdf), ["g"], "x", "y").first()["rho"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()))


def test_tasks_of_facts_follow_the_files(spark, monkeypatch):
    size = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    monkeypatch.setattr(fixtures, "FACT_BYTES", size // 20)
    f = fixtures.facts(spark, SF)
    assert len(exchanges(f)) == 2
    assert f.rdd.getNumPartitions() >= 20


@pytest.mark.parametrize("name", ["cells", "contrast_counts"])
def test_clusters_are_counted_without_distinct_sets(name, spark):
    assert "distinct" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,most", [("oracle_gap", 2), ("scorer_table", 2), ("mbr_scores", 1), ("knn_rank", 3)])
def test_candidates_are_compared_where_they_lie(name, most, spark):
    assert len(exchanges(QUERIES[name](spark, SF))) <= most
