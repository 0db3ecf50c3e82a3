"""Work on one utterance at a time gives what brute force and the long tables give."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattiq.operators import network as net
from lattiq.operators import utterance as utt

from .test_bounded import exchanges
from .test_network import ROWS, WORDS, edits

LISTS = st.lists(WORDS, min_size=1, max_size=5)


def walked(a, b):
    """The alignment's rule on the whole table of distances: ends, then deletions, then insertions."""
    lo = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[lo:], b[lo:]
    hi = next((k for k, (v, w) in enumerate(zip(x[::-1], y[::-1])) if v != w), min(len(x), len(y)))
    x, y = x[: len(x) - hi], y[: len(y) - hi]
    t = [[edits(x[:i], y[:j]) for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    i, j, out = len(x), len(y), []
    while i or j:
        down = i and t[i][j] == t[i - 1][j] + 1
        right = not down and j and t[i][j] == t[i][j - 1] + 1
        i, j = i - (not right), j - (not down)
        out.append((None if right else lo + i, None if down else lo + j))
    return [(k, k) for k in range(lo)] + out[::-1] + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


@given(WORDS, WORDS)
def test_alignment_breaks_ties_as_the_table_does(a, b):
    assert net.alignment(a, b) == walked(a, b)


@given(WORDS, WORDS)
def test_edits(a, b):
    assert utt.edits(a, b) == edits(a, b)


@settings(deadline=None)
@given(st.lists(LISTS, min_size=1, max_size=4))
def test_distances_of_many_utterances(pools):
    for r in utt.measured([{"words": w} for w in pools]):
        assert r["d"] == [[edits(a, b) for b in r["words"]] for a in r["words"]]


@given(st.lists(st.lists(st.sampled_from(["", "a", "b"]), min_size=1, max_size=3, unique=True), max_size=4), WORDS)
def test_path_edits(slots, ref):
    assert utt.path_edits(slots, ref) == net.path_edits(slots, ref)


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b"]), min_size=3, max_size=3), min_size=1, max_size=4), WORDS)
def test_switch_edits(rows, ref):
    assert utt.switch_edits([list(x) for x in zip(*rows)], ref, 3) == net.switch_edits(rows, ref, 3)


def rand(x, y):
    """Adjusted Rand index by counting pairs."""
    pairs = list(itertools.combinations(range(len(x)), 2))
    a, b = [x[i] == x[j] for i, j in pairs], [y[i] == y[j] for i, j in pairs]
    expected, room = sum(a) * sum(b) / len(pairs), (sum(a) + sum(b)) / 2
    return (sum(p and q for p, q in zip(a, b)) - expected) / (room - expected) if abs(room - expected) > 1e-12 else None


def test_branch_structure_has_every_pair():
    """Thirty contested slots have 435 pairs, of which twenty once counted."""
    rng = np.random.default_rng(1)
    words = [[f"{s}{rng.integers(3)}" for s in range(30)] for _ in range(6)]
    steps = [[(2 * s + 1, s) for s in range(30)]] * 6
    slots = [x for x in zip(*words) if len(set(x)) > 1]
    want = [v for v in (rand(x, y) for x, y in itertools.combinations(slots, 2)) if v is not None]
    n, total = utt.branch(steps, words)
    assert n == len(want) > 20 and total == pytest.approx(sum(want))


def test_hashes_are_those_of_spark(spark):
    rows = spark.createDataFrame([("user", 5, 3, 1 << 40), ("", -7, 0, -1)], "s string, i long, k int, o long")
    for r in rows.select("k", "o", F.xxhash64("s", "i").alias("h"), F.xxhash64("s", "i", "k").alias("a"), F.xxhash64("s", "i", "k", "o").alias("b")).collect():
        h = utt.hash_int(r["k"], r["h"] & utt.MASK)
        assert utt.signed(h) == r["a"] and utt.signed(utt.hash_long(r["o"], h)) == r["b"]


def test_votes_are_those_of_the_long_tables(spark):
    small = spark.createDataFrame(ROWS, "set_name string, id long, cand_i int, ref array<string>, words array<string>, word_conf array<double>, avg_conf double")
    a = net.align_pool(small, net_backbone(small))
    want = {(r["id"], r["slot"], r["word"]): (r["votes"], r["conf_sum"], r["ord"], r["total"]) for r in net.votes(a).collect()}
    got = {}
    for r in utt.measured([x.asDict(True) for x in utt.gathered(small).collect()]):
        cells, total = utt.votes(r, utt.aligned(r)[1])
        got |= {(r["id"], slot, word): (*cell, total) for slot, c in cells.items() for word, cell in c.items()}
    assert got == want


def net_backbone(pool):
    from lattiq.operators.select import central_index

    return central_index(pool)


@pytest.mark.parametrize("name,most", [("rover_cg", 2), ("ladder_cells", 2), ("parameter_grid", 2), ("best_stitch", 1), ("switch_oracle", 2), ("micro_slot_matrix", 1), ("path_membership", 1), ("branch_structure", 2), ("control_permuted", 1), ("oracle_path", 1), ("sid_counts", 2), ("widen_aligned_identity", 1), ("ar_decompose", 2), ("mangu_network", 2), ("reference_by_slot", 1), ("votes_align", 1), ("per_utt_k", 1), ("stitch_versus_vote", 2)])
def test_utterances_are_dealt_once(name, most, spark):
    from lattiq.plans.catalog import QUERIES

    from .conftest import SF

    assert len(exchanges(QUERIES[name](spark, SF))) <= most


def test_neighbours_are_those_of_the_whole_table():
    """Also among many equal points, and without a table of all queries and all points."""
    from lattiq.operators.learn import leaves, neighbours

    rng = np.random.default_rng(2)
    z = np.concatenate([np.round(rng.normal(size=(700, 3)), 1), np.zeros((300, 3)), rng.normal(size=(500, 3))])
    q = np.concatenate([np.round(rng.normal(size=(60, 3)), 1), np.zeros((2, 3)), rng.normal(size=(40, 3)) * 3])
    d = np.round(((q[:, None] - z[None]) ** 2).sum(2), 9)
    for k in (1, 15, 2000):
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (neighbours(q, z, *leaves(z, 32), k) == want).all()
    assert neighbours(q, z[:0], *leaves(z[:0]), 3).shape == (len(q), 0)


def test_distributions_are_made_once_a_row(spark):
    from lattiq.plans.catalog import QUERIES

    from .conftest import SF

    assert QUERIES["word_distributions"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("arrays_zip(") == 1
