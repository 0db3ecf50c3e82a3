"""Alignment, networks and oracles against brute force on small inputs."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.operators import network as net
from lattiq.operators.lattice import word_classes
from lattiq.operators.select import central_index

WORDS = st.lists(st.sampled_from("abc"), max_size=5)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
    return row[-1]


@given(WORDS, WORDS)
def test_alignment_is_optimal_and_complete(a, b):
    steps = net.alignment(a, b)
    assert [i for i, _ in steps if i is not None] == list(range(len(a)))
    assert [j for _, j in steps if j is not None] == list(range(len(b)))
    assert sum(i is None or j is None or a[i] != b[j] for i, j in steps) == edits(a, b)


@given(st.lists(st.lists(st.sampled_from(["", "a", "b"]), min_size=1, max_size=3, unique=True), max_size=4), WORDS)
def test_path_edits_is_the_best_path(slots, ref):
    best = min((edits([w for w in p if w], ref) for p in itertools.product(*slots)), default=len(ref))
    assert net.path_edits(slots, ref) == best


def along(words, ref):
    """Edits of one path, slot by slot; reference words are skipped after a slot, not before the first."""
    cur = {0: 0}
    for w in words:
        new = {}
        for j, c in cur.items():
            for k, v in [(j, c)] if not w else [(j, c + 1)] + ([(j + 1, c + (w != ref[j]))] if j < len(ref) else []):
                new[k] = min(new.get(k, 99), v)
        for j in range(len(ref)):
            if j in new:
                new[j + 1] = min(new.get(j + 1, 99), new[j] + 1)
        cur = new
    return cur[len(ref)]


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b"]), min_size=2, max_size=2), min_size=1, max_size=4), WORDS)
def test_switch_edits(rows, ref):
    want = []
    for s in range(3):
        paths = [c for c in itertools.product(range(2), repeat=len(rows)) if sum(x != y for x, y in zip(c, c[1:])) <= s]
        want.append(min(along([rows[t][c] for t, c in enumerate(p)], ref) for p in paths))
    assert net.switch_edits(rows, ref, 2) == want


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=4))
def test_word_classes_keep_every_candidate_a_path(words):
    classes = word_classes(words)
    for c, ws in enumerate(words):
        assert [i for cls in classes for k, i in cls if k == c] == list(range(len(ws)))


ROWS = [
    ("s", 1, 0, ["a", "b", "c"], ["a", "b", "c"], [0.9, 0.9, 0.9], 0.9),
    ("s", 1, 1, ["a", "b", "c"], ["a", "x", "c"], [0.9, 0.2, 0.9], 0.6),
    ("s", 1, 2, ["a", "b", "c"], ["a", "y", "z", "b", "c"], [0.9, 0.2, 0.2, 0.9, 0.9], 0.6),
    ("s", 2, 0, ["a"], ["a"], [0.5], 0.5),
    ("s", 3, 0, [], ["q"], [0.5], 0.5),
    ("s", 3, 1, [], [], [], 0.5),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "set_name string, id long, cand_i int, ref array<string>, words array<string>, word_conf array<double>, avg_conf double")


def test_network_votes(small):
    back = central_index(small)
    v = {(r["id"], r["slot"], r["word"]): (r["votes"], r["conf_sum"]) for r in net.votes(net.align_pool(small, back)).collect()}
    assert {r["id"]: r["backbone"] for r in back.collect()} == {1: 0, 2: 0, 3: 0}
    # Two words inserted at one gap by one candidate vote twice there; epsilon gets the other two.
    assert v[(1, 2, "y")] == (1.0, 0.2) and v[(1, 2, "z")] == (1.0, 0.2) and v[(1, 2, "")][0] == 2.0
    assert v[(1, 3, "b")] == (2.0, 1.8) and v[(1, 3, "x")] == (1.0, 0.2) and v[(1, 3, "")] == (0.0, 0.0)
    assert v[(3, 1, "")] == (1.0, 1.0)


def test_single_candidate_is_its_own_hypothesis(small):
    one = small.filter("id = 2")
    a = net.align_pool(one, central_index(one))
    assert net.hypothesis(net.rover_picks(net.votes(a), 0.5, 0.3)).first()["words"] == ["a"]


def test_prepared_modes(spark):
    rows = [("s", 1, 0, ["a"], ["a"], [0.4], 0.7), ("s", 1, 1, ["a"], ["a", "b"], [0.4], 1.7)]
    p = spark.createDataFrame(rows, "set_name string, id long, cand_i int, ref array<string>, words array<string>, word_conf array<double>, avg_conf double")
    assert [r["word_conf"] for r in net.prepared(p).orderBy("cand_i").collect()] == [None, None]
    assert [r["word_conf"] for r in net.prepared(p, strict=False).orderBy("cand_i").collect()] == [[0.4], [1.0, 1.0]]


def test_widen_by_nothing_changes_nothing(small):
    v = net.votes(net.align_pool(small, central_index(small)))
    assert net.widen(v, 0, 0.5) is v


def test_every_candidate_is_a_path(spark):
    from lattiq.plans.catalog import QUERIES

    from .conftest import SF

    assert QUERIES["path_membership"](spark, SF).filter("not is_path").isEmpty()
    spark.catalog.clearCache()
