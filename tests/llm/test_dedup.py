"""Removal and near-duplicate operators against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.llm import near_dedup, substring_dedup, suffix_dedup


def brute_words(rows, window=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, rows):
    got = sorted(tuple(r) for r in substring_dedup.report(docs).collect())
    assert got == brute_words(rows)
    assert any(0 < n < m for _, m, n, _ in got)


def test_automaton_finds_every_window():
    a = substring_dedup.Automaton()
    a.add([b"a", b"b"], 1)
    a.add([b"b", b"a"], 2)
    a.compile()
    assert a.occurrences([b"a", b"b", b"a", b"q", b"a", b"b"]) == [(0, 1), (1, 2), (4, 1)]


def brute_bytes(rows, window=100):
    """Rows of one doc_id are equal in order: what starts in one is not earlier for another."""
    first, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for j in range(len(b) - window + 1):
            k = b[j : j + window]
            first[k] = min(first.get(k, (i, j)), (i, j))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            if first[b[j : j + window]] < (i, j):
                gone[j : j + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, rows):
    assert sorted(tuple(r) for r in suffix_dedup.report(docs).collect()) == brute_bytes(rows)


@pytest.mark.parametrize("hot", [1, 2, 5])
def test_suffix_dedup_of_hot_anchors(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert sorted(tuple(r) for r in suffix_dedup.report(docs).collect()) == brute_bytes(rows)


@pytest.mark.parametrize("hot", [1, 1024])
def test_suffix_dedup_of_a_passage_in_many_surroundings(spark, monkeypatch, hot):
    """A common passage at many offsets, and rows of one doc_id that share it at one place or at two."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(160)
    rows = [(i, noise(r.randint(0, 140)) + passage[r.randint(0, 40) :] + noise(r.randint(0, 140))) for i in range(40)]
    rows += [(50, noise(30) + passage), (50, noise(30) + passage), (50, noise(45) + passage + noise(9)), (-3, passage + noise(7)), (-3, passage), (-3, noise(2) + passage[5:])]
    rows += [(60, passage + noise(150) + passage[:120])]
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == brute_bytes(rows)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(min_size=1, max_size=14).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6))
def test_run_length_index(texts):
    text, off = suffix_dedup.RunLengthIndex(texts, depth=7).repeated()
    got, want, seen = set(zip(text.tolist(), off.tolist())), set(), set()
    for i, t in enumerate(texts):
        for j in range(len(t) - 6):
            if t[j : j + 7] in seen:
                want.add((i, j))
            seen.add(t[j : j + 7])
    assert got == want


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows, percent=85):
    """doc_id -> component; rows of one doc_id are one node."""
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    label = {i: i for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if label[a] != label[b] and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return label


def as_rows(rows, label):
    return sorted((i, len(x := shingles(t)), label[i] if x else i, label[i] == i or not x) for i, t, *_ in rows)


def test_near_dedup(docs, rows):
    got = sorted(tuple(r) for r in near_dedup.classes(docs).collect())
    assert got == as_rows(rows, brute_classes(rows))
    assert sum(not r[3] for r in got) >= 10


def test_near_dedup_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    assert sorted(tuple(r) for r in near_dedup.classes(docs).collect()) == as_rows(rows, brute_classes(rows))


def test_one_id_of_two_texts_joins_their_classes(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "pq")
    docs = spark.createDataFrame([(1, a), (2, b), (7, a), (7, b), (9, a), (9, "else")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.classes(docs).collect()} == {(1, 1), (2, 1), (7, 1), (9, 1)}


@pytest.mark.parametrize("report", [substring_dedup.report, suffix_dedup.report, near_dedup.classes])
def test_empty_table(report, empty):
    assert report(empty).collect() == []
