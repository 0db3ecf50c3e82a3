"""Scoring, classification, fingerprints, decontamination and tokens."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.llm import decontaminate, fingerprint, langid, ngram_trie, quality, sentencepiece_fst, toxicity


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.lists(st.integers(0, 5000), min_size=1, max_size=20))
def test_elias_fano(values, queries):
    v = np.array(sorted(values), np.uint64)
    meta, parts = ngram_trie.EliasFano.pack(v, 5001)
    ef = ngram_trie.EliasFano(meta["n"], meta["low"], *parts)
    assert ef.get(np.arange(len(v))).tolist() == v.tolist()
    q = np.array(queries, np.uint64)
    assert ef.successor(q).tolist() == np.searchsorted(v, q).tolist()


def brute_scores(rows, held):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]) for i, t, *_ in rows]
    uni, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in texts:
        if not held(i):
            uni.update(w)
            two.update(zip([None, *w], w))
    for i, w in texts:
        if not held(i):
            three.update(zip([None, *w], w, w[1:]))
    seen = [sum(n == k for n in c.values()) for c in (two, three) for k in (1, 2)]
    d2, d3 = (a / (a + 2 * b) if a and b else 0.6 for a, b in (seen[:2], seen[2:]))
    total, types = sum(uni.values()), len(uni)
    mass2, mass3 = collections.Counter(), collections.Counter()
    for (a, _), n in two.items():
        mass2[a] += (n - d2) / uni[a]
    for (a, b, _), n in three.items():
        mass3[(a, b)] += (n - d3) / two[(a, b)]
    out = []
    for i, w in texts:
        base = score = 0.0
        for j, x in enumerate(w):
            p = (uni[x] + 1) / (total + types + 1)
            base += math.log10(p)
            c = w[j - 1] if j else None
            p = ((two[(c, x)] - d2) / uni[c] if (c, x) in two else 0) + (1 - mass2[c]) * p
            c2 = (w[j - 2] if j >= 2 else None, w[j - 1]) if j else None
            if c2 in two:
                p = ((three[(*c2, x)] - d3) / two[c2] if (*c2, x) in three else 0) + (1 - mass3[c2]) * p
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("shard, hot", [(4_000_000, 500_000), (300, 40)])
def test_lm_scores(docs, rows, monkeypatch, shard, hot):
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", shard)
    monkeypatch.setattr(ngram_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(ngram_trie, "HOT", hot)
    got = sorted(tuple(r) for r in ngram_trie.report(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    want = sorted(brute_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
        assert w[6] - 0.03 * w[2] <= g[6] <= w[6] + 1e-6  # quantised downwards only


def test_lm_without_training(empty, docs):
    model = ngram_trie.fit(empty)
    r = ngram_trie.score(docs, model, ["doc_id"]).first()
    assert (r["n_known"], r["base_score"], r["score"]) == (0, 0.0, 0.0)


def test_sentencepiece_equals_library(docs, rows):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    want = [(i, None if t is None else sp.encode(t), 0 if t is None else len(sp.encode(t)), True) for i, t, *_ in rows]
    got = [(r["doc_id"], r["ids"], r["n_pieces"], r["round_trip"]) for r in sentencepiece_fst.report(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abeht  ▁.é日\n<0x41>\x00́", max_size=30))
def test_sentencepiece_random(text):
    t = _transducer()
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    assert list(t.encode(text)) == sp.encode(text)
    assert t.decode(t.encode(text)) == text.replace("▁", " ")


_T = []


def _transducer():
    if not _T:
        _T.append(sentencepiece_fst.Transducer.load())
    return _T[0]


def test_unigram_shortest_path():
    pieces = [("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -1.5, 1), ("ba", -5.0, 1)]
    t = sentencepiece_fst.Transducer(pieces, bpe=False, prefix=False, collapse=False)
    assert list(t.encode("aba")) == [3, 1] and list(t.encode("b?")) == [2, 0]


def test_decontamination(spark, docs, rows):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, " ".join(rows[7][1].split()[3:20]).upper()), (2, "spam ham"), (3, None), (4, "?!"), (10, rows[2][1]), (2, "spam ham"), (11, "zz qq")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    win = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            win.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    want = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for j in range(len(w)):
            for n in range(1, 11):
                if tuple(w[j : j + n]) in win and j + n <= len(w):
                    hit.update(range(j, j + n))
                    found |= win[tuple(w[j : j + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = decontaminate.report(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)



def test_proximity():
    ix = decontaminate.PositionalIndex(np.array([0, 10, 3, 30, 31]), np.array([0, 2, 4]), np.array([2, 4, 5]))
    assert ix.near(np.array([0, 1]), 5).tolist() == [0] and ix.phrase(np.array([1, 2])).tolist() == [30]


def chained(values):
    h = 42
    for x in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_sketch(text):
    """{hash: first position} of the SIZE smallest closed syncmers."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    if 0 < len(h) < 5:
        x = xxhash.xxh64_intdigest(" ".join(map(str, h)).encode(), seed=42)
        return {x - (1 << 64) if x >> 63 else x: 0}
    out = {}
    for i in range(len(h) - 4):
        inner = [chained(h[i + j : i + j + 2]) for j in range(4)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(chained(h[i : i + 5]), i)
    return dict(sorted(out.items())[:64])


def brute_likeness(a, b):
    union = sorted({*a, *b})[:64]
    return 1.0 if not a and not b else 0.0 if not a or not b else sum(x in a and x in b for x in union) / len(union)


@pytest.mark.parametrize("block_rows, fan", [(2000, 64), (3, 4)])
def test_fingerprints(docs, rows, monkeypatch, block_rows, fan):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(fingerprint, "FAN", fan)
    got = [tuple(r) for r in fingerprint.fingerprints(docs).collect()]
    order, want = sorted((i, t or "") for i, t, *_ in rows), []
    text = lambda s: ",".join(f"{x & (1 << 64) - 1:016x}" for x in s)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(nxt)
        both = a.keys() & b.keys()
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), brute_likeness(a, b), brute_likeness(a, c), sum(a[x] == b[x] for x in both) / len(both) if both else None))
    assert sorted(map(str, got)) == sorted(map(str, want))


def _labelled(spark, n=300):
    r = random.Random(2)
    vocab = ["".join(r.choice("aeiouthnrs") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows, marks = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = [r.choice(vocab) for _ in range(60)]
        if bad:
            w = [x.upper() + "!!" for x in w[:-1]] + ["scum"]
        rows.append((i, " ".join(w), "en", "s", 1, 0.0, []))
        marks.append((i, int(not bad), int(bad)))
    rows += [(9000, None, None, "s", 0, 0.0, []), (9001, "", None, "s", 0, 0.0, [])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, words array<string>"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_held_out_rows(spark, operator, column):
    docs, labels = _labelled(spark)
    out = operator.report(docs, labels)
    assert out.count() == 302 and out.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").isEmpty()
    held = out.filter("held_out").join(labels, "doc_id")
    assert held.filter(f"predicted = {column}").count() / held.count() > 0.95


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_without_labels(spark, operator):
    docs, labels = _labelled(spark, 10)
    assert {r["score"] for r in operator.report(docs, labels.limit(0)).collect()} == {0.0}


def test_nearest_is_exact():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(300):
        t = np.sort(r.choice(40, 5, replace=False))
        w = r.random(5)
        vectors.append((t, w / np.linalg.norm(w)))
    ix = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:40]:
        q = np.zeros(40)
        q[t] = w
        e, c = ix.nearest(t, w, 10)
        dots = np.round(dense @ q, 12)
        assert e.tolist() == [i for i in np.lexsort((np.arange(300), -dots)) if dots[i] > 0][:10]
        assert np.allclose(c, (dense @ q)[e])


def test_language(spark):
    r = random.Random(3)
    alpha = {"en": "thewandofi", "fr": "leséàduqun", "de": "diüßerchun"}
    rows = [(i, " ".join("".join(r.choice(alpha[k]) for _ in range(5)) for _ in range(40)), k) for i, k in enumerate(list(alpha) * 60)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 ?!", "fr")]
    out = {x["doc_id"]: x for x in langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k in rows[:-3])
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))


def test_codewords_differ():
    for n in (2, 4, 9):
        c = langid.codewords(n)
        assert len({tuple(x) for x in c}) == n


def test_language_without_labels(empty, docs):
    model = langid.fit(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, model, ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("run", [lambda d: ngram_trie.report(d), lambda d: fingerprint.fingerprints(d), lambda d: langid.report(d), lambda d: sentencepiece_fst.report(d)])
def test_empty_tables(run, empty):
    assert run(empty).collect() == []
