"""N-grams seen once are part of the language model."""

import collections
import math

import pytest

from lattiq.llm import ngram_trie


def test_singletons(spark):
    texts = ["a b c d", "a b e f", "x c d g"]
    got = ngram_trie.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ngram_trie.fit(spark.createDataFrame([(t,) for t in texts], "text string")), ["doc_id"])
    rows = [[*t.split(), None] for t in texts]
    one, two, three = (collections.Counter() for _ in range(3))
    for w in rows:
        one.update(w)
        two.update(zip([None, *w], w))
        three.update(zip([None, *w], w, w[1:]))
    share = [sum(n == k for n in c.values()) for c in (two, three) for k in (1, 2)]
    d2, d3 = (a / (a + 2 * b) for a, b in (share[:2], share[2:]))
    want = []
    for w in rows:
        total, past = 0.0, [None, *w]
        for j, x in enumerate(w):
            p = (one[x] + 1) / (one.total() + len(one) + 1)
            v = past[j]
            p = max(two[v, x] - d2, 0) / one[v] + (1 - sum(n - d2 for k, n in two.items() if k[0] == v) / one[v]) * p
            if j:
                c = (past[j - 1], v)
                p = max(three[*c, x] - d3, 0) / two[c] + (1 - sum(n - d3 for k, n in three.items() if k[:2] == c) / two[c]) * p
            total += math.log10(p)
        want.append(total)
    assert [r["score"] for r in sorted(got.collect())] == pytest.approx(want, abs=1e-5)
