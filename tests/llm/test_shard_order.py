"""op1 deals n-grams to shards by a stable order of the shard numbers, whatever their number."""

import numpy as np

from lattiq.llm.ngram_trie import by_number


def test_order_is_stable_and_small_numbers_are_sorted_as_16_bits(monkeypatch):
    rng, plain, kinds = np.random.default_rng(4), np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda x, **k: (kinds.append(x.dtype), plain(x, **k))[1])
    for n in (1, 21, 1 << 16, 100_000):
        which = np.concatenate([rng.integers(0, n, 5000), [n - 1, 0]])
        assert by_number(which, n).tolist() == sorted(range(len(which)), key=which.tolist().__getitem__)
    assert kinds == [np.uint16] * 3 + [np.int64]
