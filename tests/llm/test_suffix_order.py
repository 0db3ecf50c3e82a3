"""The order of suffixes behind op10's index: right, and sorted only where it is still open."""

import random

import numpy as np

from lattiq.llm import suffix_dedup


def _coded(texts):
    size = np.array([len(t) for t in texts]) + 1
    end = np.cumsum(size) - 1
    code = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    code[end] = 0
    return code, np.repeat(end, size) - np.arange(size.sum()), int(size.max())


def test_order_and_ranks_are_those_of_the_suffixes():
    random.seed(11)
    for _ in range(300):
        letters = bytes(random.sample(range(256), random.choice([1, 2, 20, 256])))
        texts = [bytes(random.choices(letters, k=random.choice([0, 1, 5, 30, 90]))) for _ in range(random.randint(1, 6))]
        texts += [random.choice(texts)[random.randint(0, 3) :] for _ in range(3)]
        code, left, longest = _coded(texts)
        depth = random.choice([1, 2, 3, 7, 25])
        order, rank = suffix_dedup._suffix_order(code, left, depth, longest)
        suffix = [tuple(code[i : i + left[i] + 1]) for i in range(len(code))]
        assert order.tolist() == sorted(range(len(code)), key=lambda i: (suffix[i], i))
        heads = {}
        assert all(heads.setdefault(s[:depth], r) == r for s, r in zip(suffix, rank.tolist()))
        assert len(set(heads.values())) == len(heads)


def test_only_tied_suffixes_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 170, np.uint8).tobytes() for _ in range(200)]
    texts += [t[20:] for t in texts[:20]]
    n, keys = sum(map(len, texts)) + len(texts), []
    for name in ("argsort", "unique"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, _plain=plain, **k: (keys.append(len(x)), _plain(x, *a, **k))[1])
    suffix_dedup.RunLengthIndex(texts)
    assert sum(keys) < 4 * n
