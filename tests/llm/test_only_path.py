"""op5's path search needs no list of a state's arcs, and its paths are the merges."""

import random

from lattiq.llm.sentencepiece_fst import MARK, Transducer


def _learned(rng):
    """A model of which each piece is two pieces that a text was merged to before."""
    pieces = list("abc" + MARK)
    model = lambda: Transducer([("<unk>", 0.0, 2), *((p, -float(i), 1) for i, p in enumerate(pieces))], True, True, False)
    while len(pieces) < 24:
        parts = model().merge(MARK + "".join(rng.choices("abc", k=20)))
        at = rng.randrange(len(parts) - 1)
        pieces.append(parts[at] + parts[at + 1])
    return model()


def test_paths_are_the_merges_without_listing_arcs(monkeypatch):
    def listed(*_):
        raise AssertionError("arcs were listed")

    monkeypatch.setattr(Transducer, "_arcs", listed)
    rng = random.Random(2)
    for _ in range(60):
        t = _learned(rng)
        for _ in range(20):
            chunk = MARK + "".join(rng.choices("abcd", k=rng.randint(0, 25)))
            assert [t.text[i] if i else "d" for i in t.shortest_path(chunk)] == t.merge(chunk)


def test_longest_pieces_and_their_prefixes():
    t = Transducer([("<unk>", 0.0, 2), ("a", -1.0, 1), ("abc", -2.0, 1), ("bc", -3.0, 1)], True, False, False)
    assert t._arcs("abcd", 0) == [(1, 1), (2, 3)]
    assert t._arcs("abcd", 1) == [(-2, 2), (3, 3)]
    assert t._arcs("abcd", 3) == [(-2, 4)]
