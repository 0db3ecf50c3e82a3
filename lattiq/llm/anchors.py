"""Window anchors: which places two texts must share to share a whole window of symbols.

A window of ``length`` symbols is represented by its anchor, the leftmost smallest ``k``-gram hash
inside it.  Equal windows have equal anchors at equal offsets, so windows can be compared anchor by
anchor, and only about 2 in ``length - k + 2`` positions are anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Slice, signed, sliding_min

_PLACE = U64((1 << 28) - 1)


class Anchors:
    """Anchor occurrences of the rows of a slice.

    Occurrence i belongs to ``row[i]``, has gram hash ``h[i]`` and represents the ``windows[i]``
    windows that start at symbols ``start[i], start[i]+1, ...`` (numbered within the slice).
    """

    def __init__(self, gram: np.ndarray, first: np.ndarray, length: int, k: int):
        n = int(first[-1])
        if n < length:
            self.start = self.windows = self.row = np.zeros(0, np.int64)
            self.h = np.zeros(0, np.uint64)
            return
        key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        place = (sliding_min(key, length - k + 1) & _PLACE).astype(np.int64)
        size = np.diff(first)
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, first[:-1][size >= length], 1)
        np.add.at(inside, first[1:][size >= length] - length + 1, -1)
        valid = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
        p = place[valid]
        head = np.ones(len(p), bool)
        head[1:] = (p[1:] != p[:-1]) | (valid[1:] != valid[:-1] + 1)
        at = np.flatnonzero(head)
        self.start = valid[at]
        self.windows = np.diff(np.append(at, len(p)))
        self.h = gram[p[at]]
        self.row = np.searchsorted(first, self.start, "right") - 1


def leftmost(grams: np.ndarray) -> np.ndarray:
    """Place of the anchor in each row of the grams of a window, by the order ``Anchors`` uses."""
    return np.argmin(grams & ~_PLACE, axis=1)


def wanted_anchors(s: Slice, a: Anchors) -> np.ndarray:
    """Numbers of the anchors of a slice that are in their row's list ``hs``."""
    lists = s.rows.column("hs")
    value, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(s.n), size)
    order = np.lexsort((value, row))
    value, first = value[order], np.concatenate([[0], np.cumsum(size)])
    own, h = np.zeros(len(a.h), bool), signed(a.h)
    cut = np.searchsorted(a.row, np.arange(s.n + 1))
    for i in np.flatnonzero((np.diff(cut) > 0) & (size > 0)):
        list_, mine = value[first[i] : first[i + 1]], h[cut[i] : cut[i + 1]]
        own[cut[i] : cut[i + 1]] = list_[np.minimum(np.searchsorted(list_, mine), len(list_) - 1)] == mine
    return np.flatnonzero(own)


def recurring(entries: DataFrame, across: bool) -> DataFrame:
    """Distinct h of (h, rid) entries that occur in two rows (``across``), or twice at all."""
    if across:
        return entries.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi").select("h")
    return entries.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def runs(row: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evenly spaced repetitions as one: (first, number, step) of runs of entries that agree in row, x
    and y and start ``step`` (at most ``longest``) symbols apart, as periodic texts have them."""
    n = len(start)
    step = np.diff(start, prepend=start[:1])
    same = np.zeros(n, bool)
    same[1:] = (row[1:] == row[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (step[1:] <= longest)
    uneven = np.zeros(n, bool)
    uneven[1:] = same[1:] & same[:-1] & (step[1:] != step[:-1])
    head = np.flatnonzero(~same | uneven)
    number = np.diff(np.append(head, n))
    return head, number, np.where(number > 1, step[np.minimum(head + 1, max(n - 1, 0))], 0)
