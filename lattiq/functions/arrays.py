"""Aggregates of numeric arrays; null for empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def sum_of(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def mean_of(x: Column | str) -> Column:
    return F.try_divide(sum_of(x), F.size(col(x)))


def median_of(x: Column | str) -> Column:
    s, n = F.sort_array(col(x)), F.size(col(x))
    mid = F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(s, mid) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
