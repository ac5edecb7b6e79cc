"""Algebra on answer sets held as ``ARRAY<STRING>``.

Arrays are treated as sets: order and repeats do not matter.  Everything here is row-local; for
sets too large for one row see :mod:`accordant.operators.analysis`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_set() -> Column:
    return F.array().cast("array<string>")


def or_empty(a: Column) -> Column:
    """A missing answer is the empty set, not NULL."""
    return F.coalesce(a, empty_set())


def to_set(a: Column) -> Column:
    return F.array_distinct(a)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def is_subset(a: Column, b: Column) -> Column:
    """``a`` is a (not necessarily proper) subset of ``b``."""
    return F.size(F.array_except(a, b)) == 0


def equal(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def is_difference(a: Column, b: Column, c: Column) -> Column:
    """``a`` without ``b`` equals ``c``."""
    return equal(difference(a, b), c)


def partitions(whole: Column, a: Column, b: Column) -> Column:
    """``a`` and ``b`` are disjoint and together make up ``whole``."""
    return equal(whole, union(a, b)) & disjoint(a, b)


def both_empty(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) & (F.size(b) == 0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets score 0."""
    return ratio_or_zero(F.size(F.array_intersect(a, b)), F.size(union(a, b)))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def flag(condition: Column) -> Column:
    """Boolean to a 0/1 integer."""
    return condition.cast("int")
