"""Numeric helpers: rounding, coercion, flags, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant.functions import sets


def round4(x: Column, digits: int = 4) -> Column:
    """Round half to even."""
    return F.bround(x, digits)


def to_number(x: Column) -> Column:
    """Double, or NULL where the value is no number."""
    return x.try_cast("double")


def row_mean(*columns: Column) -> Column:
    """Mean of the non-NULL values of a row; NULL if there are none."""
    present = [F.when(c.isNotNull(), 1).otherwise(0) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    n = reduce(lambda a, b: a + b, present)
    return F.when(n > 0, total / n)


def idk_any(a: Column) -> Column:
    """1 if the set is empty or holds 'idk' among others (per-question definition)."""
    return sets.flag((F.size(a) == 0) | F.coalesce(F.array_contains(a, "idk"), F.lit(False)))


def idk_only(a: Column) -> Column:
    """1 if the set is empty or is exactly {'idk'} (summary definition)."""
    return sets.flag((F.size(a) == 0) | (a == F.array(F.lit("idk"))))


def one_minus(p: Column) -> Column:
    return F.lit(1.0) - p


def fixed(x: Column, digits: int = 3) -> Column:
    """A number from 0 on with so many decimals; the binary value is rounded, a tie goes to the even digit.

    (``format_string`` rounds the shortest decimal text, and ties up.)  The value is compared with the
    double that is closest to the middle of two results; where it is that double, its
    distance from the true middle decides, which is exact in two parts.
    """
    scale = 10**digits
    low = F.floor(x * scale)
    aim = 2 * low + 1
    middle = aim.cast("double") / (2 * scale)
    head = middle.cast("float").cast("double")
    off = (head * (2 * scale) - aim) + (middle - head) * (2 * scale)
    up = (x > middle) | ((x == middle) & ((off > 0) | ((off == 0) & (low % 2 == 1))))
    whole = low + up.cast("long")
    return F.concat(F.floor(whole / scale).cast("string"), F.lit("."), F.lpad((whole % scale).cast("string"), digits, "0"))


def p_label(p: Column, alpha: float = 0.05, tiny: float = 0.001) -> Column:
    """Cell text of a p-value: empty unless significant, '≈0' when tiny, else 3 decimals."""
    return (
        F.when(p.isNull() | (p > alpha), F.lit(""))
        .when(p <= tiny, F.lit("≈0"))
        .otherwise(fixed(p))
    )


def p_hidden(p: Column, alpha: float = 0.05) -> Column:
    return p.isNull() | (p > alpha)


def confidence_hidden(v: Column, alpha: float = 0.05) -> Column:
    return v.isNull() | (v < alpha)


def confidence_label(v: Column, alpha: float = 0.05, tiny: float | None = None) -> Column:
    """Cell text on the confidence scale: shown only when ``tiny < v <= alpha``."""
    floor = 1 - alpha if tiny is None else tiny
    return F.when(v.isNull() | (v > alpha) | (v <= floor), F.lit("")).otherwise(fixed(v))


def truthy(x: Column) -> Column:
    """Neither NULL nor zero."""
    return x.isNotNull() & (x != 0)


# Drawing areas of the named sizes.
SIZE_BUCKETS = {"small": 80.0, "medium": 200.0, "large": 420.0}


def parse_size(size: Column) -> Column:
    """'70b', '300m' or a plain number as a double; NULL for anything else.  Missing is 'medium'."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(size.cast("string"), F.lit("medium")))), ",", "")
    body = F.substring(s, F.lit(1), F.length(s) - 1)
    return (
        F.when(s.endswith("b"), body.try_cast("double") * 1e9)
        .when(s.endswith("m"), body.try_cast("double") * 1e6)
        .otherwise(s.try_cast("double"))
    )


def bucket_area(size: Column, buckets: dict[str, float] | None = None) -> Column:
    """A numeric size as it is; a named size through ``buckets`` (unknown names are medium)."""
    buckets = buckets or SIZE_BUCKETS
    name = F.lower(F.coalesce(size.cast("string"), F.lit("medium")))
    out = F.lit(float(buckets["medium"]))
    for key, area in buckets.items():
        out = F.when(name == key, F.lit(float(area))).otherwise(out)
    return F.coalesce(size.cast("string").try_cast("double"), out)


def rescale(v: Column, vmin: Column, vmax: Column, lo: float = 80.0, hi: float = 420.0) -> Column:
    """Linear map of [vmin, vmax] onto [lo, hi]; a constant column maps to the midpoint."""
    flat = F.abs(vmax - vmin) <= 1e-9 * F.greatest(F.abs(vmin), F.abs(vmax))
    return F.when(flat, F.lit(0.5 * (lo + hi))).otherwise(F.lit(lo) + (v - vmin) / (vmax - vmin) * F.lit(hi - lo))
