"""Exact tests as column expressions over already aggregated counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside an expression, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ln_factorial(n: Column) -> Column:
    """ln n!: a plain sum below 32, Stirling's series above (error below 1e-15)."""

    def value(x: Column) -> Column:
        small = F.aggregate(
            F.sequence(F.lit(1), F.least(F.greatest(x, F.lit(1.0)), F.lit(32.0)).cast("int")),
            F.lit(0.0),
            lambda acc, i: acc + F.log(i.cast("double")),
        )
        inv = 1 / (x * x)
        series = (F.lit(1 / 12) - inv * (F.lit(1 / 360) - inv * (F.lit(1 / 1260) - inv / 1680))) / x
        return F.when(x < 32, small).otherwise(
            (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + series
        )

    return _let(n.cast("double"), value)


# Up to so many trials the tail is summed term by term; beyond, it is integrated.
SUMMED_TRIALS = 10_000
NODES = 40
# A tail whose terms fall by more than this from one to the next is summed in any case: 150 terms are enough.
STEEP, STEEP_TERMS = 0.7, 150


def _stirling(x: Column) -> Column:
    """ln x! less Stirling's formula, for x of some hundreds or more."""
    inv = 1 / (x * x)
    return (F.lit(1 / 12) - inv * (F.lit(1 / 360) - inv * F.lit(1 / 1260))) / x


def _ln_density(x: Column, n: Column) -> Column:
    """ln of the number of heads' density at a real x, without loss of digits for large n.

    The exponent is n times the divergence of x / n from one half, in the deviation from it.
    """
    d = (2 * x - n) / n
    divergence = ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d)) / 2
    return -n * divergence + (F.log(n) - F.log(x) - F.log(n - x) - F.lit(math.log(2 * math.pi))) / 2 + (
        _stirling(n) - _stirling(x) - _stirling(n - x)
    )


def _integrated_tail(start: Column, n: Column) -> Column:
    """Sum of the binomial terms from ``start`` (at the mean or above) on, for large n.

    A sum over whole numbers is an integral and corrections from the derivatives at its end (Euler and
    Maclaurin).  The integrand is smooth and falls like a normal density, so a fixed number of
    nodes (Gauss and Legendre) gives the integral however large n is.
    """
    at, weight = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((a + 1) / 2)).alias("at"), F.lit(float(w / 2)).alias("weight")) for a, w in zip(at, weight)])

    def body(v: Column) -> Column:
        k, n = v["k"], v["n"]
        sigma = F.sqrt(n) / 2
        u = (k - n / 2) / sigma
        width = F.least((F.sqrt(u * u + 80) - u) * sigma, n - k - 1)
        integral = width * F.aggregate(
            nodes, F.lit(0.0), lambda acc, e: acc + e["weight"] * F.exp(_ln_density(k + width * e["at"], n) - v["ln"])
        )
        g1 = F.log((n - k) / k) + (1 / (n - k) - 1 / k) / 2
        g2 = -1 / k - 1 / (n - k)
        g3 = 1 / (k * k) - 1 / ((n - k) * (n - k))
        third = g1 * g1 * g1 + 3 * g1 * g2 + g3
        fifth = F.pow(g1, F.lit(5)) + 10 * F.pow(g1, F.lit(3)) * g2 + 15 * g1 * g2 * g2
        seventh = F.pow(g1, F.lit(7)) + 21 * F.pow(g1, F.lit(5)) * g2
        ends = F.lit(0.5) - g1 / 12 + third / 720 - fifth / 30240 + seventh / 1209600
        return F.least(F.lit(1.0), F.exp(v["ln"]) * (integral + ends))

    return _let(F.struct(start.alias("k"), n.alias("n"), _ln_density(start, n).alias("ln")), body)


def binomial_upper_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, 1/2); 1 for k <= 0.

    Only the side beyond the mean is summed (the other side follows by symmetry).  There the
    terms fall at least as fast as exp(-2 j^2 / n), so 5 * sqrt(n) of them give full precision.
    Beyond ``SUMMED_TRIALS`` trials a fixed number of steps is taken: the terms are integrated,
    or, in a steep tail, summed up to where they vanish.
    """

    def summed(v: Column, first: Column, length: Column) -> Column:
        n, start = v["n"], v["start"]
        steps = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(length, F.lit(0))), lambda j: j > 0)
        total = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
            lambda acc, j: _let(
                acc["term"] * ((n - start - j + 1) / (start + j)),
                lambda term: F.struct(term.alias("term"), (acc["total"] + term).alias("total")),
            ),
            lambda acc: acc["total"],
        )
        return F.least(F.lit(1.0), first * total)

    def from_start(v: Column) -> Column:
        n, start = v["n"], v["start"]
        exact = F.exp(ln_factorial(n) - ln_factorial(start) - ln_factorial(n - start) - n * F.lit(math.log(2.0)))
        few = F.least(n - start, F.ceil(5 * F.sqrt(n)) + 50).cast("long")
        steep = F.least(n - start, F.lit(float(STEEP_TERMS))).cast("long")
        # Near n itself the real-valued density does not hold, and is not needed: those terms are tiny.
        dense = F.when(n - start < 1000, exact).otherwise(F.exp(_ln_density(start, n)))
        return (
            F.when(n <= SUMMED_TRIALS, summed(v, exact, few))
            .when((n - start) / (start + 1) <= STEEP, summed(v, dense, steep))
            .otherwise(_integrated_tail(start, n))
        )

    def from_pair(v: Column) -> Column:
        k, n = v["k"], v["n"]
        upper = 2 * k > n
        tail = from_start_of(F.when(upper, k).otherwise(n - k + 1), n)
        return (
            F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0))
            .otherwise(_let(tail, lambda t: F.when(upper, t).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - t))))
        )

    def from_start_of(start: Column, n: Column) -> Column:
        return _let(F.struct(start.alias("start"), n.alias("n")), from_start)

    return _let(F.struct(k.cast("double").alias("k"), n.cast("double").alias("n")), from_pair)


def mcnemar_one_sided(n10: Column, n01: Column) -> Column:
    """Exact one-sided paired test; 1 where there is no discordant pair."""
    return F.when(n10 + n01 == 0, F.lit(1.0)).otherwise(binomial_upper_tail(n10, n10 + n01))


def mcnemar_two_sided(n10: Column, n01: Column) -> Column:
    """Exact two-sided paired test: twice the smaller tail, at most 1."""
    return F.when(n10 + n01 == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), 2 * binomial_upper_tail(F.greatest(n10, n01), n10 + n01))
    )


def _ln_gamma_ratio(a: float) -> float:
    """ln(gamma(a + 1/2) / gamma(a)), without cancellation for large ``a``."""
    if a < 1e4:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)


def _half_beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 200_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            c = 1.0 + coef / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-16:
            return h
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def pearson_p_value(r: float, n: float) -> float | None:
    """Two-sided p of a Pearson correlation: I_{1-r^2}(n/2 - 1, 1/2)."""
    if r is None or n is None or n != n or r != r or n < 3:
        return 1.0 if n == 2 and r == r and r is not None else None
    a, b = (n - 2) / 2.0, 0.5
    x, y = (1.0 - r) * (1.0 + r), r * r
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    ln_front = a * math.log(x) + b * math.log(y) + _ln_gamma_ratio(a) - 0.5 * math.log(math.pi)
    if x < (a + 1) / (a + b + 2):
        return min(1.0, math.exp(ln_front) * _half_beta_fraction(a, b, x) / a)
    return min(1.0, max(0.0, 1.0 - math.exp(ln_front) * _half_beta_fraction(b, a, y) / b))


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """:func:`pearson_p_value` over result rows (one per metric)."""
    return pd.Series([pearson_p_value(x, m) for x, m in zip(r, n)], dtype="float64")
