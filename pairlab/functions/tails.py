"""Tail probabilities for result tables, as column expressions and for single numbers.

Spark has no error function; its series and continued fraction are written with array functions here, so
no Python worker takes part. They are meant for test results (one row per test), not for observations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(q: float, df: int) -> float:
    """P(X >= q) for chi-square with whole `df`, as a finite sum."""
    if q is None or math.isnan(q) or df is None or math.isnan(df) or df < 1:
        return math.nan
    if q <= 0:
        return 1.0
    half, df = q / 2.0, int(df)
    if df % 2:
        total, first = math.erfc(math.sqrt(half)), 0.5
    else:
        total, first = 0.0, 0.0
    # terms half^a exp(-half) / gamma(a + 1), a = first, first + 1, ... below df / 2
    for i in range((df - df % 2) // 2):
        a = first + i
        total += math.exp(a * math.log(half) - half - math.lgamma(a + 1.0))
    return min(total, 1.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), from the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) if 0.0 < x < 1.0 else 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Value of the continued fraction, evaluated from its tail."""
    value = 1.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + even / (1.0 + odd / value)
    first = -(a + b) * x / (a + 1.0)
    return 1.0 / (1.0 + first / value)


# Above this the continued fraction of erfc is used, below it the series of erf; both are exact to about 1e-15 here.
_SPLIT = 2.0
_TERMS = 70
_ROOT_PI = math.sqrt(math.pi)


def erfc(x: Column) -> Column:
    """Complementary error function, relative accuracy about 1e-13; from a series up to 2, a continued fraction beyond."""
    size = F.abs(x.cast("double"))
    low, high = F.least(size, F.lit(_SPLIT)), F.greatest(size, F.lit(_SPLIT))
    series = F.aggregate(  # terms low^(2n+1) 2^n / (1 * 3 * ... * (2n+1)) and their sum
        F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(low.alias("term"), low.alias("sum")),
        lambda acc, n: _next_term(acc, acc["term"] * (2 * low * low) / (2 * n + 1)), lambda acc: acc["sum"],
    )
    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1)), high, lambda acc, n: high + n / (2 * acc))
    upper = F.when(size <= _SPLIT, 1 - 2 / _ROOT_PI * F.exp(-low * low) * series).otherwise(
        F.exp(-high * high) / (_ROOT_PI * fraction)
    )
    return F.when(size.isNull() | F.isnan(size), size).when(x < 0, 2 - upper).otherwise(upper)


def _next_term(acc: Column, term: Column) -> Column:
    return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))


def chi2_sf(q: Column, df: Column) -> Column:
    """P(X >= q) for chi-square with whole `df` of at least 1, as a finite sum of column expressions."""
    half = F.when(q > 0, q.cast("double") / 2)  # logs of positive numbers only
    whole = F.floor(df.cast("double"))
    first = F.when(whole % 2 == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    steps = F.floor(whole / 2).cast("int")
    # log of half^a exp(-half) / gamma(a + 1), a = first, first + 1, ... below df / 2
    log_first = F.when(first > 0, F.log(half) / 2 - math.log(_ROOT_PI / 2)).otherwise(F.lit(0.0)) - half
    total = F.aggregate(
        F.filter(F.sequence(F.lit(0), steps), lambda i: i < steps),
        F.struct(log_first.alias("log"), F.when(first > 0, erfc(F.sqrt(half))).otherwise(F.lit(0.0)).alias("sum")),
        lambda acc, i: F.struct(
            (acc["log"] + F.log(half) - F.log(first + i + 1)).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    known = q.isNotNull() & df.isNotNull() & ~F.isnan(q.cast("double")) & ~F.isnan(df.cast("double")) & (df >= 1)
    endless = q.cast("double") == F.lit(float("inf"))
    return F.when(~known, None).when(q <= 0, F.lit(1.0)).when(endless, F.lit(0.0)).otherwise(F.least(total, F.lit(1.0)))


def normal_p(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal variable."""
    return erfc(F.abs(z.cast("double")) / math.sqrt(2.0))


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, else NULL: Newton steps on the log of the smaller tail."""
    tail = F.when((p > 0) & (p < 1), F.least(p, 1 - p))  # its quantile is at most sqrt(-2 log(2 tail)), the start

    def step(x: Column, _: Column) -> Column:
        upper = erfc(x / math.sqrt(2.0)) / 2
        density = F.exp(-x * x / 2) / math.sqrt(2.0 * math.pi)
        return x + (F.log(upper) - F.log(tail)) * upper / density

    size = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.sqrt(-2 * F.log(2 * tail)), step)
    return F.when(tail.isNotNull(), F.when(p < 0.5, -size).otherwise(size))
