"""Numeric expressions: rounding, normal and chi-square tails, rate tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F, types as T


def rounded(c: Column, digits: int | None) -> Column:
    """Half-even rounding; None leaves the value as it is."""
    return c if digits is None else F.bround(c, digits)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0 or either is null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def delta_pct(before: Column, after: Column) -> Column:
    return safe_ratio((after - before) * 100.0, before)


def to_number(c: Column, kind: T.DataType) -> Column:
    """Booleans as 1.0/0.0, numbers as double, anything else null."""
    if isinstance(kind, (T.BooleanType, T.NumericType)):
        return c.cast("double")
    return F.lit(None).cast("double")


# The rational approximation 7.1.26 of the error function in
# Abramowitz and Stegun, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def normal_two_sided(z: Column) -> Column:
    """2 * P(Z > z), at most 1; z below 0 gives 1."""
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), erfc(z / math.sqrt(2.0))))


def z_test(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """p-value of the pooled two-proportion test; 1 when it has no spread."""
    pool = safe_ratio(x1 + x2, (n1 + n2).cast("double"))
    se = F.sqrt(pool * (1 - pool) * (safe_ratio(F.lit(1.0), n1) + safe_ratio(F.lit(1.0), n2)))
    z = F.abs(safe_ratio(x2.cast("double"), n2) - safe_ratio(x1.cast("double"), n1)) / F.nullif(se, F.lit(0.0))
    return F.when((n1 == 0) | (n2 == 0), F.lit(1.0)).otherwise(F.coalesce(normal_two_sided(z), F.lit(1.0)))


def chi_square(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """p-value of the 2x2 test with continuity correction; null on a zero margin."""
    a, na, b, nb = (c.cast("double") for c in (a, na, b, nb))
    n, hit = na + nb, a + b
    # all four cells of a 2x2 table are off by the same amount
    off = F.abs(a - na * hit / F.nullif(n, F.lit(0.0)))
    off = off - F.least(F.lit(0.5), off)
    product = F.nullif(na * nb * hit * (n - hit), F.lit(0.0))
    return erfc(F.sqrt(off * off * n * n * n / product / 2))


def fisher(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Two-sided exact p-value of a 2x2 table with one side below 5 rows.

    At most five tables share the margins. Their weights are proportional to
    C(ns,k) C(nl,m-k), written as short products so large nl stays in range.
    """
    a, na, b, nb = (c.cast("double") for c in (a, na, b, nb))
    small = na <= nb
    ns, nl = F.when(small, na).otherwise(nb), F.when(small, nb).otherwise(na)
    seen, m = F.when(small, a).otherwise(b), a + b

    def weight(k: int) -> Column:
        w = F.lit(1.0)
        for i in range(k):
            w = w * (ns - i) / (i + 1) * (m - i)
        for i in range(k + 1, 5):
            w = w * (nl - m + i)
        return w

    table = F.array(*[weight(k) for k in range(5)])
    limit = F.get(table, seen.cast("int")) * (1 + 1e-7)
    total = F.aggregate(table, F.lit(0.0), lambda s, w: s + w)
    tail = F.aggregate(table, F.lit(0.0), lambda s, w: s + F.when(w <= limit, w).otherwise(0.0))
    flat = (m == 0) | (m == na + nb) | (na == 0) | (nb == 0)
    return F.when(flat, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail / total))


def rate_test(a: Column, na: Column, b: Column, nb: Column, alpha: float,
              digits: int | None = 4) -> list[Column]:
    """p_value, significant, test: exact below 5 rows a side, else chi-square."""
    exact = (na < 5) | (nb < 5)
    chi = chi_square(a, na, b, nb)
    p = F.when(exact, fisher(a, na, b, nb)).otherwise(F.coalesce(chi, F.lit(1.0)))
    test = F.when(exact, F.lit("fisher")).when(chi.isNull(), F.lit("error")).otherwise(F.lit("chi_square"))
    significant = (p < alpha) & (test != "error")
    return [rounded(p, digits).alias("p_value"), significant.alias("significant"), test.alias("test")]


def exclusive_p95(values: Column) -> Column:
    """p95 of a sorted array by the exclusive 20-quantile rule; null when empty.

    It interpolates at 19(n+1)/20, so it may lie beyond the largest value. A
    single value is its own p95.
    """
    n = F.size(values)
    j = F.greatest(F.least(F.floor(F.lit(19) * (n + 1) / 20), n - 1), F.lit(1)).cast("int")
    d = F.lit(19) * (n + 1) - F.lit(20) * j
    inner = (F.get(values, j - 1) * (F.lit(20) - d) + F.get(values, j) * d) / 20
    return F.when(n == 1, F.get(values, F.lit(0))).when(n > 1, inner)


def median_of(values: Column) -> Column:
    """Median of a sorted array; null when empty."""
    n = F.size(values)
    low, high = F.get(values, ((n - 1) / 2).cast("int")), F.get(values, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
