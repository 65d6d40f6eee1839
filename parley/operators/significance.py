"""Mann-Whitney U over any number of named measures at once."""

from __future__ import annotations

from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parley.functions.numbers import normal_two_sided, rounded
from parley.operators.ordering import SLICE_ROWS, with_running_total

EXACT_ROWS = 8  # fixed value: largest small sample for the exact distribution


def average_ranks(df: DataFrame, key: str, value: str, limit: int = SLICE_ROWS) -> DataFrame:
    """(key, value, n, avg_rank): one row per distinct value, ties share a rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    placed = with_running_total(counts, [key], [value], F.col("n"), "_before", limit)
    return placed.select(key, value, "n", (F.col("_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def _subsets_up_to(u: int, small: int, large: int) -> int:
    """How many placements of ``small`` ranks among ``large`` have U <= u.

    The count's generating function is prod (1-q^(large+i)) / (1-q^i) / (1-q).
    The numerator is expanded; the rest, a series with repeating denominators, is
    put over (1-q^L)^k with L the common period, so the size of ``large`` does
    not matter.
    """
    period = 1
    for i in range(2, small + 1):
        period = period * i // _gcd(period, i)
    steps = [1, *range(1, small + 1)]
    top = [1]
    for i in steps:
        run = [0] * (len(top) + period - i)
        for start in range(0, period, i):
            for at, c in enumerate(top):
                run[at + start] += c
        top = run
    signed = {0: 1}
    for i in range(1, small + 1):
        more = dict(signed)
        for e, c in signed.items():
            more[e + large + i] = more.get(e + large + i, 0) - c
        signed = more
    k, total = len(steps), 0
    for e, sign in signed.items():
        rest = u - e
        if rest < 0:
            continue
        for at in range(rest % period, min(rest, len(top) - 1) + 1, period):
            total += sign * top[at] * comb((rest - at) // period + k - 1, k - 1)
    return total


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p-value of U without ties."""
    small, large = sorted((int(n1), int(n2)))
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * _subsets_up_to(low, small, large) / comb(small + large, small))


def _exact(u: pd.Series, n1: pd.Series, n2: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([exact_p(*row[:3]) if row[3] else None for row in zip(u, n1, n2, wanted)], dtype="float64")


def mann_whitney(df: DataFrame, value: str = "value", cohort: str = "cohort", key: str = "id",
                 alpha: float = 0.05, digits: int | None = 4, limit: int = SLICE_ROWS,
                 labels: tuple[str, str] = ("before", "after")) -> DataFrame:
    """(key, n1, n2, u1, p_value, significant, test), two-sided.

    Values are first counted per (key, value), so ties collapse on the map side
    and only distinct values are ordered.
    """
    first, second = (F.col(cohort) == label for label in labels)
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count_if(first).alias("_a"), F.count_if(second).alias("_b"))
    both = F.col("_a") + F.col("_b")
    placed = with_running_total(counts, [key], [value], both, "_before", limit)
    t = both.cast("double")
    sums = placed.groupBy(key).agg(
        F.sum("_a").alias("n1"), F.sum("_b").alias("n2"),
        F.sum(F.col("_a") * (F.col("_before") + (both + 1) / 2)).alias("_r1"),
        F.sum(t * t * t - t).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sums = sums.withColumn("u1", F.col("_r1") - n1 * (n1 + 1) / 2)
    u = F.greatest(F.col("u1"), n1 * n2 - F.col("u1"))
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (u - n1 * n2 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    approx = F.coalesce(normal_two_sided(z), F.lit(1.0))
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    is_exact = enough & (F.least("n1", "n2") <= EXACT_ROWS) & (F.col("_ties") == 0)
    exact = F.pandas_udf(_exact, "double")(F.col("u1"), F.col("n1"), F.col("n2"), is_exact)
    res = sums.withColumn("_exact", exact)
    p: Column = F.when(~enough, 1.0).otherwise(F.coalesce("_exact", approx))
    return res.select(
        key, "n1", "n2", "u1", rounded(p, digits).alias("p_value"), (enough & (p < alpha)).alias("significant"),
        F.when(enough, "mann_whitney").otherwise("insufficient_data").alias("test"))
