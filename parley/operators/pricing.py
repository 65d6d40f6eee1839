"""Model prices and token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.schemas import PRICE
from parley.session import if_small, literal_table

# USD per million input and output tokens by model.
PRICES = [
    ("main_model", 0.0, 0.0, True),
    ("cq_model", 0.0, 0.0, True),
    ("router_model", 0.0, 0.0, True),
    ("gpt-4.1", 2.00, 8.00, False),
    ("gpt-4.1-mini", 0.40, 1.60, False),
    ("gpt-4.1-nano", 0.10, 0.40, False),
    ("gpt-4o", 2.50, 10.00, False),
    ("gpt-4o-mini", 0.15, 0.60, False),
    ("gpt-5.1", 1.25, 10.00, False),
    ("gpt-5.4", 1.25, 10.00, False),
    ("gpt-oss-120b", 0.15, 0.60, False),
    ("gemini-2.5-flash-lite", 0.10, 0.40, False),
    ("gemini-2.5-flash", 0.30, 2.50, False),
    ("gemini-2.0-flash", 0.10, 0.40, False),
]

# Deployment names that differ from the priced name.
ALIASES = {"openai/gpt-oss-120b": "gpt-oss-120b"}


PRICE_ROWS = 10_000  # price rows sent to every executor, at most


def price_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PRICES, PRICE)


def with_price(usage: DataFrame, price: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Add ``input_rate`` and ``output_rate`` in USD per token; 0 when unknown.

    A price table of ordinary size is broadcast. A larger one is joined by
    shuffle, and then only the rows that name a model take part, since the rest
    would all meet in one task.
    """
    name = F.col("model_id")
    for alias, real in aliases.items():
        name = F.when(F.col("model_id") == alias, F.lit(real)).otherwise(name)

    def rate(col: str) -> Column:
        free = F.coalesce("zero_cost", F.lit(False))
        return F.when(free, 0.0).otherwise(F.coalesce(col, F.lit(0.0))) / 1_000_000

    rates = price.where(F.col("model_id").isNotNull()).select(
        F.col("model_id").alias("_priced"),
        rate("input_usd_per_million").alias("_in"), rate("output_usd_per_million").alias("_out"))
    named = usage.withColumn("_priced", name)
    small = if_small(rates, PRICE_ROWS)
    if small is not None:
        out = named.join(small, "_priced", "left")
    else:
        none = {"_in": F.lit(None).cast("double"), "_out": F.lit(None).cast("double")}
        out = named.where(F.col("_priced").isNotNull()).join(rates, "_priced", "left").unionByName(
            named.where(F.col("_priced").isNull()).withColumns(none))
    return out.withColumns({
        "input_rate": F.coalesce("_in", F.lit(0.0)), "output_rate": F.coalesce("_out", F.lit(0.0)),
    }).drop("_priced", "_in", "_out")
