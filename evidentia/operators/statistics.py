"""Percentiles, histograms and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank_percentile(column: str, q: float) -> Column:
    """The value at rank ceil(q * n), 0 for no values.

    Counts values, not rows: equal values are combined before they are shuffled.
    """
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})"), F.lit(0.0))


def floor_percentile(df: DataFrame, by: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """The value at index min(n - 1, floor(q * n)) of the sorted values.

    Works on counts of distinct values, so no group is gathered.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy(column)
    counts = counts.withColumn("__to", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    index = lambda q: F.least(F.col("__all") - 1, F.floor(F.lit(q) * F.col("__all")))
    return counts.groupBy(*by).agg(*[F.min(F.when(F.col("__to") > index(q), F.col(column))).alias(name) for name, q in quantiles.items()])


def clamped_histogram(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """bin, n for every bin from low to high; values are rounded and clamped."""
    clamp = F.greatest(F.lit(low), F.least(F.lit(high), F.round(value).cast("int"))).alias("bin")
    n = df.where(value.isNotNull()).groupBy(clamp).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cumulative_buckets(df: DataFrame, by: list[str], column: str, bounds: list[float]) -> DataFrame:
    """by, le, n: how many values are at most each bound, and at most infinity; one aggregation."""
    all_ = [*bounds, float("inf")]
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(column) <= b).alias(f"__b{i}") for i, b in enumerate(all_)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(all_)])
    return wide.select(*by, F.inline(pairs))
