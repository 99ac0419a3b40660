"""Row numbers and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; tasks drop what can't be among them before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return top_n(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the given order, by an aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def sample_strata(df: DataFrame, stratum: str, group: str, last: Column, within: list, n: int) -> DataFrame:
    """One row of each (stratum, group), then n groups of each stratum, those marked ``last`` at the end."""
    one = top_n(df, [group, stratum], within, 1).withColumn("__last", last)
    key = [c for c in within if isinstance(c, str)]
    return top_n(one, [stratum], ["__last", group, *key], n).drop("__last")


def carry_forward(df: DataFrame, by: list[str], order: list[str], levels: list[str]) -> DataFrame:
    """Values carried forward, level by level; a level starts anew when one above it changes."""
    keys = list(by)
    for level in levels:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(level, F.last(level, ignorenulls=True).over(w))
        keys.append(level)
    return df


def runs_of(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Numbers the runs of equal neighbouring values from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__s", starts).withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
