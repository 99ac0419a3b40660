"""Reading of answers that may not keep to their format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranking(values: Column, n: Column) -> Column:
    """Indices 0..n-1 from an array of strings: whole numbers in range, each once, in order; an empty array for null."""
    number = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.try_cast("double"))
    whole = F.filter(number, lambda v: v.isNotNull() & (v == F.floor(v)) & (v >= 0) & (v < n))
    return F.array_distinct(F.transform(whole, lambda v: v.cast("int")))


def count_of(value: Column) -> Column:
    """A count from text: rounded, 0 for what is no number or below zero."""
    v = value.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float(1 << 31))
    return F.when(ok, F.floor(v + 0.5).cast("int")).otherwise(F.lit(0))


def verdict(value: Column, allowed: tuple[str, ...]) -> Column:
    """One of the allowed verdicts; anything else is an error."""
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit("verdict outside the contract: "), F.coalesce(value, F.lit("null")))).cast("string"))


def examples(values: Column, most: int = 2) -> Column:
    return F.slice(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull()), 1, most)
