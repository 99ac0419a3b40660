"""Predicates that every read of a kind of record carries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that meet all conditions; with none given, the frame as it is."""
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def scoped(df: DataFrame, tenant_column: str, tenant, deleted_column: str = "deleted_at") -> DataFrame:
    """One tenant's rows that are not deleted; what is out of scope looks as if it did not exist."""
    return df.where((F.col(tenant_column) == tenant) & F.col(deleted_column).isNull())


def corpus_predicate(model: str, guidelines: list[str] | None = None, versions: list[str] | None = None) -> Column:
    """What both arms of a search may see: one embedding model, and the filters that are given.

    A filter that is given but empty selects nothing.
    """
    out = F.col("model") == model
    for column, wanted in (("guideline", guidelines), ("version", versions)):
        if wanted is not None:
            out = out & (F.col(column).isin(wanted) if wanted else F.lit(False))
    return out
