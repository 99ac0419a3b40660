"""Lookups: the first, the latest, nested children, list entries by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of the first row of each key; one pass, combined before it is shuffled."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def latest_before(df: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """The values of the latest row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), at).alias("__v")).select(key, "__v.*")


def nest(parents: DataFrame, children: DataFrame, on: dict[str, str], columns: list[str], name: str) -> DataFrame:
    """Parents with an array of their children, in order of the columns; empty where there are none.

    Children are gathered before the join, so that parents are never repeated.
    """
    keys = [F.col(c).alias(p) for c, p in on.items()]
    per = children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    out = parents.join(per, list(on.values()), "left")
    empty = F.array().cast(out.schema[name].dataType)
    return out.withColumn(name, F.coalesce(name, empty))


def mismatched_axes(axes: dict[str, tuple[str, str]]) -> Column:
    """Names of the axes on which two columns differ."""
    return F.array_compact(F.array(*[F.when(F.col(a) != F.col(b), F.lit(k)) for k, (a, b) in axes.items()]))


def all_references_known(df: DataFrame, key: str, refs: str, known: DataFrame, known_column: str) -> DataFrame:
    """key, valid: whether an item has references and each of them is known."""
    each = df.select(key, F.explode_outer(refs).alias("__ref"))
    hit = known.select(F.col(known_column).alias("__ref"), F.lit(True).alias("__hit")).distinct()
    got = each.join(hit, "__ref", "left")
    return got.groupBy(key).agg(F.bool_and(F.coalesce("__hit", F.lit(False))).alias("valid"))
