"""Keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SIZE, LEAST, MOST = 20, 1, 50


def page_size(asked: int | None) -> int:
    """The size of a page: the default where none is asked for; outside the bounds is an error."""
    size = DEFAULT_SIZE if asked is None else asked
    if not LEAST <= size <= MOST:
        raise ValueError(f"page size must be from {LEAST} to {MOST}")
    return size


def page(df: DataFrame, key: str, size: int | None = None, after=None, descending: bool = False) -> DataFrame:
    """One page in order of a unique key, with has_next and next_cursor on each row.

    One row more than the page is taken, by a top-n that every task runs on its
    own rows; the window that follows sees that many rows only.
    """
    size = page_size(size)
    column = F.col(key)
    if after is not None:
        df = df.where(column < after if descending else column > after)
    order = column.desc() if descending else column.asc()
    ahead = df.orderBy(order).limit(size + 1)
    whole = Window.partitionBy()
    ranked = ahead.withColumn("__rn", F.row_number().over(Window.orderBy(order)))
    ranked = ranked.withColumn("has_next", F.max("__rn").over(whole) > size)
    ranked = ranked.withColumn("next_cursor", F.when(F.col("has_next"), F.max(F.when(F.col("__rn") == size, column)).over(whole)))
    return ranked.where(F.col("__rn") <= size).drop("__rn")
