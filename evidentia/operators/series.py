"""Time series: increases, changes, quantiles of histograms, trends, alerts that hold for a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import runs_of


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _celled(df: DataFrame, at: str, seconds: int) -> DataFrame:
    """Adds ``__us`` and the time cell ``__cell`` of each row, as long as the window: no window over (series, cell) grows with the length of a series."""
    us = _micros(at)
    return df.withColumn("__us", us).withColumn("__cell", F.floor(us / (seconds * 1_000_000)))


def _previous(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``__before``, the value of the row before in the series, to rows with a ``__cell``.

    Within a cell it is the row before.  The first row of a cell gets the last value of
    the cell before that has rows: that is carried over one row a cell.
    """
    cell = [*by, "__cell"]
    last = rows.groupBy(*cell).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__v"))
    carried = last.withColumn("__c", F.lag("__v").over(Window.partitionBy(*by).orderBy("__cell"))).drop("__v")
    w = Window.partitionBy(*cell).orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(w)).withColumn("__w", F.lag(value).over(w))
    keys = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(cell)]
    carried = carried.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cell)], "__c")
    rows = rows.join(carried, keys, "left").withColumn("__before", F.when(F.col("__n") == 1, F.col("__c.v")).otherwise(F.col("__w")))
    return rows.drop(*[f"__k{i}" for i in range(len(cell))], "__c", "__n", "__w")


def _sum_of_last(rows: DataFrame, by: list[str], seconds: int, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the last seconds to rows with a ``__cell``.

    A window is the end of the cell before and the beginning of its own.  Both are running
    sums, the one backwards, so that a row costs the same however many rows its window
    has; a sliding frame adds all of them up for each row anew.  For the one, each row
    stands in the next cell too, a window later, where it is no row of its own.
    """
    span = seconds * 1_000_000
    seen = rows.withColumn("__next", F.explode(F.array(F.lit(0), F.lit(1))))
    seen = seen.withColumn("__cell", F.col("__cell") + F.col("__next")).withColumn("__us", F.col("__us") + F.col("__next") * F.lit(span))
    cell = Window.partitionBy(*by, "__cell")
    so_far = lambda order: cell.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("__end", F.sum(F.when(F.col("__next") == 1, F.col(value))).over(so_far(F.desc("__us"))))
    seen = seen.withColumn("__begin", F.sum(F.when(F.col("__next") == 0, F.col(value))).over(so_far(F.asc("__us"))))
    total = F.coalesce(F.col("__end") + F.col("__begin"), "__end", "__begin")
    return seen.where("__next = 0").withColumn(name, total).drop("__next", "__end", "__begin")


def increase(df: DataFrame, by: list[str], at: str, tie: str, value: str, seconds: int) -> DataFrame:
    """Adds the increase of a counter over the last seconds; a fall means that it started again at zero.

    A series is dealt into time cells: however many rows one series has, they are many
    tasks' work.  Rows without a time have no increase.
    """
    before = F.col("__before")
    delta = F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    rows = _previous(_celled(df.where(F.col(at).isNotNull()), at, seconds), by, [at, tie], value).withColumn("__delta", delta)
    rows = _sum_of_last(rows, by, seconds, "__delta", "increase").select(*df.columns, "increase")
    return rows.unionByName(df.where(F.col(at).isNull()).withColumn("increase", F.lit(None).cast("double")))


def changes(df: DataFrame, by: list[str], at: str, tie: str, value: str, seconds: int) -> DataFrame:
    """Adds how often a value changed in the last seconds; series are dealt into time cells as for ``increase``."""
    changed = (F.col(value) != F.col("__before")).cast("int")
    rows = _previous(_celled(df.where(F.col(at).isNotNull()), at, seconds), by, [at, tie], value).withColumn("__delta", changed)
    rows = _sum_of_last(rows, by, seconds, "__delta", "changes").withColumn("changes", F.coalesce("changes", F.lit(0)).cast("long"))
    return rows.select(*df.columns, "changes").unionByName(df.where(F.col(at).isNull()).withColumn("changes", F.lit(0).cast("long")))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float, name: str) -> DataFrame:
    """Linear within the first bucket that reaches q of all; in the last, unbounded one, its lower bound.

    ``buckets`` has le and the cumulative n; there are a few bounds a series.
    """
    w = Window.partitionBy(*by).orderBy("le")
    rows = buckets.withColumn("__c0", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("__l0", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    rows = rows.withColumn("__all", F.max("n").over(Window.partitionBy(*by)))
    reached = rows.where(F.col("n") >= F.lit(q) * F.col("__all"))
    first = reached.groupBy(*by).agg(F.min_by(F.struct("le", "n", "__c0", "__l0", "__all"), "le").alias("b")).select(*by, "b.*")
    inside = F.col("__l0") + (F.col("le") - F.col("__l0")) * (F.lit(q) * F.col("__all") - F.col("__c0")) / F.nullif(F.col("n") - F.col("__c0"), F.lit(0))
    value = F.when(F.col("le") == float("inf"), F.col("__l0")).otherwise(F.coalesce(inside, "le"))
    return first.select(*by, value.alias(name))


def predict_linear(df: DataFrame, by: list[str], at: str, value: str, ahead: int, name: str, origin: int = 1_704_067_200) -> DataFrame:
    """A least-squares line through the values, read ``ahead`` seconds after the last; times count from ``origin``, which keeps digits."""
    rows = df.select(*by, (_micros(at) / 1e6 - origin).alias("__s"), F.col(value).alias("__v"))
    fit = rows.groupBy(*by).agg(F.regr_slope("__v", "__s").alias("a"), F.regr_intercept("__v", "__s").alias("b"), F.max("__s").alias("m"))
    return fit.select(*by, (F.col("b") + F.col("a") * (F.col("m") + ahead)).alias(name))


def matches(label: str, pattern: str) -> Column:
    """A label matcher: the pattern covers the whole value."""
    return F.col(label).rlike(f"^(?:{pattern})$")


def alert_states(df: DataFrame, by: list[str], order: list[str], at: str, condition: str, seconds: int) -> DataFrame:
    """inactive, pending, or firing once the condition has held for the time."""
    rows = runs_of(df, by, order, condition, "__run")
    since = F.min(at).over(Window.partitionBy(*by, "__run"))
    long_enough = _micros(at) - F.unix_micros(since.cast("timestamp")) >= seconds * 1_000_000
    state = F.when(~F.col(condition), "inactive").when(long_enough, "firing").otherwise("pending")
    return rows.withColumn("state", state).drop("__run")
