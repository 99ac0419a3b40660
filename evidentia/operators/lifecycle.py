"""Record lifecycle as functions from the old frame (and changes) to the new one.

Files have no row-level updates: a change is a new version of the frame,
written to a new directory and committed by that write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key; of several new ones the last in sort order of all columns wins."""
    one = new.groupBy(*key).agg(F.max(F.struct(*[c for c in new.columns if c not in key])).alias("__v")).select(*key, "__v.*").select(*old.columns)
    return old.join(one.select(*key), key, "left_anti").unionByName(one)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition holds; ``affected`` says where."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()} | {"affected": hit})


def optimistic(old: DataFrame, changes: DataFrame, key: str, version: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Applies the changes that expect the row's version; the others come back as conflicts."""
    want = changes.select(F.col(key), F.col(version).alias("__expected"), *[F.col(c).alias(f"__{c}") for c in columns])
    got = old.join(want, key, "left")
    fits = F.coalesce(F.col("__expected") == F.col(version), F.lit(False))
    new = got.select(*[
        F.when(fits, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns
        else F.when(fits, F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == version else F.col(c)
        for c in old.columns
    ])
    conflicts = changes.join(old.select(key, F.col(version).alias("__now")), key, "left").where(~F.coalesce(F.col("__now") == F.col(version), F.lit(False))).select(*changes.columns)
    return new, conflicts


def soft_deleted(df: DataFrame, condition: Column, at: Column, column: str = "deleted_at") -> DataFrame:
    """Marks rows as deleted; a time that is there already stays."""
    return df.withColumn(column, F.when(condition, F.coalesce(F.col(column), at)).otherwise(F.col(column)))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, column: str = "deleted_at") -> DataFrame:
    """Children of deleted parents are deleted at the same time, unless they were before."""
    gone = parents.where(F.col(column).isNotNull()).select(F.col(parent_key).alias(child_key), F.col(column).alias("__at"))
    got = children.join(gone, child_key, "left")
    return got.withColumn(column, F.coalesce(column, "__at")).select(*children.columns)


def purged(tables: dict[str, DataFrame], roots: DataFrame, edges: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Removes rows and all that hangs on them, children first.

    ``roots`` holds the keys to remove from the first parent; ``edges`` are
    (parent, its key, child, the child's reference) from the roots down.
    """
    doomed = {edges[0][0]: (edges[0][1], roots)}
    for parent, key, child, ref in edges:
        pk, gone = doomed[parent]
        lost = gone.select(F.col(pk).alias(ref)) if pk == key else tables[parent].join(gone, pk, "left_semi").select(F.col(key).alias(ref))
        doomed[child] = (ref, lost.distinct())
    return {name: df.join(doomed[name][1], doomed[name][0], "left_anti") if name in doomed else df for name, df in tables.items()}


def detached(df: DataFrame, keys: DataFrame, ref: str) -> DataFrame:
    """Rows that point to removed keys stay, pointing to nothing."""
    gone = keys.select(F.col(keys.columns[0]).alias(ref), F.lit(True).alias("__gone"))
    return df.join(gone, ref, "left").withColumn(ref, F.when(F.col("__gone").isNull(), F.col(ref))).select(*df.columns)


def finalised(status: Column, failed: Column) -> Column:
    """The end of a job: a cancellation in progress beats completion, ended jobs stay as they are."""
    return F.when(status == "CANCELLING", "CANCELLED").when((status == "RUNNING") & (failed > 0), "COMPLETED_WITH_ERRORS").when(status == "RUNNING", "COMPLETED").otherwise(status)


def superseded(versions: DataFrame, key: list[str], revision: str) -> DataFrame:
    """Of each key the highest revision is ACTIVE, the others SUPERSEDED; a null in a key is a value of its own."""
    top = versions.groupBy(*key).agg(F.max(revision).alias("__top")).select(*[F.col(k).alias(f"__{k}") for k in key], "__top")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    rows = versions.join(top, same, "left")
    return rows.select(*versions.columns, F.when(F.col(revision) == F.col("__top"), "ACTIVE").otherwise("SUPERSEDED").alias("status"))


def claimed(attempts: DataFrame, token: str, at: str, order: list[str], expires: str | None = None) -> DataFrame:
    """Adds ``outcome`` to attempts at tokens that can be used once: the first in order of time is accepted.

    Rivals at the same instant are told apart by ``order``.  Attempts after the token's
    expiry are expired and consume nothing; those without a token are unknown; one
    attempt, known by all its columns in ``order``, is accepted again if it is repeated.
    The first of each token is an aggregate, which is joined back, so a token
    that many try meets in no window.
    """
    live = F.lit(True) if expires is None else F.coalesce(F.col(at) < F.col(expires), F.lit(True))
    place = F.struct(at, *order)
    rows = attempts.withColumn("__live", live & F.col(at).isNotNull())
    first = rows.where(F.col("__live")).groupBy(F.col(token).alias("__token")).agg(F.min(place).alias("__first"))
    rows = rows.join(first, F.col(token) == F.col("__token"), "left")
    outcome = F.when(F.col(token).isNull(), "unknown").when(~F.col("__live"), "expired").when(place == F.col("__first"), "accepted").otherwise("consumed")
    return rows.select(*attempts.columns, outcome.alias("outcome"))


def assert_at_most_one(df: DataFrame, active: Column) -> DataFrame:
    """One row: how many are active and whether that is allowed."""
    return df.agg(F.count_if(active).alias("n_active")).withColumn("ok", F.col("n_active") <= 1)


def reused_families(events: DataFrame, family: str, token: str, at: str) -> DataFrame:
    """family, revoked: a token used again after it was rotated revokes its whole family."""
    uses = events.groupBy(family, token).agg(F.count("*").alias("n"))
    return uses.groupBy(family).agg(F.bool_or(F.col("n") > 1).alias("revoked"))
