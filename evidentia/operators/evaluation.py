"""Measures of retrieval and of the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS, STATES, ORIGINS = ("answerable", "abstain"), ("candidate", "approved", "rejected"), ("reverse-generated", "manual")


def approved(items: DataFrame) -> DataFrame:
    """Items that are approved, after a check of all; a bad one fails the job and is named."""
    rules = {
        "kind": F.col("kind").isin(*KINDS), "status": F.col("status").isin(*STATES), "origin": F.col("origin").isin(*ORIGINS),
        "id": F.trim("id") != "", "question": F.trim("question") != "",
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    said = F.concat(F.lit("item "), F.coalesce("id", F.lit("?")), F.lit(": "), F.array_join(broken, ", "))
    status = F.when(F.size(broken) > 0, F.raise_error(said).cast("string")).otherwise(F.col("status"))
    return items.withColumn("status", status).where("status = 'approved'")


def recall_mrr(found: DataFrame, questions: DataFrame, ks: tuple[int, ...], mrr_at: int) -> DataFrame:
    """Share of questions with a hit among the first k, and the mean reciprocal rank of the first hit."""
    first = found.groupBy("question_id").agg(F.min(F.when(F.col("hit"), F.col("vector_rank"))).alias("r"))
    rows = questions.select("question_id").join(first, "question_id", "left")
    r = F.col("r")
    recall = [F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks]
    return rows.agg(*recall, F.round(F.avg(F.when(r <= mrr_at, 1.0 / r).otherwise(0.0)), 6).alias(f"mrr_{mrr_at}"))


def gate_confusion(rows: DataFrame) -> DataFrame:
    """How often the gates abstain where they should and where they should not, and which gate it was."""
    should, d, s = F.col("should_abstain"), F.col("by_distance"), F.col("by_score")
    rate = lambda hit, of: F.coalesce(F.round(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), 6), F.lit(0.0))
    return rows.agg(
        rate(d, should).alias("distance_recall"), rate(d, ~should).alias("distance_over"), rate(d | s, should).alias("combined_recall"), rate(d | s, ~should).alias("combined_over"),
        F.count_if(d & ~s).alias("cause_distance"), F.count_if(s & ~d).alias("cause_score"), F.count_if(d & s).alias("cause_both"),
    )


def resolve(keys: DataFrame, chunks: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Labels resolved to chunks by stable key, compared as written, and the keys that resolve to nothing.

    The caller scores only if the second frame is empty.
    """
    return keys.join(chunks, on).select("item", "chunk_id"), keys.join(chunks, on, "left_anti").select("item", *on)
