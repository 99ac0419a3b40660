"""The reports of the three evaluations, as rows.

A report is a frame of (section, line, key, cells): line 0 of a section is its head,
the others follow in order of line and key.  What counts is worked out over all items where they
lie, written once as every section reads them; lists of single items (failures) may be as long as the evaluation, so reports
are written by ``sources.sinks.write_report``, not gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..engine.kept import kept
from ..functions.reporting import NOTHING, percent, ratio
from .statistics import clamped_histogram, floor_percentile

KINDS = ("answerable", "abstain")


def _cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NOTHING))


def _sortable(rows: DataFrame, *columns: str) -> Column:
    """Text that sorts as the columns do."""
    whole = lambda c: isinstance(rows.schema[c].dataType, IntegralType)
    return F.concat_ws(" ", *[F.format_string("%020d", F.col(c).cast("long")) if whole(c) else F.col(c).cast("string") for c in columns])


def summary(totals: DataFrame, section: str, head: list[str], rows: list[tuple[str, ...]]) -> DataFrame:
    """A section of fixed lines from one row of totals: each line a label and the names of columns."""
    lines = [F.array(*map(F.lit, head)), *[F.array(F.lit(label), *[_cell(F.col(c)) for c in columns]) for label, *columns in rows]]
    return totals.select(F.lit(section).alias("section"), F.posexplode(F.array(*lines)).alias("line", "cells")).select("section", F.col("line").cast("long").alias("line"), F.lit("").alias("key"), "cells")


def listing(rows: DataFrame, section: str, head: list[str], columns: list[Column], order: str) -> DataFrame:
    """A section with a line a row, in order of ``order``: all are line 1, told apart by a key that sorts as text."""
    key = _sortable(rows, order)
    title = rows.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("line"), F.lit("").alias("key"), F.array(*map(F.lit, head)).alias("cells"))
    return title.unionByName(rows.select(F.lit(section).alias("section"), F.lit(1).cast("long").alias("line"), key.alias("key"), F.array(*map(_cell, columns)).alias("cells")))


def _of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rate(hit: Column, of: Column) -> Column:
    return ratio(F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)))


def _mrr(rank: Column, k: int, of: Column) -> Column:
    return ratio(F.coalesce(F.sum(F.when(of & (rank <= k), 1.0 / rank).otherwise(0.0)) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)))


def retrieval_report(items: DataFrame, k: int = 5, pool: int = 30) -> DataFrame:
    """Ranks and gates of all items.

    ``items``: item_id, question, kind, vector_rank, keyword_rank, reranked_rank (of the first
    hit, null for none), top_distance, top_relevance, top_guideline, and gate: what
    abstained, distance or score, null for an answer.
    """
    items = kept(items, "report")
    answerable, v, w, r = F.col("kind") == "answerable", F.col("vector_rank"), F.col("keyword_rank"), F.col("reranked_rank")
    gate, far = F.col("gate").isNotNull(), F.col("gate") == "distance"
    far = F.coalesce(far, F.lit(False))
    found = lambda rank, k: F.coalesce(rank <= k, F.lit(False))
    totals = items.agg(
        F.count_if(answerable).alias("answerable"), F.count_if(~answerable).alias("abstain"), _rate(found(v, k), answerable).alias("recall"), _mrr(v, k, answerable).alias("mrr"),
        _rate(found(v, pool), answerable).alias("recall_pool"), _rate(found(w, pool), answerable).alias("keyword"), _rate(found(v, pool) | found(w, pool), answerable).alias("union"),
        _rate(found(r, k), answerable).alias("reranked"), _mrr(r, k, answerable).alias("reranked_mrr"), _rate(gate, ~answerable).alias("abstained"), _rate(gate, answerable).alias("over"),
        _rate(far, ~answerable).alias("far_abstained"), _rate(far, answerable).alias("far_over"),
    )
    known = items.where(F.col("top_distance") < float("inf"))
    quantiles = floor_percentile(known, ["kind"], "top_distance", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).join(known.groupBy("kind").agg(F.count("*").alias("n")), "kind")
    fixed = lambda c: ratio(F.col(c), 4)
    bins = [
        clamped_histogram(items.where(F.col("kind") == kind), F.col("top_relevance"), 0, 10).groupBy(F.lit(kind).alias("kind")).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b")) for kind in KINDS
    ]
    relevance = _of(bins).select("kind", *[F.col("b")[i]["n"].alias(f"b{i}") for i in range(11)])
    failed = items.where(answerable & ~found(v, k))
    return _of([
        summary(totals, "items", ["kind", "items"], [("answerable", "answerable"), ("abstain", "abstain")]),
        summary(totals, "ranks", ["measure", "value"], [(f"recall@{k}", "recall"), (f"mrr@{k}", "mrr"), (f"recall@{pool}", "recall_pool")]),
        summary(totals, "candidates", ["measure", "value"], [("keyword recall", "keyword"), ("union coverage", "union")]),
        summary(totals, "reranked", ["measure", "value"], [(f"recall@{k}", "reranked"), (f"mrr@{k}", "reranked_mrr"), ("abstain recall", "abstained"), ("over-abstain", "over")]),
        summary(totals, "distance gate", ["measure", "value"], [("abstain recall", "far_abstained"), ("over-abstain", "far_over")]),
        listing(quantiles, "top distances", ["kind", "items", "p10", "p50", "p90"], [F.col("kind"), F.col("n"), fixed("p10"), fixed("p50"), fixed("p90")], "kind"),
        listing(failed, "not found", ["item", "question", "vector rank", "keyword rank"], [F.col("item_id"), F.col("question"), v, w], "item_id"),
        listing(relevance, "relevance", ["kind", *map(str, range(11))], [F.col("kind"), *[F.col(f"b{i}") for i in range(11)]], "kind"),
        listing(items.where(~answerable & ~gate), "answered wrongly", ["item", "question", "top distance", "relevance", "guideline"], [F.col("item_id"), F.col("question"), fixed("top_distance"), F.col("top_relevance"), F.col("top_guideline")], "item_id"),
        listing(items.where(answerable & gate), "abstained wrongly", ["item", "question", "gate", "top distance", "relevance", "rank"],
                [F.col("item_id"), F.col("question"), F.col("gate"), F.when(F.col("top_distance") < float("inf"), fixed("top_distance")), F.col("top_relevance"), v], "item_id"),
    ])


def groundedness_report(items: DataFrame) -> DataFrame:
    """Verdicts and claims of all answers.

    ``items``: item_id, verdict, claims, supported, miscited, unsupported, examples (of
    claims without support), miscited_examples, answer_chars, markdown, no_marker,
    disclosed; and stage and reason where generating or judging failed.  Answers are
    counted by what was generated, verdicts by what was judged.
    """
    items = kept(items, "report")
    judged, made = F.col("verdict").isNotNull(), F.col("answer_chars").isNotNull()
    verdicts = ("grounded", "partial", "ungrounded")
    whole = lambda c: F.coalesce(F.sum(F.when(judged, F.col(c))), F.lit(0))
    mean = lambda c, of: F.coalesce(F.round(F.sum(F.when(of, F.col(c))) / F.nullif(F.count_if(of), F.lit(0)), 2), F.lit(0.0))
    totals = items.agg(
        F.count("*").alias("items"), F.count_if(judged).alias("judged"), *[F.count_if(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(v) for v in verdicts],
        *[whole(c).alias(c) for c in ("claims", "supported", "miscited", "unsupported")], F.count_if(made & F.col("markdown")).alias("markdown"), F.count_if(made & F.col("no_marker")).alias("no_marker"),
        mean("claims", judged).alias("mean_claims"), mean("answer_chars", made).alias("mean_chars"), F.count_if(judged & F.col("disclosed")).alias("disclosed"),
    )
    shares = {f"{c}_share": percent(F.col(c), F.col(of)) for of, names in (("judged", verdicts), ("claims", ("supported", "miscited", "unsupported"))) for c in names}
    totals = totals.withColumns(shares | {"none": F.lit(NOTHING)})
    flagged = items.where(judged & (F.col("verdict") != "grounded"))
    shown = lambda c: F.coalesce(F.nullif(F.array_join(c, " / "), F.lit("")), F.lit(NOTHING))
    return _of([
        summary(totals, "verdicts", ["verdict", "items", "share"], [(v, v, f"{v}_share") for v in verdicts]),
        summary(totals, "claims", ["claims", "count", "share"], [("all", "claims", "none"), *[(c, c, f"{c}_share") for c in ("supported", "miscited", "unsupported")]]),
        summary(totals, "mechanical", ["check", "answers"], [("markdown", "markdown"), ("no marker", "no_marker")]),
        summary(totals, "suppression", ["measure", "value"], [("claims an answer", "mean_claims"), ("characters an answer", "mean_chars"), ("insufficiency disclosed", "disclosed")]),
        listing(flagged, "flagged", ["item", "verdict", "miscited", "unsupported", "without support", "miscited claims"],
                [F.col("item_id"), F.col("verdict"), F.col("miscited"), F.col("unsupported"), shown("examples"), shown("miscited_examples")], "item_id"),
        listing(items.where(F.col("reason").isNotNull()), "failures", ["item", "stage", "reason"], [F.col("item_id"), F.col("stage"), F.col("reason")], "item_id"),
    ])


def guidance_report(cases: DataFrame, most_seconds: float = 20.0) -> DataFrame:
    """Structured guidance of all cases.

    ``cases``: item_id, label, expectation (the group it is judged with), outcome (structured,
    fallback or skipped), fields (on record), produced, accepted, seconds (null where no
    call was made), titles, and reason where the case failed.  Cases without any field
    on record must fall back; they do not count in the fallback rate.
    """
    cases = kept(cases, "report")
    bare, outcome = F.size("fields") == 0, F.col("outcome")
    ended = F.col("reason").isNull()
    totals = cases.agg(
        F.count("*").alias("cases"), *[F.count_if(ended & (outcome == o)).alias(o) for o in ("structured", "fallback", "skipped")], F.coalesce(F.sum("produced"), F.lit(0)).alias("produced"),
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"), F.count_if(ended & ~bare & (outcome == "fallback")).alias("fell"), F.count_if(ended & ~bare & outcome.isin("structured", "fallback")).alias("rated"),
        F.count_if(ended & bare & (outcome == "structured")).alias("violations"),
    )
    all_ = F.col("structured") + F.col("fallback") + F.col("skipped")
    totals = totals.withColumns({f"{o}_share": percent(F.col(o), all_) for o in ("structured", "fallback", "skipped")} | {"pass": percent(F.col("accepted"), F.col("produced")), "fell_share": percent(F.col("fell"), F.col("rated"))})
    took = floor_percentile(cases.withColumn("__whole", F.lit("")), ["__whole"], "seconds", {"p50": 0.5, "p90": 0.9, "most": 1.0})
    fixed = lambda c: ratio(F.col(c), 2)
    return _of([
        summary(totals, "outcomes", ["outcome", "cases", "share"], [(o, o, f"{o}_share") for o in ("structured", "fallback", "skipped")]),
        summary(totals, "fallback rate", ["fell back", "of", "share", "structured without record"], [("rate", "fell", "rated", "fell_share", "violations")]),
        summary(totals, "two legs", ["measure", "value"], [("produced", "produced"), ("accepted", "accepted"), ("share", "pass")]),
        listing(took, "seconds", ["p50", "p90", "most", "limit"], [fixed("p50"), fixed("p90"), fixed("most"), ratio(F.lit(most_seconds), 2)], "__whole"),
        listing(cases.where(ended).withColumn("__at", _sortable(cases, "expectation", "item_id", "label")), "cases", ["group", "item", "case", "outcome", "fields", "produced", "accepted", "titles"],
                [F.col("expectation"), F.col("item_id"), F.col("label"), outcome, F.array_join("fields", ", "), F.col("produced"), F.col("accepted"), F.array_join("titles", " / ")], "__at"),
        listing(cases.where(~ended), "failures", ["item", "case", "reason"], [F.col("item_id"), F.col("label"), F.col("reason")], "item_id"),
    ])
