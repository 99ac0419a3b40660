"""Mixing sources to target weights.

A document's size is its number of white-space separated words.  Sources get
a share of the total size in proportion to their weights, but at most
``MOST`` times their own size; what that cuts off is shared again by weight
among the others (water filling).  A source's repetition rate is its target
over its size.  Each document is taken floor(rate) times, plus one more time
with probability rate - floor(rate).

The extra copies are hash-seeded Bernoulli draws: a document's draw is a number in
[0, 1) that depends on its id, its size and a seed alone, and it is taken if
that is below the probability.  One seed leaves the words of a source far
from the target where the source has few documents, or a few very long ones; so the
draws are made for SEEDS seeds in one pass, words are summed by source and seed,
and each source takes the seed whose words come nearest to its target.  Every
choice is a sum by source: no document waits for another.

Defined cases: a null text has size 0, as an empty one; a null source is a
source of its own, last in order; a table without words has rate 0
throughout; repeated rows are rows of their own, which draw alike; extra
columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20240607
#: Seeds that a source chooses from, and how many draws of 32 bits a digest holds.
SEEDS, DRAWS = 32, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source, n_docs, source_size, target, rate.

    Water filling in closed form: with sources in order of most * size / weight,
    a source is capped while its own ratio is at most the level that the sources
    from it on would get.  The windows run over one row a source, in one task.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("double") for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(most).cast("double")
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(onward))
    free = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)  # falls from the first free source on
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.coalesce(free, F.lit(0.0)) * F.col("weight"))
    return per.withColumn("target", F.least(target, F.col("cap"))).select(
        "source", "n_docs", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def draws(*cols: Column, seed: int = SEED, seeds: int = SEEDS) -> Column:
    """An array of one number in [0, 1) for each seed, of the values alone."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    digests = [F.md5(F.concat(F.lit(f"{seed + k}|"), key)) for k in range(-(-seeds // DRAWS))]
    part = lambda s: F.conv(F.substring(digests[s // DRAWS], 8 * (s % DRAWS) + 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.array(*[part(s) for s in range(seeds)])


def copies(sizes: DataFrame, targets: DataFrame, seed: int = SEED, seeds: int = SEEDS) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source, size; needs a frame that can be read twice."""
    a, b = sizes.alias("a"), targets.alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target", "b.rate")
    part = F.col("rate") - F.floor("rate")
    rows = rows.withColumn("draws", draws(F.col("doc_id"), F.col("size"), seed=seed, seeds=seeds))
    short = F.max("target") - F.max(F.floor("rate")) * F.max("source_size")  # what the whole copies leave
    words = [F.sum(F.when(F.col("draws")[s] < part, F.col("size")).otherwise(0)).alias(f"w{s}") for s in range(seeds)]
    sums = rows.groupBy("source").agg(short.alias("short"), *words)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{s}") - F.col("short")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))
    chosen = sums.select("source", best["seed"].alias("seed"))
    rows = rows.alias("r").join(chosen.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", "c.seed")
    extra = (F.element_at("draws", F.col("seed") + 1) < part).cast("long")
    return rows.withColumn("copies", (F.floor("rate") + extra).cast("int")).drop("draws", "seed", "rate")


def mix_sources(docs: DataFrame) -> DataFrame:
    """The documents in their new proportions: the same columns, each row as often as it is taken.

    Needs columns doc_id, text and source.
    """
    sizes = C.stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    n = copies(sizes, source_targets(sizes)).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    size, times, copy = C.spare(docs, "size_", "times", "copy")
    names = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.withColumn(size, word_count(F.col("text"))).alias("d")
    kept = d.join(
        n.where("copies > 0").alias("n"),
        F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("d.source").eqNullSafe(F.col("n.source")) & (F.col(f"d.{size}") == F.col("n.size")),
    )
    # rows alike in id, source and size share their copies: each is emitted its equal part, rounded up for the first ones
    alike = Window.partitionBy("d.doc_id", "d.source", f"d.{size}").orderBy(F.xxhash64("d.text"))
    share = F.floor((F.col("n.copies") + F.col("n.rows") - F.row_number().over(alike)) / F.col("n.rows"))
    share = F.when(F.col("n.rows") == 1, F.col("n.copies")).otherwise(share)
    kept = kept.select(*[F.col(f"d.`{c}`") for c in docs.columns], share.cast("int").alias(times))
    return kept.select(*names, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(copy)).select(*names)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, in words."""
    docs = C.table(spark, sf_dir, "documents")
    sizes = C.stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = copies(sizes, source_targets(sizes))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = {
    "op8_mixing": r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM per),
-- shares are dealt in rounds: whoever is above the limit is set to it, and the rest is dealt again
fill AS (
  SELECT 0 AS round, source, n_docs, source_size, weight, false AS capped,
         (SELECT sum(source_size) FROM per)::DOUBLE * weight / (SELECT sum(weight) FROM ranked) AS share FROM ranked
  UNION ALL
  SELECT round + 1, source, n_docs, source_size, weight, now_capped,
         CASE WHEN now_capped THEN 3.0 * source_size ELSE
           ((SELECT sum(source_size) FROM per)::DOUBLE - sum(CASE WHEN now_capped THEN 3.0 * source_size ELSE 0 END) OVER ())
           * weight / nullif(sum(CASE WHEN now_capped THEN 0 ELSE weight END) OVER (), 0) END
  FROM (SELECT *, capped OR share > 3.0 * source_size AS now_capped FROM fill) WHERE round < 60),
targets AS (SELECT *, share AS target, CASE WHEN source_size > 0 THEN share / source_size ELSE 0 END AS rate FROM fill WHERE round = 60),
rows AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.rate, t.rate - floor(t.rate) AS p,
         list_transform(range(32), lambda k: ('0x' || substr(md5((20240607 + k // 4) || '|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.size), 8 * (k % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS draws
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
sums AS (
  SELECT source, k, abs(sum(CASE WHEN draws[k + 1] < p THEN size ELSE 0 END) - (max(target) - max(floor(rate)) * max(source_size))) AS off FROM rows, (SELECT unnest(range(32)) AS k) GROUP BY source, k),
chosen AS (SELECT source, arg_min(k, (off, k)) AS k FROM sums GROUP BY source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (floor(rate) + CASE WHEN draws[k + 1] < p THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows JOIN chosen ON rows.source IS NOT DISTINCT FROM chosen.source"""
}


def _op8_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing(spark, sf_dir).withColumn("target", F.round("target", 6))


QUERIES = {"op8_mixing": _op8_rounded}
