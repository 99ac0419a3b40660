"""Interaction audit of document filters: what each filter removes in every order of application.

Each document fails some of the filters; which ones is a bit mask.  Documents
are counted by part, mask and labels, so that all that follows works on a few
cells a part (2 to the power of the filters at most), however many documents
there are.  A cell is unpivoted against the steps of every order.  Along an
order a running bit-or over the filters that the mask fails tells whether an
earlier step has removed the documents already; conditional sums over the
cells make a step's counts, and a total over the windows of a filter adds up
what it removes in all orders (its Shapley value times the number of orders).

Conditions stand on measures of whole texts, taken in one pass of the text as
bytes (words are cut at ASCII white space, as is said below).  Repeats need
no join with the documents: rows are first counted by text digest, part and
labels, and of each text all rows but those of its smallest id are repeats.
So a text with millions of copies is a row a part by the time it is shuffled.

Defined cases: a null text is empty; a null source is the part ''; a word is
a maximal run of other characters than space and U+0009 to U+000D; a document
without an id repeats none and is repeated by none, and has no labels; rows
that share an id and a text repeat one another not, as no id is smaller; of
several label rows of an id the largest labels count, a null label is 0; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SPECIAL = b"#$%&*|"
#: The filters in the order of their bits: when a document fails, from its measures and whether it repeats an earlier one.
FILTERS = {
    "A": "words < 50",
    "B": "100 * distinct_words < 65 * words",
    "C": "100 * upper > 5 * chars",
    "D": "special > 0",
    "E": "repeats",
}
MEASURES = "doc_id long, part string, digest binary, words long, distinct_words long, upper long, chars long, special long"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the measures that conditions stand on, for each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            rows = {"digest": [], "words": [], "distinct_words": [], "upper": [], "special": []}
            for t in texts.cast(pa.binary()).to_pylist():
                words = t.split()  # bytes are cut at ASCII white space only: 0x20 and 0x09 to 0x0D
                rows["digest"].append(hashlib.sha256(t).digest()[:16])
                rows["words"].append(len(words))
                rows["distinct_words"].append(len(set(words)))
                rows["upper"].append(len(t) - len(t.translate(None, UPPER)))
                rows["special"].append(len(t) - len(t.translate(None, SPECIAL)))
            cols = [pa.array(rows["digest"], pa.binary()), *(pa.array(rows[k], pa.int64()) for k in ("words", "distinct_words", "upper"))]
            cols = [batch.column(0), batch.column(1), *cols, pc.utf8_length(texts).cast(pa.int64()), pa.array(rows["special"], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in MEASURES.split(", ")])

    part, text = F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, text).mapInArrow(run, MEASURES)


def mask_of(filters: dict[str, str]) -> Column:
    """The bits of the filters whose conditions hold; a condition that is null does not."""
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())]
    return sum(bits[1:], bits[0])


def mask_cells(measured: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just the filters of the mask, and how many of them are labelled so.

    ``measured`` has columns doc_id, part and digest beside those that conditions name;
    conditions may name ``repeats`` too.
    """
    # the mask of a row that repeats no other, and that of one that does; which of them holds is known once copies are counted
    known = measured.withColumn("repeats", F.lit(False)).withColumn("first", mask_of(filters))
    known = known.withColumn("repeats", F.lit(True)).withColumn("again", mask_of(filters))
    rows = known.groupBy("doc_id", "part", "digest", "first", "again").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("at")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # rows without an id have no labels: they are spread by their text instead of meeting in one task
    named = F.col("doc_id").isNotNull()
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.xxhash64("digest")), "named": named})
    rows = rows.join(marks.withColumn("named", F.lit(True)), ["at", "named"], "left")
    keys = ["digest", "part", "first", "again", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    copies = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("n_free")
    )
    copies = copies.withColumn("lowest", F.min("low").over(Window.partitionBy("digest")))
    copies = copies.withColumn("firsts", F.col("n_free") + F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0))
    both = F.array(F.struct(F.col("first").alias("mask"), F.col("firsts").alias("n")), F.struct(F.col("again").alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    cells = copies.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic"))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step of the filters named by ``letters``, one letter a bit.

    Everything about a part lies in one task: it is a few cells times the orders.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    long = cells.repartition("part").select("*", F.explode(orders).alias("filter_order"))
    long = long.select("*", F.explode(steps).alias("step"))
    long = long.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, locate(letter, '{letters}') - 1)")).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    gone, now = F.col("earlier") != 0, F.col("fails") != 0
    of = lambda cond, what="n": F.sum(F.when(cond, F.col(what)).otherwise(0))
    rows = long.groupBy("part", "filter_order", "step", "letter").agg(
        of(~gone & ~now).alias("kept"), of(~gone & now).alias("removed"), of(gone & now).alias("redundant"), of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(~gone & now, "good").alias("good_lost"), of(~gone & now, "toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the five filters removes from each source, in all 120 orders."""
    cells = mask_cells(measures(C.table(spark, sf_dir, "documents")), C.table(spark, sf_dir, "labels"))
    return audit(cells, "".join(FILTERS))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lowest FROM documents),
fails AS (
  SELECT doc_id, part,
         (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lowest, false)::INT AS mask FROM d),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
steps AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit,
         unnest([0, a.bit, a.bit | b.bit, a.bit | b.bit | c.bit, a.bit | b.bit | c.bit | d.bit]) AS before
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""
}
