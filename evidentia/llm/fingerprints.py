"""Closed-syncmer fingerprints, in DataFrame functions only.

A text is cut into units: words are cut into pieces of up to four
characters, and characters of scripts that write without blanks stand alone.
The rule is the same for all lengths.  A run of K units is an anchor if the
smallest hash among its inner runs of S units stands at one of its two edges.
Whether a run is an anchor depends on its own units alone, so the anchors of a
passage are the same in any text, and at the same distances: they are matched
by position.  What counts as common to two texts is an anchor together with
the distance to the next one, so that scattered runs alone make no likeness.

Texts too short for several anchors would be all or nothing; so of every text,
however long, the pairs of characters among its first HEAD ones are marks too, each
with its place.  They weigh much in short texts and little in long ones.

The likeness is the Jaccard index of all these marks of both texts; the
fingerprint, as an id, lists the SKETCH smallest of their hashes (all, if
fewer), from which the same index can be estimated within about 0.04.

Defined cases: a null text counts as empty; a text without any anchor, like
one of fewer than K units, has its whole as the one anchor; equal texts have
equal fingerprints; repeated ids are taken in order of text hash; rows without
an id come last; extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

K, S = 5, 2
#: Characters from U+0E00 on (scripts without blanks, signs, emoji) stand alone; of others, up to four that no white space parts.
UNIT = r"[\x{0E00}-\x{10FFFF}]|[^\s\x{0E00}-\x{10FFFF}]{1,4}"
#: Hashes in a fingerprint.
SKETCH = 128
#: Characters at the beginning whose pairs are marks.
HEAD = 9
#: Rows of neighbouring ids in a cell, and cells at most: beyond that (134 million rows), cells grow.
CELL, MOST_CELLS = 1024, 1 << 17


def _anchor_starts(inner: str) -> Column:
    """Positions whose K-run is a closed syncmer; ``inner`` names the S-run hashes."""
    g = F.col(inner)
    last = K - S

    def closed(i: Column) -> Column:
        edge = F.least(g[i], g[i + last])
        middle = F.least(*[g[i + j] for j in range(1, last)])
        return edge <= middle

    return F.filter(F.sequence(F.lit(0), F.size(g) - last - 1), closed)


def with_anchors(df: DataFrame, text: str, out: str = "anchors") -> DataFrame:
    """Adds an array of structs (pos, hash), in order of position, and keeps the other columns."""
    h, g = C.spare(df, f"{out}_h", f"{out}_g")
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(h, F.transform(F.regexp_extract_all(value, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)))
    n = F.size(h)
    df = df.withColumn(g, F.when(n >= K, F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(F.col(h)[i], F.col(h)[i + 1]))))
    found = F.transform(
        _anchor_starts(g), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.col(g)[i], F.col(g)[i + 2], F.col(h)[i + 4]).alias("hash"))
    )
    df = df.withColumn(out, F.when(F.col(g).isNotNull(), found)).drop(h, g)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(value).alias("hash")))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole))


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct hashes (32 bits) of the text's anchors, each with the distance to the next, and of its first pairs of characters with their places."""
    (anchors,) = C.spare(df, f"{out}_a")
    df = with_anchors(df, text, anchors)
    after = F.slice(F.col(anchors), F.lit(2), F.greatest(F.size(anchors) - 1, F.lit(0)))
    marks = F.zip_with(F.col(anchors), after, lambda x, y: F.shiftright(F.xxhash64(x["hash"], y["pos"] - x["pos"]), 32).cast("int"))
    value = F.coalesce(F.col(text), F.lit(""))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(value), F.lit(HEAD)) - 1))
    head = F.transform(places, lambda i: F.shiftright(F.xxhash64(i, F.substring(value, i, F.lit(2))), 32).cast("int"))
    head = F.when(F.length(value) > 1, head).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, F.array_distinct(F.concat(marks, head))).drop(anchors)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of marks."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def as_text(marks: Column) -> Column:
    """The fingerprint: the SKETCH smallest marks, eight hexadecimal digits each."""
    low = F.slice(F.sort_array(marks), 1, SKETCH)
    return F.array_join(F.transform(low, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _cell_of(value: Column, cuts: list[int], fan: int = 362) -> Column:
    """How many of the sorted cuts are below the value, looked up in two steps.

    The cuts are one constant of the plan, however many they are.
    """
    below = lambda cs: F.size(F.filter(cs, lambda c: c < value))
    constant = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), kind)  # noqa: E731  folded once
    parts = [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    part = F.least(below(constant([p[-1] for p in parts], "array<bigint>")), F.lit(len(parts) - 1))
    return part * fan + below(F.element_at(constant(parts, "array<array<bigint>>"), part + 1))


def with_next(df: DataFrame, cols: list[str], per_cell: int = CELL) -> DataFrame:
    """Adds next_<c>: the values of the row that follows in descending doc_id; after the last, of the first.

    Rows are dealt into cells, ranges of ids between approximate quantiles, as many
    as the number of rows asks for; the windows hold one cell each, and the first
    row of each cell is handed to the cell before it.
    """
    ids = df.select("doc_id")
    n_rows, n_ids, most = ids.agg(F.count("*"), F.count("doc_id"), F.max("doc_id")).first()
    cells = max(1, min(MOST_CELLS, -(-n_rows // per_cell)))
    cuts: list[int] = []
    if n_ids:  # quantiles are ids of rows, so no cell is empty
        inner = ids.select(F.percentile_approx("doc_id", [x / cells for x in range(1, cells)], 10 * max(cells, 1000))).first()[0] if cells > 1 else []
        cuts = sorted({*inner, most})
    lowest, top = (-1 if n_rows > n_ids else 0), len(cuts) - 1
    cell, nxt, head = C.spare(df, "cell", "next", "head")
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(_cell_of(F.col("doc_id"), cuts)) if cuts else F.lit(-1)
    df = df.withColumn(cell, F.coalesce(place, F.lit(-1)))  # never null, or the join would filter one side only and the exchange be made twice
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    n_tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells // 4)
    by_cell = Window.partitionBy(cell).orderBy(*order)
    df = df.repartition(n_tasks, cell)  # rows and heads are read from one exchange
    rows = df.withColumn(nxt, F.lead(F.struct(*cols)).over(by_cell))
    first = F.max_by(F.struct(*cols), F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), -F.xxhash64("text").cast("decimal(20,0)")))
    heads = df.groupBy(cell).agg(first.alias(head)).select(
        F.when(F.col(cell) == top, lowest).otherwise(F.col(cell) + 1).alias(cell), head
    )
    rows = rows.join(heads, cell)
    for c in cols:
        rows = rows.withColumn(f"next_{c}", F.coalesce(nxt, head)[c])
    return rows.drop(cell, nxt, head)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_marks(docs, "text", "own"), ["text", "own"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = with_marks(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLE_SQL: dict[str, str] = {}
