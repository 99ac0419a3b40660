"""Divergence of each source of a language from its peers, and the terms that set it apart.

Within a language, every (lang, source) group has a smoothed distribution over
the terms the language keeps, in whole parts per billion.  The divergence of
two groups sums (p - q)^2 / (p + q), rounded down, over all kept terms.

Counts.  Texts are counted in Arrow batches, a table of counts per task, so
that the shuffle carries a row a group and term, not a row a word.

Vectors.  The terms of a language are dealt by hash into cells of about CELL
terms, so that no vector grows with the vocabulary; groups are dealt into
blocks of GROUPS.  A row holds one block's counts in one cell, non-zero ones
only, compressed.

Rotation.  Blocks of a language play a round-robin tournament: in each round
every block has one partner, one of the two stays where it is and its peer
travels; both directions are evaluated where they meet, cell by cell.  Rounds
are run in waves of ROUNDS, whose sums are written, so that at any time at
most ROUNDS / 2 copies of the vectors are under way.  At home a block meets
itself and the language: a local heap keeps each group's highest terms of
the cell, and the heaps of the cells are merged by rank.

Defined cases: null text, lang and source are ''; every row is a document,
repeated ones too; groups without terms have vectors of zeros; a language that
keeps no term gives its pairs the value 0; a group without peers has no pairs;
ties go to the item that comes first in UTF-8; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Terms in a cell, groups in a block, rounds in a wave.
CELL, GROUPS, ROUNDS = 4096, 8, 16
#: Counts a task holds before it hands them on.
HELD = 400_000

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n, docs; the term '' stands for the group itself, with its documents."""

    def rows(counts):
        cols = [[], [], [], [], []]
        for (lang, source), (n, seen) in counts.items():
            cols[0] += [lang] * len(n)
            cols[1] += [source] * len(n)
            cols[2] += list(n)
            cols[3] += list(n.values())
            cols[4] += [seen[t] for t in n]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, seen = counts.setdefault((lang, source), (Counter(), Counter()))
                before, found = len(n), terms(text)
                n.update(found)
                seen.update({*found, b""})
                n[b""] += 0
                size += len(n) - before
                if size > held:
                    yield rows(counts)
                    counts, size = {}, 0
        if counts:
            yield rows(counts)

    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(run, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = DOCUMENTS, per_cell: int = CELL) -> DataFrame:
    """lang, term, total, v, n_lang, cells, cell, pos: the kept terms, dealt into cells and numbered there in UTF-8 order."""
    kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = C.stored(kept.drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum("total").alias("n_lang")).withColumn("v", F.col("n"))
    kept = C.joined(kept, langs, "lang").withColumn("cells", F.ceil(F.col("v") / per_cell))
    kept = kept.withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "cell").orderBy("term")) - 1)


def vectors(counts: DataFrame, kept: DataFrame, per_block: int = GROUPS) -> DataFrame:
    """lang, cell, block, blocks, v, v_cell, sources, totals, data: the compressed counts of a block's groups in a cell.

    Every block has a row in every cell of its language, and one in cell 0 where the
    language keeps no term.
    """
    entries = C.stored(counts.join(kept.select("lang", "term", "cell", "pos"), ["lang", "term"]).select("lang", "source", "cell", "pos", "n"), "entries")
    groups = counts.where("term = ''").select("lang", "source")
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("n")), ["lang", "source"], "left")
    by_name = Window.partitionBy("lang").orderBy("source")  # a row a source: the pairs asked for are the square of that
    groups = groups.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / per_block))
    groups = groups.select("lang", "source", F.coalesce("n_group", F.lit(0)).alias("n_group"), F.coalesce("n", F.lit(0)).alias("n"), "blocks", F.floor(F.col("nth") / per_block).alias("block"), (F.col("nth") % per_block).alias("seat"))
    groups = C.stored(groups, "groups")
    blocks = groups.groupBy("lang", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("seat", "source", "n_group"))).alias("g"))
    cells = kept.groupBy("lang", "cell", "v").agg(F.count("*").alias("v_cell"))
    frame = blocks.join(cells, "lang", "left").select(
        "lang", "block", "blocks", F.coalesce("cell", F.lit(0)).alias("cell"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("v_cell", F.lit(0)).alias("v_cell"), "g"
    )
    held = C.joined(entries.withColumnRenamed("n", "count"), groups.select("lang", "source", "n", "block", "seat"), "lang", "source").groupBy("lang", "cell", "block")
    held = held.agg(F.collect_list(F.struct("seat", "pos", F.col("count").alias("n"))).alias("e"))  # at most GROUPS times the cell's terms
    rows = frame.join(held, ["lang", "cell", "block"], "left").select(
        "lang", "cell", "block", "blocks", "v", "v_cell", F.col("g.source").alias("sources"), F.col("g.n_group").alias("totals"), F.col("e.seat").alias("seat"), F.col("e.pos").alias("pos"), F.col("e.n").alias("n")
    )
    kind = "lang string, cell long, block long, blocks long, v long, v_cell long, sources array<string>, totals array<long>, data binary"

    def run(batches):
        for batch in batches:
            data = []
            for at in range(batch.num_rows):
                seat, pos, n = (np.array(batch.column(k)[at].as_py() or [], np.int64) for k in (8, 9, 10))
                order = np.lexsort((pos, seat))
                data.append(zlib.compress(np.stack([seat, pos, n])[:, order].tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(data, pa.binary())], [c.split()[0] for c in kind.split(", ")])

    return rows.mapInArrow(run, kind)


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), exact at any count."""
    if counts.max(initial=0) < 2**63 // SCALE - 2:
        return 1 + SCALE * (counts + 2) // (n + 2 * v)
    return np.array([1 + SCALE * (int(c) + 2) // (n + 2 * v) for c in counts.ravel()], np.int64).reshape(counts.shape)


def unpacked(data: bytes, groups: int, v_cell: int) -> np.ndarray:
    """The counts of a row of ``vectors``: a line a group, a column a term of the cell."""
    seat, pos, n = np.frombuffer(zlib.decompress(data), np.int64).reshape(3, -1)
    out = np.zeros((groups, v_cell), np.int64)
    out[seat, pos] = n
    return out


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of each term."""
    return (p - q) * (p - q) // (p + q)


def _dense(r: dict, side: str = "") -> np.ndarray:
    counts = unpacked(r[side + "data"], len(r[side + "sources"]), r["v_cell"])
    return np.stack([shares(c, n, r["v"]) for c, n in zip(counts, r[side + "totals"], strict=True)]) if r["v_cell"] else counts


def _evaluated(kernel):
    """A function for mapInArrow that hands each row to ``kernel`` and gathers what it finds."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                if found := kernel(batch.slice(at, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(),) * 4 + (pa.int64(),), strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def at_home(rows: DataFrame, kept: DataFrame, top: int = TOP) -> DataFrame:
    """Pairs within a block, and the heap of each group's terms above the language's share, for each cell."""
    cells = kept.groupBy("lang", "cell", "n_lang").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "total"))).alias("t"))
    cells = cells.select("lang", "cell", "n_lang", F.col("t.term").alias("terms"), F.col("t.total").alias("lang_counts"))

    def kernel(r):
        p, found = _dense(r), []
        for a, left in enumerate(r["sources"]):
            for b in range(a):
                value = int(divergences(p[a], p[b]).sum())
                found += [(r["lang"], left, "pair", r["sources"][b], value), (r["lang"], r["sources"][b], "pair", left, value)]
        if r["v_cell"]:
            q = shares(np.array(r["lang_counts"], np.int64), r["n_lang"], r["v"])
            n = unpacked(r["data"], len(r["sources"]), r["v_cell"])
            for g, source in enumerate(r["sources"]):
                above = np.flatnonzero((n[g] > 0) & (p[g] > q))
                value = divergences(p[g, above], q[above])
                best = np.lexsort((above, -value))[:top]
                found += [(r["lang"], source, "term", r["terms"][above[k]], int(value[k])) for k in best]
        return found

    return rows.join(cells, ["lang", "cell"], "left").mapInArrow(_evaluated(kernel), FOUND)


def partner(i: Column, blocks: Column, r: Column) -> Column:
    """Whom seat ``i`` meets in round ``r`` of the tournament; a number that no block has stands for a bye."""
    last = blocks + blocks % 2 - 1  # the highest seat; also the number of rounds
    across = F.pmod(r - i, last)
    return F.when(i == last, F.pmod(r * ((last + 1) / 2).cast("long"), last)).otherwise(F.when(across == i, last).otherwise(across))


def meetings(rows: DataFrame, rounds: range) -> DataFrame:
    """The rows that stay in the given rounds, each joined with its peer that travels."""
    r = F.explode(F.expr(f"sequence({rounds.start}L, least({rounds.stop}L, blocks + blocks % 2 - 1) - 1)")).alias("round")
    away = rows.where(F.col("blocks") + F.col("blocks") % 2 - 1 > rounds.start).select("*", r)
    away = away.withColumn("meets", partner(F.col("block"), F.col("blocks"), F.col("round"))).where("meets < blocks")
    stays = F.when((F.col("block") + F.col("meets") + F.col("round")) % 2 == 0, F.least("block", "meets")).otherwise(F.greatest("block", "meets"))
    away = away.where(stays != F.col("block")).select("lang", "cell", F.col("meets").alias("block"), *[F.col(c).alias(f"peer_{c}") for c in ("sources", "totals", "data")])
    return rows.drop("blocks").join(away, ["lang", "cell", "block"])


def met(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair of groups that meet."""

    def kernel(r):
        p, q, found = _dense(r), _dense(r, "peer_"), []
        for a, left in enumerate(r["sources"]):
            value = divergences(p[a], q).sum(axis=1)
            for b, right in enumerate(r["peer_sources"]):
                found += [(r["lang"], left, "pair", right, int(value[b])), (r["lang"], right, "pair", left, int(value[b]))]
        return found

    return pairs.mapInArrow(_evaluated(kernel), FOUND)


def divergence(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP, per_cell: int = CELL, per_block: int = GROUPS, wave: int = ROUNDS) -> DataFrame:
    """lang, source, part, item, value, rank of all groups of ``docs`` (lang, source, text)."""
    C.ship(docs.sparkSession)
    total = lambda df: df.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    counts = C.stored(term_counts(docs), "term-counts")
    kept = C.stored(kept_terms(counts, least, per_cell), "vocabulary")
    rows = C.stored(vectors(counts, kept, per_block), "vectors")
    most = rows.agg(F.max("blocks")).first()[0] or 0
    found = at_home(rows, kept, top)
    for start in range(0, most + most % 2 - 1, wave):
        away = total(met(meetings(rows, range(start, start + wave))))
        found = found.unionByName(C.stored(away, "rounds") if start + wave < most + most % 2 - 1 else away)
    ranked = total(found).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of a language against its peers and against the language."""
    return divergence(C.table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
words AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""
}
