"""Near-duplicate classes by DartMinHash signatures and a banded join.

Signature.  A text is the set of its runs of five words, each with a weight
(1 in production, its count if asked for).  Hashed darts rain on the plane of
element, weight and rank: a cell of area one holds Poisson(1) darts, whose
places, ranks and coordinates depend on the cell alone.  The darts below an
element's weight hit it.  Only ranks up to t / total weight are looked at,
which yields about t = k ln k + 2k darts whatever the text's length; the
earliest dart of each of the k coordinates is the signature, and the bound
on ranks is doubled for texts that leave a coordinate empty.  Two texts agree
in a coordinate with probability equal to their weighted Jaccard index.

Join.  Equal texts are put together first.  Bands of the signature are
hashed to buckets.  Every text is compared with one hub of its buckets, so
comparisons grow with the members, never with their square; each comparison
is exact, over the shingle sets.  What links are found makes classes
(connected components).  Large buckets that still hold several classes meet
HUB_ROUNDS more hubs, which only saves work.  What then remains is settled
whole: small buckets pair by pair, the members of large ones by a join on the
prefixes of their shingles, rarest first, which finds every pair of different
classes that reaches the similarity.

With 32 bands of 5, two texts of similarity 0.8 meet in no bucket with
probability 3e-6, and of 0.85 with 2e-8.

Defined cases: a null text counts as empty; equal texts always share a
class, empty ones too; texts under five words have one shingle, all their
words; words are compared in lower case; rows that share an id are one
document, so their texts' classes are one; rows without an id have a null class; ties need no rule, as a class
is named by its smallest id; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
#: Buckets of up to this many texts are compared pair by pair where they hold several classes.
PAIRWISE = 16
#: How often large buckets meet a hub before the join on prefixes.
HUB_ROUNDS = 2
#: Texts that share a shingle are dealt into parts of about this many.
PART = 256

_U = np.uint64
_SPACES: list[np.ndarray] = []
#: Cumulative probabilities of 0, 1, 2, ... events at rate one, as fractions of 2**64.
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 18)])])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text."""
    if not _SPACES:
        _SPACES.append(np.fromiter(map(str.isspace, map(chr, range(0x110000))), bool, 0x110000))
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACES[0][code]
    at = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(code) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, _U)
    place = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code)))) if at[0] == 0 else None
    if place is None:
        code, space = code[at[0] :], space[at[0] :]
        at = at - at[0]
        place = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
    x = _mix(code.astype(_U) * _U(0x9E3779B97F4A7C15) + place.astype(_U) * _U(0xD6E8FEB86659FD93))
    x[space] = 0
    return _mix(np.add.reduceat(x, at))


def shingles(text: str | None, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of n words, sorted, and how often each occurs."""
    w = word_hashes(text or "")
    if not len(w):
        return w, np.zeros(0, np.int64)
    n = min(n, len(w))
    x = np.zeros(len(w) - n + 1, _U)
    for j in range(n):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + w[j : len(w) - n + 1 + j])
    return np.unique(x, return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The signature: for each of k coordinates the identity of the earliest dart that hits."""
    total = float(weights.sum())
    level = (k * np.log(k) + 2 * k) / total
    while True:
        sig = _thrown(elements, weights.astype(np.float64), k, level)
        if sig is not None:
            return sig
        level *= 2


def _thrown(elements: np.ndarray, weights: np.ndarray, k: int, level: float) -> np.ndarray | None:
    """Darts of rank below ``level``; None if a coordinate stays empty.

    Weights are cut into [0, 1), [1, 2), [2, 4), ...; over a part of width W, ranks
    are cut into steps of 1 / W, so that every cell has area one.
    """
    keys, low, width, floor, own = [], [], [], [], []
    top = max(1, int(np.ceil(np.log2(max(2.0, weights.max()))))) if weights.max() > 1 else 0
    for part in range(top + 1):
        lo, wide = (0.0, 1.0) if part == 0 else (2.0 ** (part - 1), 2.0 ** (part - 1))
        reach = np.flatnonzero(weights > lo)
        if not len(reach):
            break
        steps = int(np.ceil(level * wide))
        rank = np.tile(np.arange(steps), len(reach))
        of = np.repeat(reach, steps)
        keys.append(_mix(elements[of] + _mix((rank.astype(_U) << _U(8)) + _U(part + 1))))
        low.append(np.full(len(of), lo))
        width.append(np.full(len(of), wide))
        floor.append(rank / wide)
        own.append(weights[of])
    key, lo, wide, base, w = map(np.concatenate, (keys, low, width, floor, own))
    n = np.searchsorted(_POISSON, _unit(key), "right")
    cell = np.repeat(np.arange(len(key)), n)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
    dart = _mix(key[cell] + (nth + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
    second = _mix(dart + _U(0xD1B54A32D192ED03))
    third = _mix(second + _U(0x8CB92BA72F3D8DD7))
    rank = base[cell] + _unit(dart) / wide[cell]
    hit = (lo[cell] + _unit(second) * wide[cell] < w[cell]) & (rank < level)
    rank, dart, coord = rank[hit], second[hit], (third[hit] % _U(k)).astype(np.int64)
    order = np.lexsort((rank, coord))
    coord, dart = coord[order], dart[order]
    first = np.flatnonzero(np.diff(coord, prepend=-1))
    return dart[first] if len(first) == k else None


def band_hashes(text: str | None, bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> np.ndarray:
    """One 64-bit hash a band, the band's number mixed in; none for a text without words."""
    e, n = shingles(text)
    if not len(e):
        return np.zeros(0, np.int64)
    sig = darts(e, n if counted else np.ones(len(e)), bands * rows).reshape(bands, rows)
    x = np.arange(1, bands + 1, dtype=_U)
    for j in range(rows):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + sig[:, j])
    return x.view(np.int64)


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for the text."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256), 1, 32))


def signatures(docs: DataFrame, counted: bool = False) -> DataFrame:
    """doc_id, key, bands of each row with an id."""

    def run(batches):
        C.fresh()
        for batch in batches:
            got = [band_hashes(t, counted=counted) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """node, tag, grams: sorted 32-bit shingle hashes; the tag tells texts of one id apart."""

    def run(batches):
        C.fresh()
        for batch in batches:
            got = [np.unique((shingles(t)[0] >> _U(32)).astype(np.uint32)).view(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["node", "tag", "grams"])

    return rows.mapInArrow(run, "node long, tag long, grams array<int>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard index of ``least`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(C.merged(right), "b").join(C.merged(left), "a")
    common = F.size(F.array_intersect("ga", "gb"))
    sizes = F.size("ga") + F.size("gb")
    possible = F.least(F.size("ga"), F.size("gb")) >= F.lit(least) * F.greatest(F.size("ga"), F.size("gb"))
    return both.where(possible).where(common >= F.lit(least) * (sizes - common)).select("a", "b")


def may_reach(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ``rows`` (node, tag, class_id, grams) of different classes: all whose Jaccard index is ``least`` or more, and few others.

    Shingles are put in one order: those that occur in one class only, then the
    rarest first.  Of a pair that reaches ``least``, the smaller set of n lacks at
    most n - 2 least / (1 + least) n shingles of the other, which lacks at most
    (1 - least) of its own; so the first common one stands among the first of both,
    and what follows it must still hold all that have to be common.
    """
    slack = 1e-6
    grams = rows.select("node", "tag", "class_id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo != hi").select("gram", "n")
    found = grams.join(C.merged(shared), "gram").groupBy("node", "tag", "class_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("found"))
    own = F.col("size") - F.size("found")
    reach = lambda share: F.floor(F.col("size") - F.col("size") * share + slack) + 1
    short = F.greatest(reach(least) - own, F.lit(0)).cast("int")
    heads = found.withColumn("own", own).select("node", "class_id", "size", "own", F.posexplode(F.slice("found", 1, short)).alias("i", "f"))
    parts = F.ceil(F.col("f.n") / PART).cast("int")
    heads = heads.select("node", "class_id", "size", (F.col("own") + F.col("i")).alias("pos"), F.col("f.gram").alias("gram"), parts.alias("parts"))
    heads = C.stored(heads, "heads")
    small = heads.where(F.col("pos") < reach(2 * least / (1 + least))).select("gram", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.struct("node", "class_id", "size", "pos").alias("x"))
    big = heads.select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct("node", "class_id", "size", "pos").alias("y"))
    fits = (F.col("x.class_id") != F.col("y.class_id")) & (F.col("x.size") <= F.col("y.size")) & (F.col("x.size") >= F.col("y.size") * least - slack)
    follow = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    met = small.join(C.merged(big), ["gram", "part"]).where(fits & (follow >= (F.col("x.size") + F.col("y.size")) * (least / (1 + least)) - slack))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, class_id: the smallest node that links lead to.

    Each round takes the smallest label among the neighbours, then the label of
    that label, so that distances halve; labels are minima, combined before they
    are shuffled.
    """
    both = C.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    while True:
        seen = both.join(C.merged(labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))), "b").groupBy("a").agg(F.min("lb").alias("m"))
        new = labels.join(C.merged(seen.withColumnRenamed("a", "node")), "node").select("node", "label", F.least("label", "m").alias("low"))
        jump = new.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = C.stored(new.join(C.merged(jump), "low").select("node", F.col("lower").alias("label"), (F.col("lower") != F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("class_id"))


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after more links: only the classes that the new links tie are worked out anew."""
    of = lambda c, name: C.merged(classes.select(F.col("node").alias(c), F.col("class_id").alias(name)))
    tied = links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    tied = tied.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    moved = components(tied).withColumnRenamed("class_id", "to")
    known = classes.unionByName(moved.select("node", F.col("node").alias("class_id")).join(C.merged(classes), "node", "left_anti"))
    renamed = moved.withColumnRenamed("node", "class_id")
    return C.stored(known.join(C.merged(renamed), "class_id", "left").select("node", F.coalesce("to", "class_id").alias("class_id")), "classes")


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """doc_id, class_id: a row for each row of ``docs`` (doc_id, text); a class is named by its smallest id."""
    lost = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return _classed(docs, least, counted).select("doc_id", "class_id").unionByName(lost)


def _classed(docs: DataFrame, least: float, counted: bool = False) -> DataFrame:
    """doc_id, key, class_id of each row with an id.

    A node stands for a text, named by the smallest id that has it.  Texts that are
    named alike belong to one id, hence to one class, and links of either tie it.
    """
    sigs = C.stored(signatures(docs, counted), "signatures")
    first = F.min(F.struct("doc_id", "bands")).alias("first")
    texts = C.stored(sigs.groupBy("key").agg(first, F.count("*").alias("n")).select("key", "n", F.col("first.doc_id").alias("node"), F.col("first.bands").alias("bands")), "texts")
    in_bucket = texts.select("node", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hub"))
    full = in_bucket.groupBy("bucket").agg(F.min(order).alias("o"), F.count("*").alias("members")).where("members > 1").select("bucket", "o.hub", "members")
    # one row a text with its shared buckets, at most one a band
    mine = F.collect_list(F.struct("bucket", "members")).alias("buckets")
    best = F.min_by("hub", F.struct(F.xxhash64("hub"), "hub")).alias("hub")
    shared = C.stored(in_bucket.join(C.merged(full), "bucket").groupBy("node").agg(mine, F.sum("members").alias("crowd"), best), "shared")
    wanted = shared.select("node").join(C.merged(texts.select("node", "key")), "node")
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text").withColumn("key", text_key(F.col("text")))
    rows = rows.join(C.merged(wanted), ["node", "key"]).select("node", F.xxhash64("key").alias("tag"), "text")
    sets = C.stored(shingle_sets(rows), "shingles")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # at first every text meets one hub, the one that comes first in the order of all: a large group finds its common hub
    tried = C.stored(shared.where("node != hub").select(*pair(F.col("node"), F.col("hub"))).distinct(), "pairs")
    classes = components(verified(tried, sets, least).union(_same_id(sigs, texts)))
    rest = shared.drop("hub")
    for turn in range(1, HUB_ROUNDS + 2):
        # what is left: buckets with several classes
        named = rest.join(C.merged(classes), "node", "left").withColumns({"class_id": F.coalesce("class_id", "node"), "alone": F.col("class_id").isNull()})
        named = named.select("node", "crowd", "class_id", "alone", F.inline("buckets"))
        # first the member that stands in the fullest buckets, like an original among its edited copies; then one of a class of several: the few that are left meet it, not the many
        prefer = F.struct(-F.col("crowd"), F.xxhash64("node")) if turn == 1 else F.struct("alone", F.xxhash64("node", "bucket", F.lit(turn)))
        mixed = named.groupBy("bucket").agg(
            F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.min(F.struct(prefer, F.col("node").alias("hub"), F.col("class_id").alias("hub_class"))).alias("o")
        ).where("lo != hi").select("bucket", "o.hub", "o.hub_class")
        left = C.stored(named.join(C.merged(mixed), "bucket"), "rest")
        if turn <= HUB_ROUNDS:
            new = left.where((F.col("members") > PAIRWISE) & (F.col("class_id") != F.col("hub_class"))).select(*pair(F.col("node"), F.col("hub")))
            rest = left.groupBy("node").agg(mine, F.max("crowd").alias("crowd"))
        else:
            small = left.where(F.col("members") <= PAIRWISE).select("bucket", "node", "class_id")
            other = small.select("bucket", F.col("node").alias("node2"), F.col("class_id").alias("class2"))
            new = small.join(C.merged(other), "bucket").where("node < node2 and class_id != class2").select(*pair(F.col("node"), F.col("node2")))
            large = left.where(F.col("members") > PAIRWISE).select("node", "class_id").distinct()
            new = new.union(may_reach(large.join(C.merged(sets), "node"), least))
        new = C.stored(new.distinct().join(C.merged(tried), ["a", "b"], "left_anti"), "pairs")
        found = C.stored(verified(new, sets, least), "links")
        tried = tried.union(new)
        if not found.isEmpty():
            classes = joined_classes(classes, found)

    named = texts.select("key", "n", "node").join(C.merged(classes), "node", "left").select("key", "n", F.coalesce("class_id", "node").alias("class_id"))
    return C.joined(sigs.select("doc_id", "key"), C.stored(named, "named"), "key", grows=True).select("doc_id", "key", "class_id")


def _same_id(sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the texts of rows that share an id."""
    several = sigs.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo != hi")
    at = several.join(C.merged(sigs.select("doc_id", "key")), "doc_id").join(C.merged(texts.select("key", "node")), "key")
    one = at.groupBy("doc_id").agg(F.min("node").alias("a"))
    return at.join(C.merged(one), "doc_id").where("a != node").select("a", F.col("node").alias("b")).distinct()


def keep_one_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class: of its smallest id, and of that id's texts the one whose digest comes first; rows without an id stay."""
    key, kept_id, kept_key, n = C.spare(docs, "key", "kept_id", "kept_key", "n")
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = _classed(docs, least).where("doc_id = class_id").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    kept = kept.groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("o")).select(F.col("doc_id").alias(kept_id), F.col("o.key").alias(kept_key), F.col("o.n").alias(n))
    kept = C.stored(kept, "kept")
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn(key, text_key(F.col("text")))
    same = (F.col("doc_id") == F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    once = keyed.join(C.merged(kept.where(F.col(n) == 1)), same, "left_semi").select(*names)
    repeated = keyed.join(C.merged(kept.where(F.col(n) > 1)), same, "left_semi").dropDuplicates(["doc_id"]).select(*names)
    return once.unionByName(repeated).unionByName(docs.where(F.col("doc_id").isNull()))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicate_classes(C.table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
#: Every pair of texts that share a shingle, compared; fit for small tables only.
ORACLE_SQL = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)
  UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.t = b.t AND a.doc_id < b.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT doc_id, doc_id AS other FROM w UNION SELECT e.b, r.other FROM r JOIN e ON r.doc_id = e.a)
SELECT doc_id, (SELECT min(other) FROM r WHERE r.doc_id = documents.doc_id) AS class_id FROM documents"""
}
