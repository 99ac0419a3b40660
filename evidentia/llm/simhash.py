"""SimHash near-duplicates through an inverted index of byte positions.

Fingerprint.  A text's shingles of three words are hashed (XXH64, seed 42); a
bit of the fingerprint is 1 where it is 1 in over half of the hashes.

Candidates.  A fingerprint is eight bytes at eight positions.  Two that differ
in at most BITS bits share at least 8 - BITS positional bytes: that is the
guaranteed minimum of the count filter.  The lists of a single byte would hold
a 256th of all fingerprints, and pairs in them would grow with the square of
the table; so lists are kept for sets of positions instead (unions of two of
BITS + 2 runs of positions, of four bytes in production), chosen so that any
two fingerprints above the minimum share the bytes of at least one set whole.
For the pairs that meet in a list, the shared positional bytes are tallied over
all eight positions, pairs that reach the minimum are kept, and their differing
bits counted.

Long lists (over LONG members, as grow in large tables or among alike short
texts) emit no pairs: their members are listed again under every fingerprint
that is at most one bit away in the bytes that the list leaves open.  Two
members within two bits have such a midpoint in common; a midpoint has 33
members at most, and ties them to one of them.  So links stay in proportion to
fingerprints, and none that matters for the components is lost.

Only fingerprints travel through index and links, equal ones once.  Rows get
their component by a join; the fingerprints that hold more than a
1/C.HOT of all rows (fewer than C.HOT of them) go the broadcast way.

Defined cases: a null or empty text has fingerprint zero, and is linked like any
other; texts of one or two words have one shingle; rows without an id keep
their fingerprint and name no component, but get that of their links (null
if none has an id); rows that share an id are rows of their own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .minhash import components

WORDS, SEED, BITS = 3, 42, 2
#: Members up to which a list's pairs are tallied; beyond, they meet at midpoints.
LONG = 64
#: Shingles hashed at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of UTF-8 text over shingles of n words, A-Z in lower case."""
    words = text.lower().split()  # bytes: only A-Z change, and only 0x20 and 0x09 to 0x0D cut
    if not words:
        return 0
    n = min(n, len(words))
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])[: len(words) - n + 1]
    end, ones = end[n - 1 :], np.zeros(64, np.int64)
    for at in range(0, len(start), AT_ONCE):
        spans = zip(start[at : at + AT_ONCE].tolist(), end[at : at + AT_ONCE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, n) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def position_sets(bits: int = BITS) -> list[int]:
    """Masks of byte positions: fingerprints that differ in ``bits`` bits agree under at least one of them.

    The positions are cut into bits + 2 runs, of which at least two are untouched.
    """
    runs = [sum(0xFF << 8 * int(p) for p in run) for run in np.array_split(np.arange(8), bits + 2)]
    return [a | b for a, b in combinations(runs, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    differ = a.bitwiseXOR(b)
    same = [F.when(differ.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0, 1).otherwise(0) for p in range(8)]
    return sum(same[1:], same[0])


def links(fps: DataFrame, bits: int = BITS, long: int = LONG) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (``fps``: fp) that differ in at most ``bits`` (1 or 2) bits.

    All pairs in lists of up to ``long`` members; of longer ones, enough to tie whatever is linked.
    """
    if bits not in (1, 2):
        raise ValueError("midpoints settle fingerprints that differ in one or two bits")
    sets = position_sets(bits)
    entry = [F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(sets)]
    postings = fps.select("fp", F.inline(F.array(*entry)))
    lists = postings.groupBy("slot", "key").agg(F.count("*").alias("members")).where("members > 1")
    postings = C.stored(postings.join(lists, ["slot", "key"]), "postings")
    near = lambda df: df.where(shared_bytes(F.col("a"), F.col("b")) >= 8 - bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    short = postings.where(F.col("members") <= long)
    left, right = short.select("slot", "key", F.col("fp").alias("a")), short.select("slot", "key", F.col("fp").alias("b"))
    met = near(left.join(right, ["slot", "key"]).where("a < b").select("a", "b"))
    steps = [F.array(*[F.lit(_signed(step)) for step in [0, *(1 << j for j in range(64) if not m >> j & 1)]]) for m in sets]
    open_bits = F.element_at(F.array(*steps), F.col("slot") + 1)
    mid = postings.where(F.col("members") > long).select("fp", "slot", F.explode(open_bits).alias("step"))
    mid = mid.select("slot", "fp", F.col("fp").bitwiseXOR(F.col("step")).alias("mid")).groupBy("slot", "mid").agg(F.collect_list("fp").alias("fps"))
    # within two bits, any member of a midpoint may stand for it; within one, only the midpoint itself
    hub = F.array_min("fps") if bits == 2 else F.when(F.array_contains("fps", F.col("mid")), F.col("mid"))
    tied = mid.where(F.size("fps") > 1).select(hub.alias("hub"), F.explode("fps").alias("fp")).where("hub != fp")
    tied = near(tied.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")))
    return met.union(tied).distinct()


def near_duplicates(docs: DataFrame, n: int = WORDS, bits: int = BITS, long: int = LONG) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text)."""
    C.ship(docs.sparkSession)
    rows = C.stored(fingerprints(docs, n), "fingerprints")
    nodes = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    classes = components(C.stored(links(nodes.select("fp"), bits, long), "links")).withColumnRenamed("node", "fp")
    first = classes.join(nodes, "fp").groupBy("class_id").agg(F.min("low").alias("first"))
    named = nodes.join(classes.join(first, "class_id").select("fp", "first"), "fp", "left").select("fp", "n", F.coalesce("first", "low").alias("component_id"))
    return C.joined(rows, C.stored(named, "components"), "fp").select("doc_id", "fp", "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document."""
    rows = near_duplicates(C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op12_simhash_dedup": op12_simhash_dedup}

#: The primes of the public XXH64 hash.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _xxh64_sql(strings: str, seed: int) -> str:
    """CTEs that end in ``hashed`` (s, h): the XXH64 of each string s of the relation ``strings``, in 128-bit integers cut to 64."""
    u = lambda n: f"{n % (1 << 64)}::UHUGEINT"
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    mul = lambda x, k: cut(f"({x}) * {u(k)}")
    turn = lambda x, n: f"({cut(f'({x}) * {1 << n}::UHUGEINT')} + ({x}) // {u(1 << (64 - n))})"
    mixed = lambda acc, x: mul(turn(cut(f"{acc} + {mul(x, P2)}"), 31), P1)
    then = lambda x, k, plus: cut(f"{mul(x, k)} + {u(plus)}")
    shifted = lambda h, n, k: mul(f"xor({h}, {h} // {u(1 << n)})", k)
    swaps = ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))  # bytes from big to little end
    lane = "list_transform(range(n // 8), lambda i: ('0x' || substr(hx, 16 * i + 1, 16))::UBIGINT)"
    for bits, mask in swaps:
        lane = f"list_transform({lane}, lambda x: ((x & {mask}::UBIGINT) << {bits}) | ((x >> {bits}) & {mask}::UBIGINT))"
    four = " + ".join(f"('0x' || substr(hx, 16 * (n // 8) + {2 * j + 1}, 2))::UHUGEINT * {256**j}" for j in range(4))
    byte = "list_transform(range(n - n % 4, n), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::UHUGEINT)"
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    accs = [f"list_reduce(list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}]), lambda a, x: {mixed('a', 'x')}, {u(s)}) AS a{k + 1}" for k, s in enumerate(starts)]
    whole = cut(" + ".join(turn(f"a{k + 1}", n) for k, n in enumerate((1, 7, 12, 18))))
    steps = [
        f"SELECT s, hex(encode(s)) AS hx, octet_length(encode(s)) AS n FROM {strings}",
        f"SELECT *, list_transform({lane}, lambda x: x::UHUGEINT) AS lanes FROM x0",
        f"SELECT *, {', '.join(accs)} FROM x1",
        f"SELECT *, CASE WHEN n < 32 THEN {u(seed + P5)} ELSE list_reduce([a1, a2, a3, a4], lambda h, x: {then('xor(h, ' + mixed(u(0), 'x') + ')', P1, P4)}, {whole}) END AS h FROM x2",
        f"SELECT s, hx, n, list_reduce(lanes[4 * (n // 32) + 1:], lambda h, x: {then(turn('xor(h, ' + mixed(u(0), 'x') + ')', 27), P1, P4)}, {cut('h + n::UHUGEINT')}) AS h FROM x3",
        f"SELECT s, hx, n, CASE WHEN n % 8 >= 4 THEN {then(turn(f'xor(h, {mul(four, P1)})', 23), P2, P3)} ELSE h END AS h FROM x4",
        f"SELECT s, list_reduce({byte}, lambda h, x: {mul(turn('xor(h, ' + mul('x', P5) + ')', 11), P1)}, h) AS h FROM x5",
        f"SELECT s, {shifted('h', 33, P2)} AS h FROM x6",
        f"SELECT s, {shifted('h', 29, P3)} AS h FROM x7",
    ]
    return ",\n".join([*[f"x{i} AS ({s})" for i, s in enumerate(steps)], f"hashed AS (SELECT s, xor(h, h // {u(1 << 32)})::UBIGINT AS h FROM x8)"])


#: All pairs of fingerprints, compared; fit for small tables only.
ORACLE_SQL = {
    "op12_simhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
o AS (SELECT r, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
t AS (SELECT DISTINCT s FROM o),
{_xxh64_sql("t", SEED)},
f AS (SELECT r, {" + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))} AS fp FROM o JOIN hashed USING (s) GROUP BY r),
d AS (SELECT doc_id, coalesce(fp, 0::HUGEINT) AS fp FROM w LEFT JOIN f USING (r)),
n AS (SELECT fp, min(doc_id) AS low FROM d GROUP BY fp),
e AS (SELECT a.fp AS a, b.fp AS b FROM n a, n b WHERE a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
c AS (SELECT fp AS a, fp AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT d.doc_id, format('{{:016x}}', d.fp) AS fingerprint, g.component_id
FROM d JOIN (SELECT c.a AS fp, min(n.low) AS component_id FROM c JOIN n ON n.fp = c.b GROUP BY c.a) g USING (fp)"""
}
