"""Filter audit, SimHash near-duplicates and source divergence against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
import xxhash

from evidentia.llm import _common, filter_audit, simhash, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, mask int, n int, fp string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def nasty(rng):
    """Texts with copies, blanks of all kinds, wide characters, digits only, and a very long one."""
    vocabulary = [f"{a}{b}" for a in ("Ab", "cd", "éF", "漢", "x1", "$") for b in ("", "q", "QQ", "zz7", "_")]
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "ONE two", "a\xa0b c d", "A" * 300, "😀 😀 😀", "#", "x\x1cy z", "12 34", "w " * 49, "w " * 50, " ".join(f"u{i}" for i in range(50))]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 140))) for _ in range(120)]
    return texts + [texts[k] for k in (1, 3, 20, 20, 20, 21)] + [" ".join(rng.choices(vocabulary, k=60_000))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = nasty(rng)
    out = [(i * 3 % 1009, t, rng.choice(["en", "de", "", None]), rng.choice(["s", "s", "s", "t", "", None, "ß"]), 9, 9, "x") for i, t in enumerate(texts)]
    return out + [out[30], out[30], (None, texts[20], "en", "s", 9, 9, "x"), (None, texts[20], "en", "s", 9, 9, "x"), (5, texts[40], None, None, 9, 9, "x"), (5, texts[41], None, "t", 9, 9, "x")]


def audited(rows, labels):
    """Every order applied to every document, one after the other."""
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], quality == 1), max(marks[i][1], toxic == 1)]
    lowest = {}
    for i, t, *_ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    out, shapley = {}, Counter()
    for i, t, _, source, *_ in rows:
        t, part = t or "", source or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > lowest[t]}
        good, toxic = marks[i] if i is not None else (0, 0)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((part, "".join(order), step), Counter())
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if fails[f]:
                    row["redundant" if gone else "removed"] += 1
                    if not gone:
                        row["good_lost"] += good
                        row["toxic_lost"] += toxic
                        shapley[part, f] += 1
                    gone = True
                row["kept"] += not gone
    return {(*k, *(v[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_every_order_applied(spark, rows, tmp_path):
    rng = random.Random(5)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows] + [(77777, 1, 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.op11_filter_audit(spark, str(tmp_path))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audited(rows, labels)


def test_filter_audit_of_other_filters_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "p", b"a", 3), (2, "p", b"a", 4), (3, "p", b"b", None)], "doc_id long, part string, digest binary, size int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = filter_audit.mask_cells(df, labels, {"S": "size > 3", "R": "repeats"})
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(cells, "SR").collect()}
    assert got == {("SR", 1): (2, 1, 0, 1), ("SR", 2): (2, 0, 1, 1), ("RS", 1): (2, 1, 0, 1), ("RS", 2): (2, 0, 1, 1)}
    none = filter_audit.measures(spark.createDataFrame([], DOCS))
    assert filter_audit.audit(filter_audit.mask_cells(none, labels), "ABCDE").count() == 0


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=2):
    """Of each fingerprint the smallest one that links lead to."""
    fps, out = sorted(set(fps)), {}
    for start in fps:
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                out[x] = start
                todo += [y for y in fps if y not in out and (x ^ y).bit_count() <= bits]
    return out


def test_simhash_against_all_pairs(spark, rows, tmp_path):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(400)) for _ in range(6)]
    edits = [" ".join(w if rng.random() > 0.004 else "Q" for w in t.split(" ")) for t in base for _ in range(25)]
    docs = rows + [(5000 - i, t, None, None, 1, 1, "x") for i, t in enumerate(base + edits)] + [(None, "lone text", None, None, 1, 1, "x")]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op12_simhash_dedup(spark, str(tmp_path)).collect())
    fps = [fingerprint(d[1]) for d in docs]
    of, low = components(fps), {}
    for d, f in zip(docs, fps, strict=True):
        if d[0] is not None:
            low[of[f]] = min(d[0], low.get(of[f], d[0]))
    assert got == Counter((d[0], f"{f:016x}", low.get(of[f])) for d, f in zip(docs, fps, strict=True))
    assert len({of[f] for f in fps[-151:-1]}) < 100  # edited copies are found


@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_long_and_short_lists_tie_the_same(spark, bits):
    rng = random.Random(bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(60):
            seed ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(seed)
    for _ in range(40):
        fps |= {0x1234_5678_0000_0000 | rng.getrandbits(9) << 3 for _ in range(4)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = components(fps, bits)
    for long in (2, 64):
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, bits, long).collect()]
        assert all((a ^ b).bit_count() <= bits for a, b in pairs) and len(pairs) == len(set(pairs))
        if long == 64:
            near = sum((a ^ b).bit_count() <= bits for a in fps for b in fps if a < b)
            assert len(pairs) <= near
        parent = {x: x for x in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        tied = {x: min(y for y in fps if root(y) == root(x)) for x in fps}
        assert tied == want


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT", 8)
    keys = ["hot"] * 600 + ["warm"] * 150 + [f"k{i % 100}" for i in range(250)]
    rows = spark.createDataFrame([(i, k, k[:1]) for i, k in enumerate(keys)], "i int, a string, b string").repartition(5)
    side = spark.createDataFrame([(k, k[:1], n, k.upper()) for k, n in Counter(keys).items()], "a string, b string, n long, c string")
    got = _common.joined(rows, side, "a", "b")
    assert sorted((r.i, r.a, r.c) for r in got.collect()) == [(i, k, k.upper()) for i, k in enumerate(keys)] and "n" not in got.columns
    assert _common.joined(rows.limit(0), side.limit(0), "a", "b").count() == 0


def test_simhash_of_nothing_and_position_sets(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    for bits in (1, 2):
        sets = simhash.position_sets(bits)
        for a in range(64):
            for b in range(64):
                flipped = (1 << a) | ((1 << b) if bits == 2 else 0)
                assert any(flipped & m == 0 for m in sets)


def diverged(rows, least, top):
    """All pairs of groups, term by term."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in {d[1] for d in docs if d[0] == lang}}
        share = lambda c, t, kept=kept: 1 + 1_000_000_000 * (c[t] + 2) // (c.total() + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(o, sum(f(share(c, t), share(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, f(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize(("per_cell", "per_block", "wave", "sources"), [(4096, 8, 16, 5), (3, 1, 2, 9), (5, 2, 1, 12), (2, 3, 16, 4)])
def test_divergence_against_all_pairs(spark, rows, per_cell, per_block, wave, sources):
    rng = random.Random(sources)
    spread = [(*r[:3], f"s{rng.randrange(sources)}" if k % 5 else r[3], *r[4:]) for k, r in enumerate(rows)]
    spread += [(900, "never seen again", "rare", "a", 1, 1, "x"), (901, "nor this", "rare", "b", 1, 1, "x"), (902, None, "alone", "a", 1, 1, "x")]
    got = [tuple(r) for r in source_divergence.divergence(spark.createDataFrame(spread, DOCS), 10, 4, per_cell, per_block, wave).collect()]
    assert len(got) == len(set(got)) and set(got) == diverged(spread, 10, 4)


def test_divergence_of_nothing_and_counts_beyond_64_bits(spark):
    import numpy as np

    assert source_divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
    counts = np.array([0, 7, 3 * 10**12], np.int64)
    n, v = int(counts.sum()), 3
    assert source_divergence.shares(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in counts]


def test_counts_are_handed_on_in_parts(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    whole, parts = ({tuple(r) for r in source_divergence.term_counts(df, held).collect()} for held in (10**6, 5))
    assert whole == parts


@pytest.mark.parametrize("blocks", range(1, 12))
def test_every_pair_of_blocks_meets_once(spark, blocks):
    from pyspark.sql import functions as F

    rows = spark.range(blocks).select(F.lit("l").alias("lang"), F.lit(0).alias("cell"), F.col("id").alias("block"), F.lit(blocks).cast("long").alias("blocks"), *[F.lit(1).alias(c) for c in ("sources", "totals", "data")])
    rounds = [source_divergence.meetings(rows.withColumn("sources", F.col("block")), range(k, k + 3)).select("block", "peer_sources") for k in range(0, 12, 3)]
    met = [tuple(sorted((r.block, r.peer_sources))) for df in rounds for r in df.collect()]
    assert sorted(met) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]


def test_the_hash_in_sql():
    rng = random.Random(6)
    texts = [""] + ["".join(rng.choices("abc défgh漢 ", k=rng.randrange(1, 90))) for _ in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT DISTINCT unnest(?) AS s", [texts])
    got = dict(con.sql(f"WITH {simhash._xxh64_sql('t', 42)} SELECT s, h FROM hashed").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_simhash_dedup", "op13_source_divergence"])
def test_same_rows_as_sql(spark, data, name):
    module = {"op11_filter_audit": filter_audit, "op12_simhash_dedup": simhash, "op13_source_divergence": source_divergence}[name]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(module.ORACLE_SQL[name])
    got = module.QUERIES[name](spark, data)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
