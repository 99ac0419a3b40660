"""Near-duplicate classes against brute force; signatures against true similarity."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import _common, minhash

SCHEMA = "doc_id long, text string, class_id int, bucket string"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def brute(texts: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else {()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (texts[a] or "") == (texts[b] or "") or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and () not in sets[a] | sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus() -> dict[int, str | None]:
    rng = random.Random(5)
    out: list[str | None] = [None, "", "one", "ONE", "two words", "a b c d", "a b c d"]
    shared = words(rng, 60)
    for n in (20, 80, 300):
        base = words(rng, n)
        for _ in range(12):  # near copies of one text, each with changes of its own
            w = list(base)
            for _ in range(max(1, n // 80)):
                w[rng.randrange(n)] = "zzz"
            out.append(" ".join(w))
        out += [" ".join(base)] * 5
    for _ in range(15):  # a passage that texts share makes no duplicates of them
        out.append(" ".join(words(rng, 80) + shared))
    chain = words(rng, 100)
    for step in range(8):  # each like the one before, the ends unlike
        out.append(" ".join(chain[step * 4 :] + words(rng, step * 4)))
    return dict(enumerate(out))


def test_classes_are_those_of_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df).collect()}
    assert got == brute(texts)


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f", 0, "x"), (1, "a b c d e f", 0, "y"), (1, "a b c d e f", 0, "y"), (2, "other words altogether here now", 0, "z"), (None, "a b c d e f", 0, "n")]
    got = minhash.keep_one_each(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "class_id", "bucket"]
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 2]


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("red green blue black white grey", "one two three four five six", "sun moon star sky rain wind")
    rows = [(1, b, 0, "x"), (5, a, 0, "x"), (5, b, 0, "x"), (7, c, 0, "x"), (7, a, 0, "y"), (9, c, 0, "x"), (20, c + " snow", 0, "x"), (8, "alone", 0, "x"), (8, "alone", 0, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicate_classes(df).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (7, 1), (7, 1), (8, 8), (8, 8), (9, 1), (20, 20)]
    kept = sorted((r.doc_id, r.text) for r in minhash.keep_one_each(df).collect())
    assert kept == [(1, b), (8, "alone"), (20, c + " snow")]


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f", 3, 4, 5, 6), (2, "a b c d e f", 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, kept_id int, n int, node int")
    assert [r.class_id for r in minhash.near_duplicate_classes(df).collect()] == [1, 1]
    assert [tuple(r) for r in minhash.keep_one_each(df).collect()] == [rows[0]]


def test_empty_table(spark):
    assert minhash.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        wa = rng.integers(1, 6, n).astype(float)
        keep = rng.random(n) < 0.8
        b = np.where(keep, a, rng.integers(0, 2**63, n).astype(np.uint64))
        wb = np.where(keep, np.maximum(1, wa + rng.integers(-1, 2, n)), wa)
        x, y = dict(zip(a, wa)), dict(zip(b, wb))
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
        errors.append((minhash.darts(a, wa, 256) == minhash.darts(b, wb, 256)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_words_hash_alike_wherever_they_stand():
    a, b = minhash.word_hashes("  red green\tblue "), minhash.word_hashes("blue\nRED x")
    assert len(a) == 3 and a[2] == b[0] and a[0] == b[1]


def edited(rng, base, places):
    """The text with the words at the given places replaced by words of its own."""
    w = list(base)
    for at in places:
        w[at] = "".join(rng.choices("klmnop", k=7))
    return " ".join(w)


def test_large_families_around_the_threshold(spark):
    rng = random.Random(11)
    base, spots = words(rng, 400), range(10, 390, 6)
    texts = [edited(rng, base, rng.sample(spots, 6)) for _ in range(420)]  # mutually at about 0.74, so no hub is like many
    for _ in range(12):  # pairs at 0.82 that share nothing the family does not share: all their buckets are large
        places = rng.sample(spots, 8)
        texts += [edited(rng, base, places[:6]), edited(rng, base, places[:4] + places[6:])]
    base = words(rng, 300)  # copies unlike one another, each like the original
    texts += [edited(rng, base, rng.sample(range(5, 290, 6), 6)) for _ in range(100)] + [" ".join(base)]
    rng.shuffle(texts)
    numbered = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in numbered.items()], SCHEMA)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df).collect()}
    assert got == brute(numbered)


def test_pairs_of_different_classes_are_all_found(spark):
    rng = random.Random(2)
    sets = []
    for _ in range(12):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        sets += [sorted({*rng.sample(base, rng.randint(len(base) * 3 // 4, len(base))), *rng.sample(range(10**6), rng.randint(0, len(base) // 8))}) for _ in range(25)]
    rows = [(i, i % 4 if i % 3 else 1000 + i, s) for i, s in enumerate(sets) if s]
    df = spark.createDataFrame(rows, "node long, class_id long, grams array<int>").withColumn("tag", F.xxhash64("node"))
    got = {(r.a, r.b) for r in minhash.may_reach(df, 0.8).collect()}
    want = {(a, b) for a, ca, x in rows for b, cb, y in rows if a < b and ca != cb and len({*x} & {*y}) >= 0.8 * len({*x} | {*y})}
    assert want and want <= got


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """The planner would broadcast them while their compressed bytes are few, several at a time."""
    rng = random.Random(9)
    base = words(rng, 60)
    texts = [" ".join(base[: 60 - i % 5] + words(rng, i % 3)) for i in range(60)] + [" ".join(words(rng, 30)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plans, stored = {}, _common.stored

    def noted(df, hint):
        plans.setdefault(hint, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, hint)

    monkeypatch.setattr(_common, "stored", noted)
    got = minhash.keep_one_each(docs)
    plans["result"] = [got._jdf.queryExecution().executedPlan().toString()]
    assert {"labels", "rest", "pairs", "links"} <= plans.keys()
    # the hot keys alone, at most a few thousand rows, are sent to the rows of a key
    assert {hint for hint, seen in plans.items() if any("BroadcastHashJoin" in x for x in seen)} <= {"kept"}
    assert got.count() == len({*brute(dict(enumerate(texts))).values()})
