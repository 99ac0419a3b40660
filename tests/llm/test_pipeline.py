"""The pipeline stage by stage, each against what it must do to its own input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from evidentia.llm import language, minhash, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    vocabulary = ["tree", "river", "stone", "cloud", "bread", "table", "window", "garden", "paper", "lamp", "road", "hill"]
    rows = []
    for i in range(240):
        w = rng.choices(vocabulary, k=rng.randint(20, 60))
        if i % 8 == 0:
            w[5] = rng.choice(["vile", "vilest", "vilely"])
        rows.append((i, " ".join(w), "en", "s0" if i % 3 else f"s{i % 5}", 0))
    rows += [(300, rows[10][1], "en", "s1", 0), (301, rows[10][1] + " more", "en", "s1", 0), (302, None, "en", None, 0), (303, "12 34 !", None, "s1", 0), (304, "", "en", "s1", 0)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, int(i % 8 == 0)) for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = [r.doc_id for r in docs.collect()]
    assert set(seen["language"]) == {*range(240), 300, 301}  # no letters: rejected
    assert set(seen["toxicity"]) == {i for i in seen["language"] if i >= 240 or i % 8}
    assert sorted(seen["deduplicate"]) == sorted(set(seen["toxicity"]) - {300, 301})
    assert set(seen["mix"]) <= set(seen["deduplicate"]) and max(map(seen["mix"].count, seen["mix"])) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.start == 0 for r in packed) == len(seen["mix"])


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "deduplicate", "mix", "pack"]
    rows = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.run(spark, folder).collect()
    key = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)
    assert rows and key(rows) == key(again)


def one_of_each_class(rows):
    """The smallest id of each near-duplicate class, every pair of texts compared."""
    grams = []
    for r in rows:
        w = (r.text or "").lower().split()
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if rows[i].text == rows[j].text or both and both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=lambda x: x.doc_id)
    return [*best.values()]


def taken(rows):
    """How often the mix takes each document: targets dealt in rounds, the best seed of each source."""
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    per = Counter()
    for r in rows:
        per[r.source] += size[r.doc_id]
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight, capped = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = sum(per.values()) - 3 * sum(per[s] for s in capped)
        target = {s: 3.0 * per[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * per[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = {}
    draw = lambda i, k: int(hashlib.md5(f"{mixing.SEED + k // 4}|{i}|{size[i]}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) / 2**32
    for s in names:
        whole, p = divmod(target[s] / per[s], 1) if per[s] else (0, 0)
        own = [r.doc_id for r in rows if r.source == s]
        k = min(range(mixing.SEEDS), key=lambda k: abs(sum(size[i] for i in own if draw(i, k) < p) - (target[s] - whole * per[s])))
        out |= {i: int(whole) + (draw(i, k) < p) for i in own}
    return out


def test_run_against_a_plain_version(spark, folder):
    import public_tokenizers
    import tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
    kept = one_of_each_class(docs.collect())
    copies, text = taken(kept), {r.doc_id: r.text for r in kept}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter({i: n for i, n in copies.items() if n})
    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {i: np.array([*encode(text[i], add_special_tokens=False).ids, 1], "<u4") for i in {r.doc_id for r in pieces}}
    covered, filled = Counter(), defaultdict(list)
    for r in pieces:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({(i, k): n for i, n in copies.items() for k in range(len(ids.get(i, ()))) if n})
    for spans in filled.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) <= 2048


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == [*range(1, 14)] and "pipeline" in __spark_entry__.queries()
    assert {"op7_chat_format", "op8_mixing", "op10_topk", "op11_filter_audit", "op13_source_divergence"} <= set(__spark_entry__.oracle_sql())


def test_filters_on_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for stage in (language.keep_identified, minhash.keep_one_each, mixing.mix_sources):
        assert stage(none).count() == 0
