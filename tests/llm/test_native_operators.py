"""Fingerprints, chat formatting, mixing and top-k: brute force, round trips, defined cases."""

from __future__ import annotations

import hashlib
import json
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import chat, fingerprints, mixing, topk

DOCS = "doc_id long, text string, source string, size int, cell int"


def chain(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_marks(text: str) -> set[int]:
    units = re.findall(r"[\u0e00-\U0010ffff]|[^\s\u0e00-\U0010ffff]{1,4}", text, re.A)
    h = [chain(u) for u in units]
    g = [chain(h[i], h[i + 1]) for i in range(len(h) - 1)]
    found = [(i, chain(g[i], g[i + 2], h[i + 4])) for i in range(len(h) - 4) if min(g[i], g[i + 3]) <= min(g[i + 1], g[i + 2])] or [(0, chain(text))]
    gaps = [struct.pack("<i", b[0] - a[0]) for a, b in zip(found, found[1:])]
    head = [chain(struct.pack("<i", i + 1), text[i : i + 2]) for i in range(min(len(text), fingerprints.HEAD) - 1)]
    return {x >> 32 for x in [*(chain(x, gap) for (_, x), gap in zip(found, gaps)), chain(found[-1][1]), *head]}


def likeness(a, b):
    return len(a & b) / len(a | b)


TEXTS = ["", None, "ab", "short text, in characters 😀", "w1 w2\nw3 " * 60 + "end", " ".join(f"word{i}" for i in range(700)), " ".join(f"word{i}" for i in range(700)), "ab", "日本語の文章" * 40, "x" * 5]


def test_fingerprints_against_brute_force(spark, tmp_path):
    rows = [(i * 7, t, "s", 1, 2) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    ids = sorted(got, reverse=True)
    text = {i * 7: t or "" for i, t in enumerate(TEXTS)}
    assert set(got) == set(text)
    hexed = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in sorted(s)[: fingerprints.SKETCH])
    for k, i in enumerate(ids):
        t, nxt = text[i], text[ids[(k + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = map(brute_marks, (t, edited, nxt))
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(a), hexed(b))
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, c)) < 1e-12
    assert got[35].fingerprint == got[42].fingerprint


def test_likeness_does_not_hang_on_length_or_script(spark, tmp_path):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400))
    signs = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(3000))
    blob = "".join(rng.choices("abcdefghij", k=3000))
    texts = {10: prose[:450], 9: "eight ch", 8: signs, 7: "x", 6: blob, 5: "", 4: prose[:405], 3: prose[:395], 2: prose[:80], 1: "end"}
    spark.createDataFrame([(i, t, "s", 1, 2) for i, t in texts.items()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    for i in (10, 8, 6, 4, 2):
        assert 0.3 < got[i].near_edited < 0.75, (i, got[i].near_edited)
    assert got[4].near_next > 0.9 and got[10].near_next == 0


def test_the_next_row_over_cells(spark):
    ids = [None, None, *range(-40, 300, 7), 5, 5, 5, *[100] * 60, 10**15]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    for frame in (df, df.where("doc_id is not null"), df.where("doc_id is null"), df.limit(1)):
        rows = fingerprints.with_next(frame, ["text", "doc_id"], per_cell=5).collect()
        order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), chain(r.text)))
        assert [(r.next_doc_id, r.next_text) for r in order] == [(r.doc_id, r.text) for r in order[1:] + order[:1]]
    cuts = list(range(0, 2000, 3))
    got = spark.range(-5, 2010).select("id", fingerprints._cell_of(F.col("id"), cuts, fan=16).alias("c")).collect()
    assert all(r.c == sum(c < r.id for c in cuts) for r in got if r.id <= cuts[-1])


def test_short_texts_are_graded(spark, tmp_path):
    texts = ["a short line of it", "quite another one", "wxyz", "abc", "zz", "q", "", "nineteen characters", "twenty-two characters!"]
    spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()}
    for i in (0, 1, 2, 3, 7, 8):
        assert 0.1 < got[i].near_edited < 0.9, (i, got[i].near_edited)
    assert {i: r.near_next for i, r in got.items() if r.near_next >= 0.1} == {}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(i, f"t{i}", i, i, i) for i in range(9)], "doc_id long, text string, cell int, next int, head int")
    got = fingerprints.with_next(df, ["text"], per_cell=2).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "cell", "next", "head", "next_text"} and all((r.cell, r.next, r.head) == (r.doc_id,) * 3 and r.next_text == f"t{(r.doc_id - 1) % 9}" for r in got)


def test_fingerprints_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprints.op6_fingerprints(spark, str(tmp_path)).count() == 0


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\<|im_end|>", "<\\|im_end|>", "[\\INST] \\\\", "a\nb\\", "<<SYS>> <</SYS>> <s>", "", None, "<", "<|im_end|", "x" * 20000]


def test_chat_round_trip_and_loss_spans(spark):
    roles = ["user", "assistant", "we<|im_end|>ird\nrole\\", None]
    rows = [(1, k, roles[k % 4], t, 9) for k, t in enumerate(NASTY * 3)] + [(2, 0, "assistant", "x", 9), (2, 0, "assistant", "x", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_rows(chat.canonical_rows(df))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_spans(F.col("formatted")).alias("spans")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert [t.text for t in got[2].turns] == ["x", "x"]
    masked = [got[1].formatted[s.start : s.stop] for s in got[1].spans]
    assert len(masked) == 9 and masked == [s.text for s in got[1].spans]
    texts = [r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant"]
    plain = spark.createDataFrame([(m,) for m in masked], "m string").select(chat.unescape(F.col("m"))).collect()
    assert [r[0] for r in plain] == texts
    body = got[1].formatted.replace(chat.START, "").replace(chat.END, "")
    assert not any(c in body for c in chat.CONTROL)
    assert chat.format_rows(chat.canonical_rows(df.limit(0))).count() == 0


def test_layouts_are_chosen_by_fingerprint(spark):
    payloads = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"output":"a","instruction":"q"}', '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","completion":"a"}', '{"prompt":"q","response":"a"}',
        '{"turns":[{"speaker":"user","text":"q"},{"speaker":"bot","text":"a"}]}', '{"unknown":1}', "not json", None, "[1]", "{}",
        '{"id":7,"messages":[{"name":"n","role":"user","content":"q"},{"role":"assistant","content":"a","x":[1]}],"meta":{"a":1}}',
        '{"prompt":"q","output":"z","completion":"a","extra":null}', '{"messages":[]}',
    ]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    got = [r[0] for r in df.select(chat.turns_of_payload(F.col("payload"))).collect()]
    text = [[(t.role, t.text) for t in g] if g else g for g in got]
    assert text[6] == [("user", "q"), ("assistant", "a")]
    assert all(t == [("user", "q"), ("assistant", "a")] for t in text[:7]) and text[7:12] == [None] * 5
    assert text[12] == text[13] == [("user", "q"), ("assistant", "a")] and text[14] == []
    one_short = '{"messages":[{"role":"user"},{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'
    got = spark.createDataFrame([(one_short,)], "payload string").select(chat.turns_of_payload(F.col("payload"))).first()[0]
    assert [(r.role, r.text) for r in got] == [("user", None), ("user", "q"), ("assistant", "a")]  # one message without content costs that message's text only
    paths = ["prompt", "completion"]
    assert spark.range(1).select(chat._hashed(F.array(*map(F.lit, paths)))).first()[0] == chat.fingerprint(paths)
    with pytest.raises(ValueError):
        chat.canonical_rows(df)


def test_mixing_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if s == 5 else f"s{s}", 1, 2) for i, s in enumerate(rng.choice(6, 900, p=[0.5, 0.2, 0.1, 0.1, 0.08, 0.02]))]
    docs = spark.createDataFrame([*rows, (5000, None, "s0", 1, 2)], DOCS)
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.copies(sizes, mixing.source_targets(sizes)).collect()
    per = defaultdict(int)
    for r in got:
        per[r.source] += r.size
    names = sorted((s for s in per if s), key=str) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # dealt in rounds
        rest = sum(per.values()) - sum(3 * per[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * per[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * per[s] + 1e-9}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 60 for s in names)
    again = {r.doc_id: r.copies for r in mixing.copies(sizes.repartition(7), mixing.source_targets(sizes)).collect()}
    assert again == {r.doc_id: r.copies for r in got}

    def draw(doc, size, k):
        return int(hashlib.md5(f"{mixing.SEED + k // 4}|{doc}|{size}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) / 2**32

    for s in names:  # every copy beyond the whole ones is a draw of the one seed that comes nearest
        own, rate = [r for r in got if r.source == s], target[s] / per[s]
        p = rate - int(rate + 1e-9)
        if p > 1e-6:
            words = [sum(r.size * (draw(r.doc_id, r.size, k) < p) for r in own) for k in range(mixing.SEEDS)]
            k = min(range(mixing.SEEDS), key=lambda k: abs(words[k] - p * per[s]))
            assert all(r.copies == int(rate) + (draw(r.doc_id, r.size, k) < p) for r in own)


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, "a b c", "s", 1, 2, 3, 4) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size_ int, times int, copy int, __size int")
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows


def test_mixing_emits_documents_as_often_as_taken(spark):
    rows = [(i, "a b c", f"s{i % 2}", 7, i) for i in range(30)] + [(3, "a b c", "s1", 7, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs)
    sizes = docs.select("doc_id", "source", F.lit(3).cast("long").alias("size"))
    want = defaultdict(int)
    for r in mixing.copies(sizes, mixing.source_targets(sizes)).collect():
        want[r.doc_id] += r.copies
    have = defaultdict(int)
    for r in out.collect():
        have[r.doc_id] += 1
    assert out.columns == docs.columns and dict(have) == {k: v for k, v in want.items() if v}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    vec = np.round(centres[np.repeat(np.arange(12), 50)] + 0.1 * rng.normal(size=(600, 8)), 2)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vec)]
    rows += [(700, None, 1), (800, [1.0, None] + [0.0] * 6, 1), (900, [float("nan")] * 8, 1), (1000, [0.5] * 3, 1), (10, vec[10].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    q = topk.quantised(df)
    got = defaultdict(list)
    for r in topk.top_k(q, F.col("vec_id") % 100 == 0, k=10, block=8, per_query_block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    data = [(r.vec_id, np.array([*r.v, *[0] * (8 - len(r.v))])) for r in q.collect()]
    want = {i: sorted(((j, int(v @ w)) for j, w in data if j != i), key=lambda x: (-x[1], x[0]))[:10] for i, v in data if i % 100 == 0}
    assert dict(got) == want
    assert topk.top_k(q.limit(0), F.lit(True)).count() == 0


def test_json_is_not_needed_for_rows(spark):
    other = spark.createDataFrame([("c", 0, "user", json.dumps({"a": 1}))], "conversation_id string, index int, `from` string, value string")
    assert chat.canonical_rows(other).columns == ["conv_id", "turn", "role", "text"]
