"""Encoding, packing and token counts against the tokenizer library and by round trip."""

from __future__ import annotations

import gc
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import encoder, language, packing, token_counts
from evidentia.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  ", "it's we'll Éa ½x² a_b--c", "naïve — “quoted” …", "日本語 text", "é combined", "ΣΑΣ x", "a\xa0b\x1cc", "ǅ Ǆ ß İ", "x​y\n\n\tz'S 'RE", "😀a🙂",
    "a <|endoftext|> b", "<|startoftext|>x", "<|ENDOFTEXT|>", "Ɛ!", "NƆ9 x", "Ɓa Ⱥ",
    "The quick brown fox, the lazy dog.\nA second line!\n", "word " * 3000,
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_offsets_as_the_library(library):
    own = WordEncoder(PATH, cache_size=5)  # a cache that overflows all the time changes nothing
    for text in TEXTS * 2:
        want = library.encode(text, add_special_tokens=False)
        ids = own.ids_of([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        starts, ends = own.offsets(text, ids)
        assert list(zip(starts.tolist(), ends.tolist())) == [tuple(o) for o in want.offsets]


def test_random_strings_agree_with_the_library(library):
    rng, own = random.Random(1), WordEncoder(PATH)
    pool = [*map(chr, range(0x20, 0x260)), *"abcdeABC   '.,\n" * 20]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) + rng.choice(["", "", "<|endoftext|>", "'LL", "é", "日本"]) + rng.choice(["", " x"])
        want = library.encode(text, add_special_tokens=False)
        ids = own.ids_of([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert list(zip(*(x.tolist() for x in own.offsets(text, ids)))) == [tuple(o) for o in want.offsets], text


def test_a_part_of_texts_looks_up_what_is_distinct_in_it(library):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    own = WordEncoder(PATH)
    own.pieces = Counted()
    texts = [" The cat,\n sat", "", None, "日本語 the", "the  THE cat, " * 50, "x" * 9, "\t"] * 20
    got, places = [], []
    for at, part in encoder.in_parts(texts, 1500):
        places.append((at, len(part)))
        got += own.ids_of(part)
    assert got == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [a + n for a, n in places] == [a for a, _ in places[1:]] + [len(texts)] and len(places) > 9
    assert own.pieces.asked <= 5 * len(places)  # the, cat, the comma, sat, x...
    assert [*encoder.in_parts([])] == [] and [*encoder.in_parts(["abc", "d"], 2)] == [(0, ["abc"]), (1, ["d"])]


def test_packing_is_a_round_trip(spark, library):
    texts = [*TEXTS, None, "word " * 3000]
    rows = packing.pack_documents(frame(spark, texts), PATH, size=256, open_windows=3).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(range(len(texts)))
    for doc, ps in pieces.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    used = []
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        used.append(at)
    assert sum(256 - u for u in used) < 4 * 256  # at most a window or so a partition is not full


def test_packing_repeated_rows_and_empty_table(spark):
    docs = frame(spark, ["a b c"])
    assert packing.pack_documents(docs.union(docs), PATH).count() == 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_counts_by_line_add_up(spark, library):
    texts = [*TEXTS, None]
    rows = token_counts.count_by_section(frame(spark, texts), PATH).collect()
    for doc, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.section)
        want = library.encode(text or "", add_special_tokens=False)
        assert sum(r.n_tokens for r in own) == len(want.ids) == own[0].doc_tokens
        for r in own:
            assert r.n_tokens == sum(r.start <= a < r.stop for a, _ in want.offsets)


def test_the_query_cuts_tokens_and_gives_them_by_majority(spark, library, tmp_path):
    rng = random.Random(4)
    texts = [*TEXTS, None, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 30))) for _ in range(400)), "ab\n" * 3 + "x" * 1001 + "\n"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.section): (r.start, r.stop, r.n_tokens) for r in token_counts.op9_token_counts(spark, str(tmp_path)).collect()}
    want, crossed = {}, 0
    for doc, text in enumerate(texts):
        spans, at = [], 0
        for line in re.findall(r"[^\n]*\n|[^\n]+$", text or "") or [""]:
            spans += [(at + i, min(at + i + token_counts.SECTION, at + len(line))) for i in range(0, max(1, len(line)), token_counts.SECTION)]
            at += len(line)
        n = [0] * len(spans)
        for a, b in library.encode(text or "", add_special_tokens=False).offsets:
            held = [max(0, min(b, hi) - max(a, lo)) for lo, hi in spans]
            crossed += sum(x > 0 for x in held) > 1
            n[held.index(max(held))] += 1
        want |= {(doc, k): (*s, c) for k, (s, c) in enumerate(zip(spans, n))}
    assert crossed > 10 and got == want


def test_crossing_tokens_follow_the_rule():
    starts, ends = np.array([0, 3, 8, 20]), np.array([3, 8, 12, 22])
    lo, hi = np.array([0, 5, 10]), np.array([5, 10, 14])
    assert token_counts.attribute(starts, ends, lo, hi, "first").tolist() == [0, 0, 1, -1]
    assert token_counts.attribute(starts, ends, lo, hi, "majority").tolist() == [0, 1, 1, -1]
    with pytest.raises(ValueError):
        token_counts.count_by_section(None, PATH, rule="other")


def test_what_the_encoder_keeps_is_dropped_by_other_stages(spark, monkeypatch):
    """Workers are used again: after packing they would hold its caches, and no garbage collection, while they read the next table."""
    gc.disable()
    kept = encoder.encoder(PATH)
    assert encoder.encoder(PATH) is kept and kept.ids_of(["a word"])
    docs = [pa.record_batch([pa.array(["en"]), pa.array(["a word"])], ["lang", "text"])]
    df = spark.createDataFrame([(1, "a word", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda df, f, schema: [*f(iter(docs))] and df.select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")]))
    language.count_trigrams(df)
    assert not encoder._KEPT and gc.isenabled()
