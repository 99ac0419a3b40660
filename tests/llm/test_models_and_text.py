"""Language identification, toxicity and main text."""

from __future__ import annotations

import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import html_text, language, toxicity

DOCS = "doc_id long, text string, lang string, source string, score int, c0 string"
ENGLISH = "the cat and the dog went to the house of the old man with a hat and they ate bread"
GERMAN = "der hund und die katze gingen zum haus des alten mannes mit einem hut und sie aßen brot"


def docs(spark):
    rows = [(i, ENGLISH if i % 2 else GERMAN, "en" if i % 2 else "de", "s", 1, "x") for i in range(40)]
    rows += [(100, None, "en", "s", 1, "x"), (101, "123 !!", None, "s", 1, "x"), (102, ENGLISH + " " + GERMAN, None, "s", 1, "x"), (None, ENGLISH * 50, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_language_of_each_text(spark):
    df = docs(spark)
    got = {r.doc_id: r for r in language.identify(df, *language.fit(df), ["doc_id"]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and got[i].score > 0.8 for i in range(40))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[101].score == 0
    assert set(got[102].lang_set) == {"en", "de"} and 0.3 < got[102].score < 0.7
    assert got[None].lang_pred == "en"


def test_counting_holds_few_trigrams_at_a_time():
    batch = pa.record_batch([pa.array(["en", "de"] * 400), pa.array([ENGLISH * 120, GERMAN * 120] * 400)], ["lang", "text"])
    language._letters()
    tracemalloc.start()
    got = [*language.counted(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {lang: 400 * np.bincount(language.trigrams(text * 120), minlength=language.BUCKETS) for lang, text in (("en", ENGLISH), ("de", GERMAN))}
    assert {b.column(0)[0].as_py() for b in got} == {*want} and peak < 40 << 20, peak  # all of them take 50 MB
    for b in got:
        assert np.array_equal(np.flatnonzero(want[b.column(0)[0].as_py()]), b.column(1)) and want[b.column(0)[0].as_py()].sum() == sum(b.column(2).to_pylist())


def test_a_worker_gives_back_what_a_stage_has_freed():
    script = """
import re, numpy as np
from evidentia.llm import _common as C
mb = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before = mb()
parts = [np.ones(2000 if i % 8 else 200) for i in range(10_000)]
parts = parts[::8]
C.fresh()
print(mb() - before)
"""
    if not sys.platform.startswith("linux"):
        pytest.skip("reads /proc")
    got = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=120)
    assert float(got.stdout) < 40  # 133 MB were held, 2 MB still are


def test_language_filter_keeps_columns_and_clean_rows(spark):
    kept = language.keep_identified(docs(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "c0"]
    assert {r.doc_id for r in kept.collect()} == {*range(40), 102, None}


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 1, "x")], DOCS)
    assert language.identify(df, *language.fit(df), ["doc_id"]).first().lang_pred == "und"
    assert language.identify(df.limit(0), *language.fit(df.limit(0)), ["doc_id"]).count() == 0


def labelled(n=200):
    rng = np.random.default_rng(1)
    calm, rude = "tree river stone cloud bread table window garden".split(), "grubbish grubbed grubster".split()
    texts, toxic = [], []
    for i in range(n):
        w = list(rng.choice(calm, 12))
        bad = i % 4 == 0
        if bad:
            w[3] = rude[i // 4 % 3]
        if bad and rng.random() < 0.8 or not bad and rng.random() < 0.1:
            w[5] = "muslims"  # a spurious sign in the training texts
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_spreads_to_other_forms_and_learns_nothing_held_out(spark):
    texts, toxic = labelled()
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)]
    rows += [(1000, "stone grubbing river", "en", "s", 1, "x"), (1001, None, "en", "s", 1, "x"), (1002, "stone river tree", "en", "s", 1, "x")]
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in enumerate(toxic)] + [(5, None), (9999, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, t in enumerate(toxic))  # the held-out labels were turned round
    assert got[1000] >= 0.3 and got[1001] < 0.3 and got[1002] < 0.3
    kept = toxicity.keep_civil(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}


def test_counterfactual_term_lowers_false_positives_on_group_mentions(spark):
    texts, toxic = labelled(400)
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rng = np.random.default_rng(8)
    calm = "tree river stone cloud bread table window garden".split()
    probes = [" ".join([*rng.choice(calm, 3), "muslims"]) for _ in range(60)] + ["muslims"] * 5  # neutral mentions, never seen
    rude = [" ".join([*rng.choice(calm, 8), "grubbish"]) for _ in range(20)]
    wrong, mention = {}, {}
    for cf in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.fit(df, labels, cf=cf)
        got = toxicity.scores(probes, model, {})
        wrong[cf] = sum(x >= toxicity.THRESHOLD for x in got) / len(probes)
        mention[cf] = np.mean(got) - np.mean(toxicity.scores([p.replace("muslims", "stone") for p in probes], model, {}))
        assert min(toxicity.scores(rude, model, {})) >= toxicity.THRESHOLD
    assert wrong[0.0] > 0 and wrong[toxicity.COUNTERFACTUAL] == 0
    assert mention[toxicity.COUNTERFACTUAL] < mention[0.0] / 3


def test_swaps_leave_features_of_other_words_alone():
    terms = (("women", "womanly"),)
    known = np.unique([f for w in ("women", "womanly", "womb", "tree") for f in toxicity.features_of(w)])
    at = lambda *keys: sorted(int(np.searchsorted(known, f)) for w in keys for f in toxicity.features_of(w))
    gone, come = toxicity.swaps({"women", "tree"}, known, terms)[0]
    assert set(gone) == set(at("women")) - set(at("womanly")) and set(come) == set(at("womanly")) - set(at("women"))
    gone, come = toxicity.swaps({"women", "womanly"}, known, terms)[0]  # all that would come is there already
    assert not come and set(gone) == set(at("women")) - set(at("womanly"))
    assert toxicity.swaps({"tree"}, known, terms) == []


def test_repeated_labelled_ids_are_one_row(spark):
    df = spark.createDataFrame([(1, f"text {i}", "en", "s", 1, "x") for i in range(50)] + [(2, None, "en", "s", 1, "x")], DOCS)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.labelled_sample(df, labels).collect()}
    assert set(got) == {1, 2} and got[1].toxic == 1


def test_features_and_scores_against_brute_force(spark):
    texts, toxic = labelled(120)
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, toxic))], "doc_id long, text string, toxic int")
    n, pos = len(toxic), sum(toxic)
    seen = {}
    for t, y in zip(texts, toxic):
        for f in {f for w in set(t.split()) for f in toxicity.features_of(w)}:
            seen.setdefault(f, [0, 0])[1 - y] += 1
    g = {}
    for f, (a, b) in seen.items():
        cells = [(a, (a + b) * pos / n), (b, (a + b) * (n - pos) / n), (pos - a, (n - a - b) * pos / n), (n - pos - b, (n - a - b) * (n - pos) / n)]
        g[f] = sum(x * np.log(x / e) for x, e in cells if x)
    want = {f for f in sorted(g, key=lambda f: (-round(g[f], 9), f)) if sum(seen[f]) >= 2}
    assert set(toxicity.select_features(sample, pos, n - pos)) == want
    few = toxicity.select_features(sample, pos, n - pos, 8)
    assert min(g[f] for f in few) >= sorted((g[f] for f in want), reverse=True)[7] - 1e-9
    model = toxicity.Model(few, np.arange(8) - 3.0, -0.5)
    weight = dict(zip(few.tolist(), model.weights))
    for t, s in zip(texts, toxicity.scores(texts, model, {})):
        z = -0.5 + sum(weight.get(f, 0) for f in {f for w in set(t.split()) for f in toxicity.features_of(w)})
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12


def test_held_out_toxicity(spark):
    path = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert len(got) > 800 and np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.9  # some labels of the table contradict their texts


def test_held_out_languages(spark):
    path = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{path}/documents.parquet").where("lang is not null and length(text) > 100").select("doc_id", "lang")
    got = language.op3_language_id(spark, path).where("held_out").join(known, "doc_id").collect()
    assert len(got) > 150 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_mixture_inference_against_brute_force():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(40, 0.3), 3)
    for share in ([1, 0, 0], [0.7, 0.3, 0], [0.2, 0.5, 0.3]):
        grams = rng.choice(40, 400, p=np.array(share) @ p)
        counts = np.bincount(grams, minlength=40)
        loglik = lambda s, of: float(counts @ np.log(np.maximum(np.array(s) @ p[list(of)], 1e-300)))
        grid = np.linspace(0, 1, 101)
        best = {}  # set of languages -> (likelihood, shares), by a grid
        for of in [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]:
            points = [(1.0,)] if len(of) == 1 else [(x, 1 - x) for x in grid] if len(of) == 2 else [(x, y, 1 - x - y) for x in grid for y in grid if x + y <= 1]
            best[of] = max((loglik(s, of), s) for s in points)
        want = max(best, key=lambda of: best[of][0] - 0.5 * len(of) * np.log(401))
        lead, score, chosen = language.infer(p, grams)
        assert tuple(chosen) == want and lead == want[int(np.argmax(best[want][1]))]
        assert abs(score - (400 * max(best[want][1]) + 1) / 403) < 0.02


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", "en", "s", 1, "x")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, none), ["doc_id"]).first().score == 0.0


LONG = "This is the text of the article and it is long enough to be seen as text by all of the rules that there are."


def test_main_text_of_pages():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><p>The site of the paper</p></header>"
        f"<nav><ul><li><a href=/a>The home of it</a></ul></nav><div class='cookie-notice'>{LONG}</div><!-- {LONG} --><article><h1>Head</h1><p><b>First &amp; line.<br><p>{LONG}</p>"
        f"<p>Ea.</p><form>{LONG}<input></form><aside>{LONG}</aside><p>A&nbsp;&lt;b&gt;  end</p></article><section id=comments><p>{LONG}</p></section><footer>&copy; x</footer>"
    )
    assert html_text.main_text(page) == f"Head\nFirst & line.\n{LONG}\nEa.\nA <b> end"


def test_pages_without_an_article_element():
    page = f"<div id=menu>{LONG}</div><div><p>Short start.</p><p>{LONG}</p><p>Short end.</p></div><div><a href=x>{LONG}</a></div><div style='display:none'>{LONG}</div>"
    assert html_text.main_text(page) == f"Short start.\n{LONG}\nShort end."
    assert html_text.main_text(f"<nav><a>x</a><article><p>{LONG}") == LONG  # containers left open
    assert html_text.main_text("") == html_text.main_text(None) == ""


def test_markup_is_read_as_browsers_do():
    read = html_text.main_text
    assert read(f'<article><p>{LONG}</p><script>document.write("<p>boo the of and</p>")</script><p>{LONG}</p>') == f"{LONG}\n{LONG}"
    assert read(f'<article><p>{LONG} <img alt="a > b" src=x> y</p></article>') == f"{LONG} y"
    assert read(f"<p>a < b and 1<2 {LONG}</p>") == f"a < b and 1<2 {LONG}"
    assert read(f"<p>{LONG}</p><p>{LONG}<a hre") == f"{LONG}\n{LONG}"
    assert read(f"<head><title>t</title><body><p>{LONG}<svg><text>z</text></svg> q</p>") == f"{LONG} q"


read = html_text.main_text


@pytest.mark.parametrize("name", ["comment-body", "post-comments", "entry-comments", "site-footer", "sidebar-content", "cookie-text", "ad-container", "main-nav", "articleComments", "CommentList", "siteFooter", "sidebar_inner"])
def test_names_of_what_stands_around_an_article(name):
    for page in (f'<p>{LONG}</p><div class="{name}"><p>{LONG} more of it</p></div>', f'<article><h1>The T</h1><p>{LONG}</p><div class="x {name}"><p>{LONG} more of it</p></div></article>'):
        assert "more of it" not in read(page) and LONG in read(page)


@pytest.mark.parametrize("name", ["article-body", "post-content", "entry", "mainContent", "sidebar-article", "page-with-sidebar", "noSidebar", "has-comments", "shareholder", "adfree", "story"])
def test_names_of_the_text_itself(name):
    assert read(f'<p>{LONG}</p><div class="{name}"><p>{LONG} more of it</p></div>') == f"{LONG}\n{LONG} more of it"


def test_a_page_of_one_block_rich_in_links_is_kept():
    linked = f"See <a href=/a>{LONG}</a> and what it says of that."
    assert read(f"<article><p>{linked}</p></article>") == f"See {LONG} and what it says of that."
    assert read(f"<nav>{linked}</nav>") == "" and read(f"<p><a href=/a>{LONG}</a></p>") == ""


class Plain(HTMLParser):
    """Blocks of a well-formed page, read by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.text, self.linked = [], [], "", 0

    def flush(self):
        if self.text.split():
            self.blocks.append((" ".join(self.text.split()), self.linked, [*self.path]))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.flush()
        self.path.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.flush()
        self.path.pop()

    def handle_data(self, data):
        self.text += data
        if any(t == "a" for t, _ in self.path):
            self.linked += len("".join(data.split()))


def plain_text(page):
    """The two passes as the docstring has them, block by block against all others."""
    parser = Plain()
    parser.feed(page)
    parser.flush()
    seen = Counter(w for text, _, _ in parser.blocks if len(text) >= 70 for w in {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) <= 5})
    stops = html_text.STOP_WORDS | {w for w, n in seen.items() if n >= 3}
    share = lambda text: sum(w in stops for w in re.findall(r"[^\W\d_]+", text.lower())) / max(1, len(re.findall(r"[^\W\d_]+", text)))
    out = [(text, any(t in html_text.AROUND for t, _ in path), any(t in ("article", "main") for t, _ in path), linked / len("".join(text.split())), any(a.get("class") == "ad" for _, a in path)) for text, linked, path in parser.blocks]
    known = any(share(text) >= 0.05 for text, around, *_ in out if len(text) >= 70 and not around)

    def first(text, around, article, links, ad):
        if around or ad or links > 0.4:
            return "bad"
        if article:
            return "" if len(text) < 70 and share(text) < 0.25 else "good"
        if len(text) < 70 or not known:
            return "" if len(text) < 70 else "good"
        return "good" if share(text) >= 0.25 else "" if share(text) >= 0.05 else "bad"

    labels = [first(*b) for b in out]
    for i, b in enumerate(out):
        near = [(abs(i - j), x == "bad") for j, x in enumerate(labels) if x and out[j][2] == b[2]]
        if not near and not b[2]:
            near = [(abs(i - j), x == "bad") for j, x in enumerate(labels) if x]
        if labels[i] == "good" or not labels[i] and not (near and min(near)[1]):
            yield b[0]


def test_against_a_plain_version():
    rng = random.Random(4)
    words = "the of and in is that was for with a to this stone river garden window letter morning silver engine market".split()
    rare = "stone river garden window letter morning silver engine market copper basalt".split()
    said = lambda n: " ".join(rng.choices(rng.choice([words, words, rare]), k=n))
    compared = 0
    for _ in range(600):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            text = said(rng.choice([2, 5, 12, 30]))
            text = rng.choice([text, text, text, f"<a href='/x'>{text}</a>", f"{said(3)} <a href='/x'>{said(6)}</a> &amp; <b>{said(2)}</b>"])
            tag = rng.choice(["p", "p", "p", "div", "nav", "footer", "h2", "blockquote"])
            parts.append(f"<{tag}{rng.choice(['', '', '', ' class="ad"'])}>{text}</{tag}>")
        cut = rng.randrange(len(parts) + 1)
        page = "".join(parts[:cut]) + rng.choice(["{}", "<article>{}</article>", "<div><main>{}</main></div>"]).format("".join(parts[cut:]))
        want = "\n".join(plain_text(page))
        if want:
            assert read(page) == want, page
        compared += bool(want)
    assert compared > 200


def test_hints_do_not_lose_a_page():
    read = html_text.main_text
    assert read(f'<body class="has-sidebar"><p>{LONG}</p></body>') == LONG
    assert read(f'<div class="no-sidebar"><p>{LONG}</p></div>') == LONG
    assert read(f'<div class="sidebar-first"><h1>The head of it</h1><p>{LONG}</p></div>') == f"The head of it\n{LONG}"
    assert read(f'<div class="sidebar"><p>{LONG}</p></div><p>{LONG}</p>') == LONG
    assert read(f'<article><h1>The T</h1><p>{LONG}</p></article><section class="comments"><p>{LONG}</p><p>{LONG}</p></section>') == f"The T\n{LONG}"
    assert read(f"<article><p>The firm &copy; {LONG}</p></article>") == f"The firm © {LONG}"


def test_pages_in_other_languages():
    polish = "Wczoraj rano na rynku w Krakowie spotkali się mieszkańcy, którzy chcą w tym roku na nowo urządzić park."
    assert html_text.main_text(f"<ul><li><a href=x>Start</a></ul><div><p>{polish}</p><p>{polish} {polish}</p></div>") == f"{polish}\n{polish} {polish}"


@pytest.mark.parametrize(
    "page", ["<a " + '"" ' * 300_000, "<a b " * 200_000, "<a x=" + "'\"'\"" * 200_000, "<div>" * 100_000 + "x", "<div class=ad>x" * 50_000, "<div><article>x" * 30_000, "<!--" * 200_000, "<script>" * 100_000]
)
def test_malformed_megabytes_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10


def test_extraction_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (2, None, f"<article>{LONG}\n x", 4)], "page_id long, url string, html string, text int")
    rows = sorted(map(tuple, html_text.extract_pages(df).collect()))
    assert rows == [(1, "u", "", 0), (1, "u", "", 0), (2, None, LONG + " x", len(LONG) + 2)]
    assert html_text.extract_pages(df.limit(0)).count() == 0
