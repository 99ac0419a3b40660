"""Language identification as mixture inference over character n-grams.

Each language has a smoothed distribution over hashed character trigrams,
counted over all labelled documents that may be learned from.  A document is
a mixture: expectation-maximisation estimates the share of each language,
and of the sets of leading languages the one with the highest likelihood
less a penalty of log(n) / 2 for each language is taken.  The prediction is
the set's language with the largest share; that share, smoothed, is the score.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without any labelled document every text is ``und``; ties go to the language
first in order of name; repeated rows are predicted alike; extra columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Trigrams, about, that are counted together: they take 8 bytes each.
COUNTED = 1 << 20
ROUNDS = 30
#: A document is rejected by the filter if no language has this share of it.
LEAST_SHARE = 0.34
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams around each letter; all that is no letter counts as one kind of gap."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    mid = np.flatnonzero(letter)
    h = (code[mid - 1] * np.uint64(0x9E3779B1) + code[mid]) * np.uint64(0x85EBCA77) + code[mid + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64)  # the upper 15 bits


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of rows of a language and a text; about ``COUNTED`` trigrams are held at a time."""
    sums: dict[str, np.ndarray] = {}
    by: dict[str, list] = {}

    def add() -> None:
        for lang, parts in by.items():
            n = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            sums[lang] = sums[lang] + n if lang in sums else n
        by.clear()

    C.fresh()
    for batch in batches:
        held = 0
        for lang, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
            grams = trigrams(text)
            by.setdefault(lang, []).append(grams)
            held += len(grams)
            if held > COUNTED:
                add()
                held = 0
        add()
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all documents that may be learned from; tasks send sums only."""
    known = docs.where(~C.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return known.select("lang", "text").mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their trigram probabilities (languages x BUCKETS).

    What comes to the driver has a row for each language and bucket at most.
    """
    got = count_trigrams(docs).toPandas()
    langs = sorted(got["lang"].unique())
    p = np.full((len(langs), BUCKETS), SMOOTHING)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        p[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, p / p.sum(1, keepdims=True) if langs else p


def _em(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares that maximise the likelihood of counts ``c``, and its logarithm."""
    share = np.full(len(p), 1 / len(p))
    total = c.sum()
    for _ in range(ROUNDS):
        mix = share @ p
        new = share * (p @ (c / mix)) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(c @ np.log(share @ p))


def infer(p: np.ndarray, grams: np.ndarray) -> tuple[int, float, list[int]]:
    """Index of the leading language, its smoothed share, and the selected set."""
    u, c = np.unique(grams, return_counts=True)
    probs, c = p[:, u], c.astype(np.float64)
    n = c.sum()
    share, _ = _em(probs, c)
    order = np.argsort(-share, kind="stable")
    best, chosen, shares = -np.inf, order[:1], np.ones(1)
    for m in range(1, len(order) + 1):
        if m > 1 and share[order[m - 1]] < 1e-3:
            break
        top = order[:m]
        s, ll = _em(probs[top], c) if m > 1 else (np.ones(1), float(c @ np.log(probs[order[0]])))
        if ll - 0.5 * m * np.log(n + 1) > best:
            best, chosen, shares = ll - 0.5 * m * np.log(n + 1), top, s
    lead = int(np.argmax(shares))
    return int(chosen[lead]), float((n * shares[lead] + 1) / (n + len(p))), sorted(int(x) for x in chosen)


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and lang_set added; reads the column text."""
    p = p.astype(np.float32)
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    fields = [f for f in out.schema.fields[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    own = ["lang_pred string", "score double", "lang_set array<string>"]

    def run(batches):
        C.fresh()
        for batch in batches:
            pred, score, sets = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                grams = trigrams(text) if text else ()
                if len(grams) == 0 or not langs:
                    pred.append(UNKNOWN), score.append(0.0), sets.append([])
                    continue
                i, s, chosen = infer(p, grams)
                pred.append(langs[i]), score.append(min(1.0, s)), sets.append([langs[k] for k in chosen])
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols + made, [*[f.name for f in fields], "lang_pred", "score", "lang_set"])

    return out.mapInArrow(run, ", ".join([schema, *own]))


def keep_identified(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The documents with a leading language that has at least ``least`` of their n-grams."""
    names = list(docs.columns)
    work = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"))
    got = identify(work, *fit(docs), [f"c{i}" for i in range(len(names))])
    got = got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = C.table(spark, sf_dir, "documents")
    got = identify(docs, *fit(docs), ["doc_id"])
    return got.select("doc_id", C.held_out().alias("held_out"), "lang_pred", "score", "lang_set")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
