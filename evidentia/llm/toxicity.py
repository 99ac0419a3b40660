"""A toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and of word beginnings (which
inflected forms share).  Its loss has, besides the usual L2 term, the mean
squared change of the score when an identity term of a labelled text is
swapped for another one: the mention of a group must not decide.

The identity terms are a parameter (``IDENTITY_TERMS`` by default).  Where no
labelled text has one, as in the synthetic tables, the counterfactual term is
empty and the model is the plain logistic one.

Fitting: a sample of at most ``MAX_LABELLED`` labelled documents, drawn by hash
of the id among those that may be learned from; the statistics that select the
``N_FEATURES`` features cover that whole sample.  Scoring covers all rows.

Defined cases: a text without words (null, empty) scores 0; contradictory labels count as toxic; null labels and labels
without a document are left out; of labelled rows that share an id one text is
learned from, the first by hash; without labelled rows of both kinds the
score is 0 for all; repeated rows score alike; extra columns do not matter;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MAX_LABELLED = 20_000
N_FEATURES = 1024
#: Lengths of the word beginnings that are features beside the word.
PREFIXES = (4, 5, 6)
L2, COUNTERFACTUAL = 0.02, 10.0
#: Steps of the descent, without and with counterfactuals, which make the problem stiffer.
ROUNDS = (300, 1500)
#: A missed toxic text counts as much as so many others taken for toxic.
TOXIC_WEIGHT = 2.0
THRESHOLD = 0.3
CACHE = 400_000
#: Terms that name groups neutrally; within a row they may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "muslim", "muslims", "jewish", "jews", "christian", "christians",
     "hindu", "hindus", "buddhist", "atheist", "black", "white", "asian", "latino", "african", "european", "immigrant", "immigrants", "refugee",
     "refugees", "disabled", "deaf", "blind", "elderly"),
    ("frauen", "männer", "schwule", "lesben", "muslime", "juden", "christen", "flüchtlinge", "migranten", "behinderte"),
    ("femmes", "hommes", "musulmans", "juifs", "chrétiens", "immigrés", "réfugiés", "handicapés"),
    ("mujeres", "hombres", "musulmanes", "judíos", "cristianos", "inmigrantes", "refugiados", "discapacitados"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """64-bit hashes of the word and of its beginnings, as signed integers."""
    keys = [f"w {word}", *[f"p {word[:k]}" for k in PREFIXES if len(word) >= k]]
    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(k)) >> 63 else x for k in keys]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, toxic of at most ``most`` documents, a row for each; the ids are broadcast, as their number is bounded."""
    known = labels.where(~C.held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("__toxic").alias("toxic"))
    return C.stored(rows, "labelled")


def _counted(sample: DataFrame) -> DataFrame:
    """feature, pos, neg: in how many toxic and other texts of the sample a feature occurs."""

    def count(batches):
        C.fresh()
        for batch in batches:
            cols: list[list] = [[], []]
            for text, toxic in zip(*(batch.column(k).to_pylist() for k in range(2))):
                cols[toxic > 0].append(np.unique(np.array([f for w in words(text) for f in features_of(w)], np.int64)))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            for k, c in enumerate(flat):
                f, n = np.unique(c, return_counts=True)
                zero = np.zeros(len(f), np.int64)
                yield pa.record_batch([pa.array(f), pa.array(n if k else zero), pa.array(zero if k else n)], ["feature", "pos", "neg"])

    return sample.select("text", "toxic").mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def select_features(sample: DataFrame, n_pos: int, n_neg: int, most: int = N_FEATURES) -> np.ndarray:
    """The features whose presence says most about the label (G statistic), sorted."""
    n = n_pos + n_neg
    a, b = F.col("pos"), F.col("neg")

    def term(seen, of):
        """seen * log(seen / expected) for one cell of the table of presence against label."""
        expected = (a + b) * F.lit(of / n)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    def absent(seen, of):
        rest = F.lit(of) - seen
        expected = (F.lit(n) - a - b) * F.lit(of / n)
        return F.when(rest > 0, rest * F.log(rest / expected)).otherwise(0.0)

    g = term(a, n_pos) + term(b, n_neg) + absent(a, n_pos) + absent(b, n_neg)
    top = _counted(sample).where(a + b >= 2).orderBy(g.desc(), "feature").limit(most).select("feature")
    return np.sort(top.toPandas()["feature"].to_numpy(np.int64))


def _positions(known: np.ndarray, word: str) -> list[int]:
    """Indexes of a word's features among the known ones."""
    f = np.array(features_of(word), np.int64)
    at = np.searchsorted(known, f)
    at[at == len(known)] = 0
    return at[known[at] == f].tolist()


def swaps(said: set[str], known: np.ndarray, groups=IDENTITY_TERMS) -> list[tuple[list[int], list[int]]]:
    """For each identity term among a text's words: the features that go and that come when the next term of its group stands there.

    A feature that another word of the text also has neither goes nor comes.
    """
    out = []
    for g in groups:
        for i, term in enumerate(g):
            if term in said:
                others = {x for w in said if w != term for x in _positions(known, w)}
                before, after = set(_positions(known, term)), set(_positions(known, g[(i + 1) % len(g)]))
                gone, come = sorted(before - after - others), sorted(after - before - others)
                if gone or come:
                    out.append((gone, come))
    return out


def _rows_of(sample: DataFrame, known: np.ndarray, groups) -> tuple[list, np.ndarray, list]:
    """On the driver, bounded by the sample: present features and labels of each document, and the changes of all swaps."""
    schema = "at array<int>, toxic int, gone array<array<int>>, come array<array<int>>"

    def read(batches):
        C.fresh()
        for batch in batches:
            at, toxic, gone, come = [], [], [], []
            for text, t in zip(*(batch.column(k).to_pylist() for k in range(2))):
                ws = words(text)
                f = np.unique(np.array([x for w in ws for x in features_of(w)], np.int64))
                i = np.minimum(np.searchsorted(known, f), len(known) - 1)
                at.append(i[known[i] == f].astype(np.int32))
                toxic.append(int(t > 0))
                changes = swaps(ws, known, groups)
                gone.append([c[0] for c in changes])
                come.append([c[1] for c in changes])
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(at, pa.list_(pa.int32())), pa.array(toxic, pa.int32()), pa.array(gone, lists), pa.array(come, lists)], ["at", "toxic", "gone", "come"])

    got = sample.orderBy("doc_id").select("text", "toxic").mapInArrow(read, schema).toPandas()
    changes = [(np.concatenate([x, y]).astype(np.int64), np.array([-1.0] * len(x) + [1.0] * len(y))) for g, c in zip(got["gone"], got["come"]) for x, y in zip(g, c)]
    return got["at"].tolist(), got["toxic"].to_numpy(np.float64), changes


def _sparse(rows: list, values: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if sum(sizes) else np.zeros(0, np.int64)
    val = np.concatenate(values) if values and sum(sizes) else np.ones(len(col))
    return row, col, val


def fit_weights(rows: list, y: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], dim: int, l2: float = L2, cf: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + l2 |w|^2 / 2 + cf * mean (change of score)^2 / 2.

    ``changes`` has, for each swap, the features that move and +1 or -1 for each.
    """
    r, c, _ = _sparse(rows)
    cr, cc, cv = _sparse([x[0] for x in changes], [x[1] for x in changes])
    n, m = len(y), max(1, len(changes))
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    weight /= weight.sum()
    size = np.bincount(r, minlength=n)
    step = 1 / (0.25 * (weight @ (size + 1)) + l2 / n + cf * (max((len(x[0]) for x in changes), default=0)) / m * len(changes))
    w, b, vw, vb = np.zeros(dim), 0.0, np.zeros(dim), 0.0
    for t in range(ROUNDS[bool(len(changes) and cf)]):
        uw, ub = vw, vb
        z = np.bincount(r, uw[c], minlength=n) + ub
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(c, e[r], minlength=dim) + l2 / n * uw
        if len(changes):
            d = np.bincount(cr, cv * uw[cc], minlength=len(changes))
            gw += cf / m * np.bincount(cc, cv * d[cr], minlength=dim)
        w2, b2 = uw - step * gw, ub - step * e.sum()
        k = t / (t + 3)
        vw, vb, w, b = w2 + k * (w2 - w), b2 + k * (b2 - b), w2, b2
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY_TERMS, cf: float = COUNTERFACTUAL) -> Model | None:
    sample = labelled_sample(docs, labels)
    n = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not n[0] or not n[1]:
        return None
    known = select_features(sample, n[0], n[1])
    if not len(known):
        return None
    rows, y, changes = _rows_of(sample, known, groups)
    w, b = fit_weights(rows, y, changes, len(known), cf=cf)
    return Model(known, w, b)


def scores(texts: list[str | None], model: Model, cache: dict[str, tuple]) -> list[float]:
    out = []
    for text in texts:
        hit: set[int] = set()
        said = words(text)
        if not said:
            out.append(0.0)
            continue
        for w in said:
            at = cache.get(w)
            if at is None:
                if len(cache) > CACHE:
                    cache.clear()
                at = cache[w] = tuple(_positions(model.features, w))
            if at:
                hit.update(at)
        z = model.intercept + (model.weights[sorted(hit)].sum() if hit else 0.0)
        out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
    return out


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the toxicity score of the column text."""
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    fields = out.schema.fields[:-1]
    if model is None:
        return out.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"))

    def run(batches):
        C.fresh()
        cache: dict[str, tuple] = {}
        for batch in batches:
            got = scores(batch.column(batch.num_columns - 1).to_pylist(), model, cache)
            cols = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.float64())], [*[f.name for f in fields], "score"])

    return out.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double"]))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    names = list(docs.columns)
    work = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"))
    got = score(work, fit(docs, labels), [f"c{i}" for i in range(len(names))]).where(F.col("score") < threshold)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = C.table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, C.table(spark, sf_dir, "labels")), ["doc_id"])
    return got.select("doc_id", C.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
