"""Offset-mapped token attribution.

Every document is encoded once, whole.  The character spans of its tokens
are joined with the spans of its sections (sorted starts, binary search),
and each token is counted for exactly one section:

``majority``  the section that holds most of its characters, the earlier on a tie;
``first``     the section that holds its first character.

Characters that no section covers form section -1.  The query's sections are
lines, those of more than SECTION characters cut into parts of that many, so
that tokens do cross their boundaries.

Defined cases: a null or empty text has one empty section with no tokens;
repeated rows are counted each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as C
from .encoder import encoder, in_parts

RULES = ("majority", "first")
#: Characters of a section at most.
SECTION = 200
COUNTS = "doc_id long, section int, start long, stop long, n_tokens long, doc_tokens long"


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections, each with the line feed that ends it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.flatnonzero(code == 10) + 1
    stops = cuts if len(cuts) and cuts[-1] == len(text) else np.append(cuts, len(text))
    return np.concatenate([[0], stops[:-1]]).astype(np.int64), stops.astype(np.int64)


def part_spans(text: str, size: int = SECTION) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections, longer ones cut into parts of ``size`` characters, wherever that falls."""
    lo, hi = line_spans(text)
    n = np.maximum(1, -(-(hi - lo) // size))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(lo, n) + nth * size
    return starts, np.minimum(starts + size, np.repeat(hi, n))


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str = "majority") -> np.ndarray:
    """The section (index into sorted, disjoint [lo, hi)) of each token, -1 for none."""

    def holding(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(lo, at, "right") - 1
        return np.where((k >= 0) & (at < hi[np.maximum(k, 0)]), k, -1)

    owner = holding(starts)
    if rule == "first":
        return owner
    crossing = np.flatnonzero((owner != holding(ends - 1)) | (owner == -1))
    if not len(crossing):
        return owner
    size = ends[crossing] - starts[crossing]
    token = np.repeat(np.arange(len(crossing)), size)
    part = holding(np.repeat(starts[crossing], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    _, first, chars = np.unique(token * (len(lo) + 1) + part + 1, return_index=True, return_counts=True)
    token, part = token[first], part[first]
    order = np.lexsort((first, -chars, token))  # of each token the section with most characters, the earlier on a tie
    best = order[np.flatnonzero(np.diff(token[order], prepend=-1))]
    owner[crossing[token[best]]] = part[best]
    return owner


def count_by_section(docs: DataFrame, tokenizer: str, sections=line_spans, rule: str = "majority") -> DataFrame:
    """Tokens of each section of each document; needs columns doc_id and text.

    ``sections`` maps a text to the starts and stops of its sections, sorted and
    disjoint.  A section -1 is returned where tokens fall outside all of them.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "section", "start", "stop", "n_tokens", "doc_tokens"]

    def count(batches):
        gc.disable()
        enc = encoder(tokenizer)
        for batch in batches:
            docs_, texts = (batch.column(k).to_pylist() for k in range(2))
            for at, part in in_parts(texts):
                cols: list[list] = [[] for _ in names]
                for doc, text, ids in zip(docs_[at : at + len(part)], part, enc.ids_of(part), strict=True):
                    lo, hi = sections(text)
                    owner = attribute(*enc.offsets(text, ids), lo, hi, rule)
                    n = np.bincount(owner + 1, minlength=len(lo) + 1)
                    first = 0 if n[0] else 1
                    k = len(lo) + 1 - first
                    for c, x in zip(cols, (
                        [doc] * k, np.arange(first - 1, len(lo)), np.append(-1, lo)[first:],
                        np.append(-1, hi)[first:], n[first:], [len(owner)] * k,
                    ), strict=True):
                        c.extend(x.tolist() if isinstance(x, np.ndarray) else x)
                yield pa.record_batch([pa.array(c, pa.int32() if n == "section" else pa.int64()) for c, n in zip(cols, names)], names)

    return docs.select("doc_id", "text").mapInArrow(count, COUNTS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line, or part of a long line, of every document."""
    import public_tokenizers

    return count_by_section(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), part_spans)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}
