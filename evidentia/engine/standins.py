"""Answers, judgements and structured guidance by providers, run in batches, and deterministic stand-ins for them.

A provider sees one question at a time with its evidence; a call that fails or is
late leaves the fields it should have filled null, and what builds on it falls
back.  What a structurer says is checked: an item must point to evidence that was
offered, and to facts of the patient that are on record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from .ports import STREAM_SECONDS, STRUCTURE_SECONDS, retried, within

EXCERPT = 80
PIECE = "struct<marker: int, title: string, path: array<string>, content: string>"
ITEM = "struct<title: string, rationale: string, applicability: string, markers: array<int>, factors: array<string>>"
JUDGEMENT = "struct<claims: int, supported: int, unsupported: int, verdict: string>"


class Answerer(Protocol):
    def answer(self, question: str, evidence: Sequence[dict]) -> Iterator[str]: ...


class AnswerJudge(Protocol):
    def judge(self, question: str, answer: str, evidence: Sequence[dict]) -> dict: ...


class Structurer(Protocol):
    def structure(self, question: str, evidence: Sequence[dict], factors: Sequence[str]) -> list[dict]: ...


def excerpt(text: str) -> str:
    return text if len(text) <= EXCERPT else text[:EXCERPT] + "…"


class QuotingAnswerer:
    """Says of each piece of evidence how it begins, with its marker; says so where there are fewer than ``enough``."""

    enough = 3

    def answer(self, question, evidence):
        for piece in evidence:
            words = re.sub(r"[.!?\n]+", " ", piece["content"] or "")[:EXCERPT].strip()
            yield f"{words} [{piece['marker']}]. "
        if len(evidence) < self.enough:
            yield "Little else is known."


class MarkerJudge:
    """Counts sentences with and without a marker, whatever the evidence says."""

    def judge(self, question, answer, evidence):
        said = [s for s in (x.strip() for x in re.split(r"[.!?\n]+", answer)) if s]
        held = sum(bool(re.search(r"\[\d\]", s)) for s in said)
        return {"claims": len(said), "supported": held, "unsupported": len(said) - held, "verdict": "grounded" if held == len(said) else "partial"}


class EvidenceStructurer:
    """One item a piece of evidence, with all that is on record of the patient."""

    def structure(self, question, evidence, factors):
        return [
            {"title": " > ".join([p["title"] or "", *(p["path"] or [])]), "rationale": excerpt(p["content"] or ""), "applicability": "CAUTION", "markers": [p["marker"]], "factors": [*factors]} for p in evidence
        ]


def _added(df: DataFrame, inputs: list[str], out: str, kind: str, call: Callable, seconds: float) -> DataFrame:
    """Adds ``out``, what ``call`` makes of the inputs of a row; null where it fails or takes longer."""
    schema = StructType([*df.schema.fields, *DataType.fromDDL(f"`{out}` {kind}").fields])
    arrow = to_arrow_schema(schema)

    def one(values: list):
        try:
            return within(lambda: retried(lambda: call(*values)), seconds, lambda: None)
        except Exception:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one([*v]) for v in zip(*[batch.column(c).to_pylist() for c in inputs], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow.field(out).type)], schema=arrow)

    return df.mapInArrow(run, schema)


def evidence_of(found: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """question_id, evidence: the first n chunks of each question (question_id, chunk_id, position), numbered from 1."""
    rows = found.where(F.col("position") <= n).join(chunks, "chunk_id")
    piece = F.struct(F.col("position").cast("int").alias("marker"), F.col("guideline").alias("title"), F.array("version").alias("path"), "content")
    return rows.groupBy("question_id").agg(F.sort_array(F.collect_list(piece)).cast(f"array<{PIECE}>").alias("evidence"))


def answered(df: DataFrame, answerer: Answerer, seconds: float = STREAM_SECONDS) -> DataFrame:
    """Adds ``answer`` to rows with question and evidence."""
    return _added(df, ["question", "evidence"], "answer", "string", lambda q, e: "".join(answerer.answer(q or "", e or [])), seconds)


def judged(df: DataFrame, judge: AnswerJudge, seconds: float = STRUCTURE_SECONDS) -> DataFrame:
    """Adds ``judgement`` to rows with question, answer and evidence."""
    return _added(df, ["question", "answer", "evidence"], "judgement", JUDGEMENT, lambda q, a, e: None if a is None else judge.judge(q or "", a, e or []), seconds)


def structured(df: DataFrame, structurer: Structurer, seconds: float = STRUCTURE_SECONDS) -> DataFrame:
    """Adds ``items`` to rows with question, evidence and factors."""
    return _added(df, ["question", "evidence", "factors"], "items", f"array<{ITEM}>", lambda q, e, f: structurer.structure(q or "", e or [], f or []), seconds)


def accepted(df: DataFrame) -> DataFrame:
    """Adds ``accepted``: the items that stand on both legs, evidence that was offered and factors on record; one reference that is neither rejects its item."""
    offered = F.transform("evidence", lambda p: p["marker"])
    known = lambda own, all_: (F.size(own) > 0) & (F.size(F.array_except(own, all_)) == 0)
    keep = lambda x: F.coalesce(known(x["markers"], offered) & known(x["factors"], F.col("factors")), F.lit(False))
    return df.withColumn("accepted", F.coalesce(F.filter("items", keep), F.array().cast(f"array<{ITEM}>")))


def composed(df: DataFrame) -> DataFrame:
    """Adds ``source`` and ``titles``: the accepted items, else the evidence as it stands, else a plain summary."""
    source = F.when(F.size("accepted") > 0, "structured").when(F.size("evidence") > 0, "citations").otherwise("summary")
    titles = F.when(source == "structured", F.transform("accepted", lambda x: x["title"])).when(source == "citations", F.transform("evidence", lambda p: p["title"])).otherwise(F.array(F.lit("summary")))
    return df.withColumn("source", source).withColumn("titles", titles)
