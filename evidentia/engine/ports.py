"""Outside services as ports: small interfaces with deterministic stand-ins, retries, fallback, guards.

The library makes no network calls.  A caller passes an object of its own;
plans run it inside Arrow batches on the executors.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future
from concurrent.futures import TimeoutError as FutureTimeout
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.trigram import word_similarity
from ..functions.vectors import seeded_vector

T = TypeVar("T")
EMBED_BATCH, ATTEMPTS, PAUSE = 96, 2, 0.3
#: Seconds that a streamed answer, and a structured one, may take.
STREAM_SECONDS, STRUCTURE_SECONDS = 120.0, 20.0
#: Calls that may hang in a worker at one time.
HANGING = 16
_THREADS = threading.BoundedSemaphore(HANGING)


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[tuple[int, Sequence[float]]]: ...


class Reranker(Protocol):
    def rerank(self, question: str, candidates: Sequence[str]) -> tuple[list[int], float]: ...


class Judge(Protocol):
    def judge(self, question: str, answer: str, evidence: Sequence[str]) -> str: ...


class Transient(Exception):
    """A failure that may pass when tried again."""


@dataclass
class SeededEmbedder:
    dimension: int = 16

    def embed(self, texts):
        return [(i, seeded_vector(t, self.dimension).tolist()) for i, t in enumerate(texts)]


class OverlapReranker:
    """Candidates by word similarity to the question, and ten times the best similarity as relevance."""

    def rerank(self, question, candidates):
        scores = [word_similarity(question, c) for c in candidates]
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
        return order, round(10 * max(scores, default=0.0), 6)


def retried(call: Callable[[], T], attempts: int = ATTEMPTS, pause: float = PAUSE, sleep=time.sleep) -> T:
    """Tries again after transient failures, each time after a longer pause."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Transient:
            if n == attempts:
                raise
            sleep(pause * n)
    raise AssertionError("unreachable")


def first_stream(providers: Iterable[Callable[[], Iterator[str]]]) -> Iterator[str]:
    """Tokens of the first provider that yields any; after its first token there is no way back."""
    failure: Exception | None = None
    for provider in providers:
        started = False
        try:
            for token in provider():
                started = True
                yield token
            return
        except Exception as e:
            if started:
                raise
            failure = e
    raise failure or ValueError("no provider")


def embed_column(df: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    """Adds vectors in requests of EMBED_BATCH texts; answers are put in order by index and checked for dimension."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"{out} array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[at : at + EMBED_BATCH]
                got = sorted(retried(lambda: embedder.embed([t or "" for t in part[text]])))  # noqa: B023  called at once
                if [i for i, _ in got] != [*range(len(part))] or any(len(v) != embedder.dimension for _, v in got):
                    raise ValueError("an embedding is missing or of another dimension")
                yield part.assign(**{out: [[*map(float, v)] for _, v in got]})

    return df.mapInPandas(run, schema)


def within(call: Callable[[], T], seconds: float, otherwise: Callable[[], T]) -> T:
    """The answer of a call, or what stands in for it if the call takes longer than ``seconds``; a late answer is dropped.

    A call that never returns keeps its thread, so a worker has HANGING of them at
    most: where all hang, calls wait for one as long as they would for an answer.
    """
    until = time.monotonic() + seconds
    if not _THREADS.acquire(timeout=seconds):
        return otherwise()
    answer: Future[T] = Future()

    def run() -> None:
        try:
            answer.set_result(call())
        except BaseException as e:
            answer.set_exception(e)
        finally:
            _THREADS.release()

    threading.Thread(target=run, daemon=True).start()
    try:
        return answer.result(timeout=max(0.0, until - time.monotonic()))
    except FutureTimeout:
        if answer.done():  # the call itself timed out
            return answer.result()
        return otherwise()


def asked(sample: DataFrame, text: str, ask: Callable[[str], str], seconds: float = STRUCTURE_SECONDS) -> DataFrame:
    """Candidate items of a sample: adds ``question``, made from the text by a provider, and ``status`` candidate; no question where the provider fails or is late."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sample.schema.fields], "question string", "status string"])

    def one(t: str) -> str | None:
        try:
            return within(lambda: retried(lambda: ask(t)), seconds, lambda: None)
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(question=[one(t or "") for t in pdf[text]], status="candidate")

    return sample.mapInPandas(run, schema)


@contextmanager
def run_guard(path: str):
    """Only one run at a time: a file made exclusively, removed by its maker alone."""
    token = f"{os.getpid()}-{time.time_ns()}"
    with open(path, "x") as f:
        f.write(token)
    try:
        yield
    finally:
        with open(path) as f:
            mine = f.read() == token
        if mine:
            os.remove(path)


def until_cancelled(items: Iterable[T], work: Callable[[T], None], cancelled: Callable[[], bool]) -> str:
    """Works item by item; a cancellation takes effect between two items and beats completion."""
    for item in items:
        if cancelled():
            return "CANCELLED"
        work(item)
    return "CANCELLED" if cancelled() else "COMPLETED"
