"""Keyed state: time-to-live entries, alert suppression, circuit breakers, numbered streams.

Each behaviour is a small state machine in plain Python.  The batch form runs
it over the ordered events of a key; the streaming form keeps its state in
Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How long a shown alert hides its repeats, and how breakers and blocks behave, in seconds and counts.
ALERT_WINDOW, FAILURES, OPEN_FOR, BLOCK_FOR = 300.0, 5, 30.0, 60.0


def live_entry(df: DataFrame, key: str, at: str, is_entry: Column, ttl_seconds: int, name: str) -> DataFrame:
    """Whether at each event an entry of its key is still alive; an entry's own event counts."""
    # entries at the same instant count for all events of that instant: the frame is by value, not by row
    order = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-(ttl_seconds * 1_000_000 - 1), 0)
    return df.withColumn(name, F.coalesce(F.bool_or(F.coalesce(is_entry, F.lit(False))).over(order), F.lit(False)))


@dataclass
class Suppressor:
    """Shows an alert unless the same one was shown within the window; hidden ones don't extend it."""

    window: float = ALERT_WINDOW
    shown: float = float("-inf")

    def step(self, at: float) -> bool:
        if at - self.shown < self.window:
            return False
        self.shown = at
        return True


@dataclass
class Breaker:
    """Opens after a run of failures, lets one try through after a pause, and opens again if that fails."""

    failures: int = 0
    opened: float = float("-inf")
    is_open: bool = False
    limit: int = FAILURES
    pause: float = OPEN_FOR

    def step(self, at: float, failed: bool) -> str:
        if self.is_open:
            if at - self.opened < self.pause:
                return "rejected"
            self.is_open, self.failures = False, self.limit - 1
        if not failed:
            self.failures = 0
            return "closed"
        self.failures += 1
        if self.failures >= self.limit:
            self.is_open, self.opened = True, at
            return "open"
        return "closed"


@dataclass
class RateBlock:
    """A provider that asks for a pause is left alone for that long."""

    until: float = float("-inf")

    def block(self, at: float, retry_after: float | None = None) -> None:
        self.until = at + (retry_after if retry_after and retry_after > 0 else BLOCK_FOR)

    def blocked(self, at: float) -> bool:
        return at < self.until

    def step(self, at: float, limited: bool, retry_after: float | None) -> bool:
        """Whether the call at this instant is held back; its own answer counts from the next one on."""
        now = self.blocked(at)
        if limited:
            self.block(at, None if retry_after is None or retry_after != retry_after else retry_after)
        return now


@dataclass
class Numbering:
    """Numbers the events of a stream from 0."""

    n: int = -1

    def step(self, at: float) -> int:
        self.n += 1
        return self.n


#: What may follow what in an answer's stream; the kinds without a row here end it.
FOLLOWS = {
    "": ("message.accepted",),
    "message.accepted": ("retrieval.started", "error"),
    "retrieval.started": ("retrieval.completed", "error"),
    "retrieval.completed": ("answer.delta", "answer.completed", "answer.abstained", "error"),
    "answer.delta": ("answer.delta", "answer.completed", "error"),
}


@dataclass
class Grammar:
    """Checks the order of an answer's events: accepted, retrieval started and completed, parts of the answer, one end.

    Each step names what is wrong with an event, or gives null.  An event out of
    place is passed over, so that one slip is told once; parts must be numbered
    from 0 without a gap.
    """

    at: str = ""
    parts: int = 0
    ended: bool = False

    def step(self, when: float, kind: str, seq: int | None = None) -> str | None:
        if self.ended:
            return "after_end"
        if kind not in FOLLOWS[self.at]:
            known = kind in FOLLOWS or any(kind in after for after in FOLLOWS.values())
            return f"{kind or 'null'}_after_{self.at or 'start'}" if known else "unknown_kind"
        if kind == "answer.delta":
            if seq is None or seq != seq or int(seq) != self.parts:
                return "seq_gap"
            self.parts += 1
        self.at, self.ended = kind, kind not in FOLLOWS
        return None


@dataclass
class Reads:
    """Puts frames together that the reads of a connection cut; each step gives the frames that a read completes."""

    held: str = ""

    def step(self, at: float, read: str) -> list[str]:
        # a lone carriage return at the end may be the first half of a line end
        body = self.held + (read or "")
        tail = "\r" if body.endswith("\r") else ""
        parts = body[: len(body) - len(tail)].replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
        self.held = parts.pop() + tail
        return [x for x in (p.strip("\n") for p in parts) if x]


def fold(df: DataFrame, keys: list[str], at: str, order: list[str], machine, inputs: list[str], out: str, kind: str) -> DataFrame:
    """Runs a machine over each key's events in order of time; adds its answers as ``out``.  Null is a key like any other.

    Rows are ordered by Spark and come in batches, so that a key may have more
    events than fit in memory; only the state of the current key is held.
    """
    cols = df.columns
    parts = df.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    parts = parts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"{out} {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            answers = []
            # nulls come as values that equal nothing, not even themselves
            known = [pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys]
            for key, when, *values in zip(zip(*known), pdf["__at"], *[pdf[c] for c in inputs]):
                if key != current:
                    current, state = key, machine()
                answers.append(state.step(when, *values))
            yield pdf[cols].assign(**{out: answers})

    return parts.mapInPandas(run, schema)


def fold_stream(events: DataFrame, keys: list[str], at: str, machine, inputs: list[str], out: str, kind: str, idle_seconds: float) -> DataFrame:
    """The streaming form of ``fold``: keys, at, inputs and the machine's answer.

    A machine's fields are the state of its key, kept in Spark's state store, and
    dropped once the key has been idle for ``idle_seconds``.
    """
    from dataclasses import astuple, fields

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [*keys, at, *inputs]
    rows = events.select(*names)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{out}` {kind}"])
    sql = {"float": "double", "int": "long", "bool": "boolean", "str": "string"}
    kept = ", ".join(f"`{f.name}` {sql[f.type if isinstance(f.type, str) else f.type.__name__]}" for f in fields(machine()))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = machine()
        for f, value in zip(fields(now), state.get if state.exists else ()):
            setattr(now, f.name, value)
        pdf = pd.concat(list(batches)).sort_values(at, kind="stable")
        answers = [now.step(x.timestamp(), *values) for x, *values in zip(pdf[at], *[pdf[c] for c in inputs])]
        state.update(astuple(now))
        state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pdf[names].assign(**{out: answers})

    return rows.groupBy(*keys).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def suppress_stream(events: DataFrame, keys: list[str], at: str, window: float = ALERT_WINDOW) -> DataFrame:
    """The streaming form of the suppressor: keys, at, shown."""
    return fold_stream(events, keys, at, lambda: Suppressor(window), [], "shown", "boolean", 2 * window)
