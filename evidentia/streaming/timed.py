"""State with timers: events taken in order of their time, state that ends by it, and beats of silent streams.

Both forms keep typed values and lists in Spark's state store
(``transformWithState``), which wants the store that can hold them:
``spark.sql.streaming.stateStore.providerClass`` set to ``STORE``.  Nothing of a
key is gathered in memory beyond what a micro-batch brings and what waits for
the watermark; all of it comes back from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

#: The state store that transformWithState needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of silence after which a stream gets a beat.
BEAT = 15.0
_BEAT = ": heartbeat\n\n"
_SQL = {"float": "double", "int": "long", "bool": "boolean", "str": "string"}


def _ms(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class InOrder(StatefulProcessor):
    """Runs a machine over the events of a key in order of their time.

    Events wait in a list until the watermark has passed them; a timer for the
    end of their slot wakes them, so that late ones within the watermark take their place.  The
    machine's fields are a value that ends once the key has been silent for
    ``ttl`` seconds of event time.  Columns named in ``whole`` come as decimals and are
    kept and answered as integers: beside nulls, pandas would make floats of them,
    which the state store takes for null in a column of integers.
    """

    def __init__(self, machine: Callable[[], object], keys: list[str], at: str, tie: str, inputs: list[str], out: str, row: str, ttl: float, slot: float, whole: tuple[str, ...] = ()):
        self.machine, self.keys, self.at, self.tie, self.inputs, self.out = machine, keys, at, tie, inputs, out
        self.whole = whole
        self.row, self.ttl, self.slot = row, int(ttl * 1000), max(1, int(slot * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.name for f in fields(self.machine())]
        kept = ", ".join(f"`{f.name}` {_SQL[f.type if isinstance(f.type, str) else f.type.__name__]}" for f in fields(self.machine()))
        self.state = handle.getValueState("machine", f"{kept}, __last long")
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns, wake = [self.at, self.tie, *self.inputs], set()
        for pdf in rows:
            plain = pdf[columns].astype(object).where(pdf[columns].notna(), None)
            for c in self.whole:
                plain[c] = pd.Series([None if x is None else int(x) for x in plain[c]], plain.index, object)
            self.waiting.appendList([*plain.itertuples(index=False, name=None)])
            wake |= {(_ms(x) // self.slot + 1) * self.slot for x in plain[self.at] if x is not None}
        for when in wake - set(self.handle.listTimers()):
            self.handle.registerTimer(when)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [*self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if _ms(r[0]) < now), key=lambda r: (r[0], r[1]))
        machine, last = self.machine(), None
        if self.state.exists():
            *values, last = self.state.get()
            for name, value in zip(self.names, values, strict=True):
                setattr(machine, name, value)
        answers = []
        for at, tie, *values in due:
            if last is not None and _ms(at) - last >= self.ttl:
                machine = self.machine()  # the state had ended before this event
            answers.append((*key, at, tie, *values, machine.step(_ms(at) / 1000.0 + pd.Timestamp(at).microsecond % 1000 / 1e6, *values)))
            last = _ms(at)
        if due:
            rest = [r for r in waiting if _ms(r[0]) >= now]
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.state.update((*astuple(machine), last))
            self.handle.registerTimer(last + self.ttl)
            got = pd.DataFrame(answers, columns=[*self.keys, self.at, self.tie, *self.inputs, self.out])
            for c in self.whole:
                got[c] = pd.Series([row[got.columns.get_loc(c)] for row in answers], dtype=object)
            yield got
        elif last is not None and now >= last + self.ttl:
            self.state.clear()

    def close(self) -> None:
        pass


class Beats(StatefulProcessor):
    """Numbers a stream's events as frames, and sends a comment for each silence of ``beat`` seconds until a final event."""

    def __init__(self, key: str, at: str, event: str, final: tuple[str, ...], beat: float):
        self.key, self.at, self.event, self.final, self.beat = key, at, event, final, int(beat * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("stream", "seq long, timer long, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, timer, ended = self.state.get() if self.state.exists() else (0, -1, False)
        due, frames = timer, []
        for at, event in sorted((_ms(a), e) for pdf in rows for a, e in zip(pdf[self.at], pdf[self.event], strict=True)):
            if ended:  # one end, however much comes after it
                break
            while 0 <= due <= at:  # a silence that this event ends, and that no watermark has passed yet
                frames.append((key[0], due / 1000.0, _BEAT))
                due += self.beat
            frames.append((key[0], at / 1000.0, f"data: {json.dumps({'seq': seq, self.event: event}, ensure_ascii=False)}\n\n"))
            seq, due, ended = seq + 1, max(due, at + self.beat), event in self.final
        due = -1 if ended else due
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.state.update((seq, due, ended))
        if frames:
            yield pd.DataFrame(frames, columns=[self.key, "at", "frame"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        seq, timer, ended = self.state.get() if self.state.exists() else (0, -1, True)
        if ended or timer != now:
            return
        # a watermark that jumps passes several beats at once
        passed = [*range(now, max(now, timerValues.getCurrentWatermarkInMs()) + 1, self.beat)]
        self.handle.registerTimer(passed[-1] + self.beat)
        self.state.update((seq, passed[-1] + self.beat, ended))
        yield pd.DataFrame([(key[0], at / 1000.0, _BEAT) for at in passed], columns=[self.key, "at", "frame"])

    def close(self) -> None:
        pass


def _watermarked(events: DataFrame, at: str, late: str) -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp")).where(F.col(at).isNotNull()).withWatermark(at, late)


def fold_in_order(events: DataFrame, keys: list[str], at: str, tie: str, machine, inputs: list[str], out: str, kind: str, late: str, ttl: float, slot: float = 1.0) -> DataFrame:
    """The streaming form of ``keyed.fold``: keys, at, tie, inputs and the machine's answer, each once the watermark has passed.

    The same answers as in batch form, however files and micro-batches deal the events
    out, as long as none is later than ``late``; state ends ``ttl`` seconds of event
    time after a key's last event.
    """
    rows = _watermarked(events, at, late).select(*keys, at, tie, *inputs)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = lambda names: ", ".join(f"`{n}` {types[n]}" for n in names)
    whole = tuple(c for c in dict.fromkeys([tie, *inputs]) if c not in (*keys, at) and isinstance(rows.schema[c].dataType, IntegralType))
    rows = rows.withColumns({c: F.col(f"`{c}`").cast("decimal(19,0)") for c in whole})
    processor = InOrder(machine, keys, at, tie, inputs, out, ddl([at, tie, *inputs]), ttl, slot, whole)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, f"{ddl([*keys, at, tie, *inputs])}, `{out}` {kind}", "Append", "EventTime")


def beating(events: DataFrame, key: str, at: str, event: str, final: tuple[str, ...], late: str, beat: float = BEAT) -> DataFrame:
    """key, at (seconds), frame: the events of each stream numbered from 0, and a comment after each silence, by event time."""
    rows = _watermarked(events, at, late).select(key, at, event)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, at double, frame string"
    return rows.groupBy(key).transformWithStateInPandas(Beats(key, at, event, final, beat), schema, "Append", "EventTime")
