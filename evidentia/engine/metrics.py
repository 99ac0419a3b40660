"""Numbers gathered while jobs run: no scan of their own, told by the plan that does the work."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Labels = tuple[tuple[str, str], ...]
SAMPLE = "name string, labels map<string, string>, value double"


class Metrics:
    """Counters that add up over jobs, gauges that keep the last value, histograms of cumulative buckets.

    ``watch`` hangs the numbers on a frame; they are told when an action on it has
    ended, once for each frame that is watched.  A task that is run again counts once.
    """

    def __init__(self):
        self._lock = threading.Lock()
        self._open: list[tuple[Observation, Labels]] = []
        self._values: dict[tuple[str, Labels], float] = {}

    def watch(self, df: DataFrame, labels: Mapping[str, str] | None = None, counters: Mapping[str, Column] | None = None, gauges: Mapping[str, Column] | None = None, histograms: Mapping[str, tuple[Column, list[float]]] | None = None) -> DataFrame:
        """``df``, watched: ``counters`` and ``gauges`` are aggregates, ``histograms`` a value and its bounds."""
        seen = Observation()
        self._open.append((seen, tuple(sorted((labels or {}).items()))))
        return df.observe(seen, *self.columns(counters, gauges, histograms))

    @staticmethod
    def columns(counters: Mapping[str, Column] | None = None, gauges: Mapping[str, Column] | None = None, histograms: Mapping[str, tuple[Column, list[float]]] | None = None) -> list[Column]:
        """The aggregates that tell the numbers, under names that ``take`` understands."""
        out = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c|{n}") for n, c in (counters or {}).items()]
        out += [c.cast("double").alias(f"g|{n}") for n, c in (gauges or {}).items()]
        for n, (value, bounds) in (histograms or {}).items():
            known = value.isNotNull()
            out += [F.count_if(known & (value <= b)).cast("double").alias(f"c|{n}_bucket|{b:g}") for b in sorted(bounds)]
            out += [F.count_if(known).cast("double").alias(f"c|{n}_bucket|+Inf"), F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias(f"c|{n}_sum"), F.count(value).cast("double").alias(f"c|{n}_count")]
        return out

    def take(self, numbers: Mapping[str, float | None], labels: Labels = ()) -> None:
        """Takes in what one job, or one micro-batch, has told."""
        with self._lock:
            for key, value in numbers.items():
                kind, name, *bound = key.split("|")
                if kind not in ("c", "g") or value is None:
                    continue
                at = (name, tuple(sorted([*labels, *(("le", b) for b in bound)])))
                self._values[at] = value + (self._values.get(at, 0.0) if kind == "c" else 0.0)

    def samples(self, spark: SparkSession) -> DataFrame:
        """name, labels, value of all that has been told; waits for the jobs that are watched, whose actions must have begun."""
        done, self._open = self._open, []
        for seen, labels in done:
            self.take(seen.get, labels)
        rows = [(name, dict(labels), value) for (name, labels), value in sorted(self._values.items())]
        return spark.createDataFrame(rows, SAMPLE)


class StreamMetrics(StreamingQueryListener):
    """Feeds ``Metrics`` from streams whose frames are observed under ``name`` with ``Metrics.columns``."""

    def __init__(self, metrics: Metrics, name: str, labels: Mapping[str, str] | None = None):
        self.metrics, self.name, self.labels = metrics, name, tuple(sorted((labels or {}).items()))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.name)
        if got is not None:
            self.metrics.take(got.asDict(), self.labels)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
