"""Streams over files: windows with late data, numbered frames, progress snapshots, guarded sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


def file_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windowed_counts(events: DataFrame, at: str, key: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window and key; windows close once the watermark has passed them."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    got = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first event of each request id, with state that ends with the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A batch writer for several sinks: one that fails is dropped, the others go on."""
    alive = dict(sinks)

    def write(batch: DataFrame, number: int) -> None:
        for name in list(alive):
            try:
                alive[name](batch, number)
            except Exception:
                log.exception("sink %s failed at batch %d and is dropped", name, number)
                del alive[name]

    return write


def run_available(df: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and ends; a scheduler calls it at its ticks."""
    q = df.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def progress(events: DataFrame, job: str, order: list[str], states: str, final: str) -> DataFrame:
    """What a late subscriber is sent for each job: its latest state, and that it is over if so."""
    latest = events.groupBy(job).agg(F.max_by(states, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))
    done = F.when(F.col("state") == final, F.array(F.lit("snapshot"), F.lit("job.completed"))).otherwise(F.array(F.lit("snapshot")))
    return latest.select(job, "state", "n_events", done.alias("frames"))
