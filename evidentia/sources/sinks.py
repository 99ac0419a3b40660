"""Where results go: tables, files, metrics text, reports."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import report_cell


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Adds rows to a table of files; a frame without rows adds nothing."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def safe_name(name: str) -> str:
    """The last part of a name, without what a file system or a path could take for more."""
    plain = re.sub(r"[\x00-\x1f<>:\"|?*]", "_", name.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1])
    return plain if plain.strip(". ") else "unnamed"


def write_file(folder: str, name: str, body: bytes) -> str:
    """Writes one body under its safe name and returns the path."""
    path = os.path.join(folder, safe_name(name))
    with open(path, "wb") as f:
        f.write(body)
    return path


class FrameSink:
    """Frames of one connection: events as JSON, a comment line after each silence of ``beat`` seconds, one end however often it is asked for."""

    def __init__(self, write: Callable[[str], None], beat: float = 15.0, clock: Callable[[], float] = time.monotonic):
        self.write, self.beat, self.clock = write, beat, clock
        self.last, self.ended = clock(), False

    def send(self, event: dict) -> None:
        if not self.ended:
            self.write(f"data: {json.dumps(event, ensure_ascii=False)}\n\n")
            self.last = self.clock()

    def tick(self) -> None:
        """To be called now and then."""
        if not self.ended and self.clock() - self.last >= self.beat:
            self.write(": heartbeat\n\n")
            self.last = self.clock()

    def end(self, close: Callable[[], None] = lambda: None) -> None:
        if not self.ended:
            self.ended = True
            close()


def metric_lines(samples: DataFrame) -> DataFrame:
    """Exposition lines of samples (name, labels: map, value), in order of name and labels."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    shown = F.when(F.col("value") == float("inf"), "+Inf").otherwise(F.col("value").cast("string"))
    return samples.select(F.concat("name", labels, F.lit(" "), shown).alias("line")).orderBy("line")


def markdown_table(df: DataFrame, most_rows: int = 200) -> str:
    """A small summary as a table; a larger frame is refused rather than cut."""
    rows = df.select(*[report_cell(F.coalesce(F.col(c).cast("string"), F.lit("—"))).alias(c) for c in df.columns]).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report table holds {most_rows} rows at most; aggregate first")
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def report_lines(report: DataFrame, title: str, sections: list[str]) -> DataFrame:
    """section, line, key, part, text: the Markdown of a report (section, line, key, cells), which these columns put in order."""
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    row = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: report_cell(F.coalesce(c, F.lit("—")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size("cells")), " | "), F.lit(" |"))
    head = F.array(F.lit(""), F.concat(F.lit("## "), F.col("section")), F.lit(""), row, rule)
    lines = F.when(F.col("line") == 0, head).otherwise(F.array(row))
    body = report.where(place > 0).select(place.alias("section"), "line", "key", F.posexplode(lines).alias("part", "text"))
    first = report.sparkSession.range(1).select(F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("line"), F.lit("").alias("key"), F.lit(0).alias("part"), F.lit(f"# {title}").alias("text"))
    return first.unionByName(body.withColumn("section", F.col("section").cast("long")))


def write_report(report: DataFrame, title: str, sections: list[str], path: str) -> None:
    """Writes a report as text files whose order is that of the lines; a long one is many tasks' work."""
    report_lines(report, title, sections).orderBy("section", "line", "key", "part", "text").select("text").write.mode("overwrite").text(path)
