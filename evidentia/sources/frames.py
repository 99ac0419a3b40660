"""Event frames: written for streams, parsed from them, and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, stream: str, order: list[str], fields: list[str]) -> DataFrame:
    """One JSON frame a row, numbered from 0 within its stream."""
    seq = F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1
    rows = df.withColumn("seq", seq.cast("long"))
    return rows.select(stream, "seq", F.concat(F.lit("data: "), F.to_json(F.struct("seq", *fields)), F.lit("\n\n")).alias("frame"))


def parse(body: Column) -> Column:
    """Array of (event, data): line ends normalised, comments skipped, data lines joined, one leading blank dropped."""
    plain = F.regexp_replace(body, "\r\n?", "\n")
    blocks = F.split(plain, "\n\n+")

    def value(line: Column, name: str) -> Column:
        return F.regexp_replace(line, f"^{name}: ?", "")

    def frame(b: Column) -> Column:
        lines = F.split(b, "\n")
        data = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: value(x, "data"))
        event = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("event:"))), lambda x: value(x, "event"))
        return F.struct(F.get(event, F.lit(0)).alias("event"), F.array_join(data, "\n").alias("data"), F.size(data).alias("n"))

    return F.filter(F.transform(blocks, frame), lambda f: f["n"] > 0)


def reassembled(reads: DataFrame, connection: str, order: str, body: str) -> DataFrame:
    """connection, event, data: the frames of each connection, however its reads cut them.

    The reads of a connection are one body; they are put together before it is parsed.
    """
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda x: x[body]), "")
    got = reads.groupBy(connection).agg(parse(whole).alias("frames"))
    return got.select(connection, F.posexplode("frames").alias("no", "f")).select(connection, "no", "f.event", "f.data")


#: Hosts that take an alert in a shape of their own.
TEXT_HOSTS, CONTENT_HOSTS = ("hooks.slack.com",), ("discord.com", "discordapp.com")


def alert_payload(host: Column, title: Column, detail: Column, trace_id: Column | None = None, text_hosts=TEXT_HOSTS, content_hosts=CONTENT_HOSTS) -> Column:
    """The shape of an alert depends on who receives it: exact hosts, anything else gets all fields."""
    line = F.concat_ws(" ", title, detail)
    fields = [title.alias("title"), detail.alias("detail"), *([trace_id.alias("traceId")] if trace_id is not None else []), line.alias("text")]
    known = F.lower(F.coalesce(host, F.lit("")))
    return F.when(known.isin(*text_hosts), F.to_json(F.struct(line.alias("text")))).when(known.isin(*content_hosts), F.to_json(F.struct(line.alias("content")))).otherwise(F.to_json(F.struct(*fields)))
