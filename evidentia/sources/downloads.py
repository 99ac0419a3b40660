"""Bodies fetched at a rate that the server can bear.

Requests are dealt into lanes, a partition each.  A lane keeps its own pace: its
requests are ``lanes / per_second`` apart and begin at its turn, so that all
lanes together, however many run at a time, stay below the rate.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: external_id, url -> body and content type.
Fetch = Callable[[str, str], tuple[bytes, str]]
FETCHED = "external_id string, url string, body binary, content_type string, error string, lane int, nth int, asked_at double"
TIMEOUT = 60


def get(external_id: str, url: str) -> tuple[bytes, str]:
    """A plain request, with the document's own page as referrer.  An error page is a body too: what it is worth is judged later, not by its status."""
    try:
        with urlopen(Request(url, headers={"Referer": url}), timeout=TIMEOUT) as r:  # noqa: S310
            return r.read(), r.headers.get("Content-Type", "")
    except HTTPError as e:
        return e.read(), e.headers.get("Content-Type", "")


class Pace:
    """When a lane's next request may be made."""

    def __init__(self, lane: int, lanes: int, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.apart, self.clock, self.sleep = lanes / per_second, clock, sleep
        self.next = clock() + lane / per_second

    def wait(self) -> None:
        """Returns at the lane's turn; a request that took longer than its turn does not make up for it afterwards."""
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.apart


def downloaded(items: DataFrame, fetch: Fetch = get, per_second: float = 1.0, lanes: int = 1) -> DataFrame:
    """A row for each item (external_id, url): its body, or the error that kept it from coming.

    A failure is a row, never the end of the job.  Within a lane items are fetched in
    order of their id.  Rows go on as they come, a body at a time, so a task holds one.
    Write the result before it is used: each use would fetch anew.
    """
    dealt = items.select("external_id", "url").repartition(lanes, "external_id").sortWithinPartitions("external_id")
    names = [c.split()[0] for c in FETCHED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, nth = TaskContext.get().partitionId() % lanes, 0
        pace = Pace(lane, lanes, per_second)
        for batch in batches:
            for external_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pace.wait()
                at, body, kind, error = time.time(), None, None, None
                try:
                    body, kind = fetch(external_id, url)
                except Exception as e:
                    error = f"{external_id}: {type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((external_id, url, body, kind, error, lane, nth, at), kinds, strict=True)], names)
                nth += 1

    return dealt.mapInArrow(run, FETCHED)


def acquired(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """external_id, digest, verdict: what came of each download; ``known`` has the digest of the last body by external_id."""
    rows = fetched.withColumn("digest", F.sha2("body", 256)).join(known.select("external_id", F.col("digest").alias("__known")), "external_id", "left")
    page, magic = F.startswith("content_type", F.lit("text/html")), F.substring("body", 1, 4) == F.lit(b"%PDF")
    verdict = F.when(F.col("error").isNotNull(), "FAILED").when(page, "SKIPPED").when(~F.coalesce(magic, F.lit(False)), "FAILED").when(F.col("digest") == F.col("__known"), "UNCHANGED").otherwise("FETCHED")
    return rows.select("external_id", "digest", verdict.alias("verdict"), F.coalesce("error", F.when(verdict == "FAILED", "no PDF")).alias("reason"))
