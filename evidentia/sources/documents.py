"""Documents from files: nested JSON, evaluation sets, landed binaries and their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.evaluation import approved

RATING = "struct<system: string, code: string, label: string>"
DOCUMENT = (
    "title string, publisher string, version string, publishedAt string, sourceUrl string, "
    f"sections array<struct<path: array<string>, title: string, `order`: int, chunks: array<struct<content: string, recommendationNumber: string, "
    f"recommendationGrade: {RATING}, evidenceLevel: {RATING}, pageStart: int, pageEnd: int>>>>"
)
ITEM = "id string, kind string, question string, expectedEvidence array<struct<guidelineTitle: string, publisher: string, recommendationNumber: string, sectionPath: array<string>>>, status string, origin string"


def ingest_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file, checked: a document without title, date or chunks fails the job and is named."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    empty = ~F.coalesce(F.exists("sections", lambda s: F.size(s["chunks"]) > 0), F.lit(False))
    rules = {"title": F.coalesce(F.trim("title"), F.lit("")) == "", "publishedAt": F.col("publishedAt").try_cast("date").isNull(), "sections": empty}
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    said = F.concat(F.lit("document "), F.coalesce("title", F.lit("?")), F.lit(": "), F.array_join(broken, ", "))
    return docs.withColumn("title", F.when(F.size(broken) > 0, F.raise_error(said).cast("string")).otherwise(F.col("title")))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """One row a chunk, with its section's order and its own, and the digest that tells copies."""
    sections = docs.select("title", "publisher", "version", F.posexplode("sections").alias("section_no", "s"))
    rows = sections.select("title", "publisher", "version", "section_no", F.col("s.path").alias("path"), F.posexplode("s.chunks").alias("chunk_no", "c"))
    return rows.select("title", "publisher", "version", "section_no", "path", "chunk_no", "c.*", F.sha2(F.encode("c.content", "UTF-8"), 256).alias("digest"))


def first_of_each_content(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content within a document, in order of sections and chunks."""
    key = ["title", "publisher", "version", "digest"]
    rest = [c for c in chunks.columns if c not in key]
    return chunks.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("section_no", "chunk_no")).alias("r")).select(*key, "r.*")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """The approved items of an evaluation set; answerable ones must state what they expect."""
    items = spark.read.schema(ITEM).json(path, multiLine=True)
    lacking = (F.col("kind") == "answerable") & (F.coalesce(F.size("expectedEvidence"), F.lit(0)) <= 0)
    kind = F.when(lacking, F.raise_error(F.concat(F.lit("item "), "id", F.lit(": no expected evidence"))).cast("string")).otherwise(F.col("kind"))
    return approved(items.withColumn("kind", kind))


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """name, body, digest of files that a download left in a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("body"), F.sha2("content", 256).alias("digest"))


def pages_of(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """name, page_no, text by an extractor of the caller's: the library brings no reader for a file format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, i, t) for n, b in zip(pdf["name"], pdf["body"]) for i, t in enumerate(extract(bytes(b)))]
            yield pd.DataFrame(rows, columns=["name", "page_no", "text"])

    return files.select("name", "body").mapInPandas(run, "name string, page_no int, text string")


def page_reader(extract: Callable[[bytes], list[str]]):
    """A table function: the parts of each landed body, in order, to its pages.

    Its input is a table (name, part, body) partitioned by name and ordered by part.
    An extractor that fails gives a row with the error and no page.
    """

    @udtf(returnType="name string, page_no int, text string, error string")
    class Pages:
        def __init__(self):
            self.name, self.parts = None, []

        def eval(self, row: Row):
            self.name = row["name"]
            self.parts.append(bytes(row["body"] or b""))

        def terminate(self):
            if not self.parts:
                return
            try:
                pages = [*enumerate(extract(b"".join(self.parts)))]
            except Exception as e:
                yield self.name, None, None, f"{type(e).__name__}: {e}"
                return
            for n, text in pages:
                yield self.name, n, text, None

    return Pages


def extracted(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """name, page_no, text, error of landed bodies (name, part, body), which may have landed in several parts."""
    return page_reader(extract)(files.select("name", "part", "body").asTable().partitionBy("name").orderBy("part"))
