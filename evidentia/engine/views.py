"""The roles that the driver's tables play."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies; elsewhere pass it with --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)


#: The query set of searches.
EVERY = 20


class Tables:
    """The tables of one folder, read lazily: ``t.orders`` is a scan of orders."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def chunks(self) -> DataFrame:
        """Evidence chunks: a document with its vector, the source as guideline, the language as version; ``chars`` is known before texts are joined."""
        d, e = self.documents.withColumn("chars", F.length("text")), self.embeddings
        return d.join(e, d.doc_id == e.vec_id).select(
            F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "chars", F.col("source").alias("guideline"), F.col("lang").alias("version"),
            F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"),
        )

    def questions(self) -> DataFrame:
        """Every vector whose id is divisible by 20, and its text, as questions asked of all others."""
        return self.chunks().where(F.col("chunk_id") % EVERY == 0).select(
            F.col("chunk_id").alias("question_id"), F.col("content").alias("question"), F.col("vector").alias("question_vector"), F.col("label").alias("question_label"),
        )

    def messages(self) -> DataFrame:
        """Conversation turns with an id that sorts by creation."""
        return self.conversations.withColumn("message_id", F.col("conv_id") * 1000 + F.col("turn"))


#: The same roles for DuckDB.
CHUNKS_SQL = """chunks AS (SELECT d.doc_id AS chunk_id, d.text AS content, d.source AS guideline, d.lang AS version,
  list_transform(e.embedding, lambda x: x::DOUBLE) AS vector, e.label, 'm' || (e.label % 2) AS model
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""
QUESTIONS_SQL = """questions AS (SELECT chunk_id AS question_id, content AS question, vector AS question_vector, label AS question_label FROM chunks WHERE chunk_id % 20 = 0)"""
