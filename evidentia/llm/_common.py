"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies; elsewhere pass it with --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)


def fresh() -> None:
    """For the start of a task's Python work: a worker is used again by other stages, which need not hold what the encoder keeps for its own."""
    gc.enable()
    encoder = sys.modules.get("evidentia.llm.encoder")
    if encoder is not None:
        encoder._KEPT.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, which else stays with the worker beside what the executor's heap has grown to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, by a path that only Spark has to be able to open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one (tests) gets its own, a cluster has to name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, hint: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most the tasks that run now.
    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{hint}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is already gone; nothing is left to tidy up
        return


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the table: shuffled, never broadcast.

    The planner judges by compressed bytes; a table of ids below its limit takes many times
    that in the driver, which builds it, and rounds of joins would hold several at a time.
    """
    return df.hint("merge")


#: Keys that hold more than a HOT-th of all rows, of which there are fewer than HOT, are joined by broadcast.
HOT = 4096


def joined(rows: DataFrame, side: DataFrame, *key: str, grows: bool = False) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a key and says in ``n`` how many rows hold the key.

    Rows of hot keys stay where they are: the hot part of ``side``, bounded by HOT rows,
    goes to them.  The others are shuffled; no task gets more than a HOT-th for a key.
    Keys are not null, and each row's key is in ``side``.  ``grows`` says that ``side``
    grows with the table, so that its other part is not broadcast either.
    """
    most = (side.agg(F.sum("n")).first()[0] or 0) / HOT
    hot, rest = F.broadcast(side.where(F.col("n") > most).drop("n")), side.where(F.col("n") <= most).drop("n")
    return rows.join(hot, [*key]).unionByName(rows.join(hot.select(*key), [*key], "left_anti").join(merged(rest) if grows else rest, [*key]))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no model may learn from: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def unit(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the given values and the seed."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
