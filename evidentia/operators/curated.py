"""Lists kept by hand: documents that are no guidelines to take in, and known defects of sources.

An entry names one state of a document: source system, id, version and digest
of the file.  If any of these differs the entry does not apply; if only the
state does, it has expired, which is reported rather than passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import mismatched_axes

#: Documents of the source system NCKM that are no targets, as (external id, version, SHA-256 of the file).
NOT_TARGETS = (
    ("95", "2013-08", "1ed630c0e334af03654251ada6f7ecf5c267fe4d1dd63720655000aee606f619"),
    ("96", "2013-08", "b89d491d748ee79def6cfa523e97ce9a0c72e0e695113cf716412f6f8073094e"),
    ("97", "2013-08", "030d430a66ae9f41a85095f382a872820ca60c78a3235569b8d56c6a7855f12e"),
    ("98", "2013-06", "4d9ce91d2941ec6ccdba689d3e985eff5108d4f0653dbafcb0572ff9bba2d12f"),
    ("124", "2020-03", "0e49a8f15030e02f44a5be7cc62cd3fbc72c6ca8cb3d1ce4c37866b10adc5e63"),
    ("125", "2020-03", "95202730d24bb13b368ab44f8dabd5d56d6858a12d601135d1a445437a325874"),
    ("90", "2007-10", "54640adf80353894680d542c3072b7a3e5546b4e85e144e3df4efc823790781f"),
    ("91", "2007-10", "4505589c560ba0873566b3c42f4fec803bcb8d095621164b125fb032cdda2b13"),
    ("92", "2009-01", "28ba7b640ed3a4b68a81ff197f8c4adfd0e2c41eef34a28fc5e01d7f4e8c313b"),
    ("93", "2010-05", "5a7ea127b6a87e723fc30f849bd5f751fb6b2a970d833c353fbb01916cefcfa5"),
    ("94", "2010-12", "12f0a678626b7e476800d59d91343861cba28a490db48114bc1d0204c28411d0"),
    ("185", "2022-02", "c5e0b91436a859ea0162be9e34b579e586564118a2a0c4b01537e16bf1bd4f09"),
    ("239", "2022-10", "013f9abde5863af740e801f90bed6d82740170ceb50dfdff4ca99287d886b0fb"),
    ("314", "2024-02", "c95770984a21c0d2458dd7713f0c47d4ae89460915dd062eddd4c2c0f28d6925"),
    ("668", "2022-06", "1183573ad6bdf20356ed997b0cf577f36a25af0d9c868bdf1b22bad800d36dba"),
)
#: Defects of sources, as (external id, version, SHA-256 of the file, diagnostic, numbers).
SOURCE_DEFECTS = (("306", "2026-06", "46af04040905427fa1d78070a3c28d3be53ced2bd57fb813974f878100f8716d", "duplicated", ("R20",)),)
SOURCE_SYSTEM = "NCKM"


def not_targets(spark: SparkSession) -> DataFrame:
    """source_system, external_id, version, file_hash."""
    return spark.createDataFrame([(SOURCE_SYSTEM, *e) for e in NOT_TARGETS], "source_system string, external_id string, version string, file_hash string")


def source_defects(spark: SparkSession) -> DataFrame:
    """source_system, external_id, version, file_hash, diagnostic, waived."""
    rows = [(SOURCE_SYSTEM, *e[:4], list(e[4])) for e in SOURCE_DEFECTS]
    return spark.createDataFrame(rows, "source_system string, external_id string, version string, file_hash string, diagnostic string, waived array<string>")


def looked_up(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``listed`` (an entry applies), ``expired`` (one names the document in another state) and ``differs`` (in what)."""
    state = {"version": "entry_version", "file_hash": "entry_file_hash"}
    one = entries.select("source_system", "external_id", *[F.col(c).alias(e) for c, e in state.items()]).dropDuplicates(["source_system", "external_id"])
    got = documents.join(F.broadcast(one), ["source_system", "external_id"], "left")  # a list kept by hand
    axes = mismatched_axes({c: (c, e) for c, e in state.items()})
    found = F.col("entry_version").isNotNull()
    return got.select(*[got[c] for c in documents.columns], (found & (F.size(axes) == 0)).alias("listed"), (found & (F.size(axes) > 0)).alias("expired"), F.when(found, axes).alias("differs"))


def known_defects(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, waived: the known defects of each document (doc_id and its state) that an entry names in just that state.

    Goes into ``guideline.waived``; an entry for another version or file waives nothing.
    """
    state = ["source_system", "external_id", "version", "file_hash"]
    return documents.join(entries, state).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("waived"))).alias("waived"))
