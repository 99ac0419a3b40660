"""Exact top-k inner products with block-at-a-time pruning.

Vectors are quantised to integers.  Candidates are cut into blocks of
neighbouring ids; a block's forward index is the matrix of its vectors, and
its term maxima are the largest and smallest value of each dimension.  For a
query q, sum over d of max(q_d * max_d, q_d * min_d) bounds every score in
the block.  Blocks are scored in order of that bound, in waves: each query's
best block gives a lower bound for its k-th score; the blocks whose bound is
not below it are ranked, and wave after wave, each WIDER times as long as
those before, is scored as far as the bounds still reach the k-th score known
by then.  A query is done at its first block that falls below.  Blocks that
are skipped can't change the result, so no candidate is lost.

Queries travel in blocks too, so that matrices meet matrices.  Neither side
is broadcast or gathered: query blocks are joined with groups of block
summaries (term maxima only), and the pairs that remain with the blocks.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; shorter vectors are padded with zeros; rows with the query's
own id are not its candidates; repeated rows are candidates each; ties go to
the smaller id; fewer than k candidates give all; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

TOP = 10
SCALE = 1024
#: Vectors in a block, queries in a query block, block summaries that travel together.
BLOCK, QUERIES_IN_BLOCK, SUMMARIES = 1024, 256, 1024
WIDER = 4


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: floor(SCALE * x) of each component of the vectors that take part."""
    x = F.col(vector)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    kept = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull()).where(~F.exists(x, bad))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double"))).alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; by floating point where every partial sum is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _blocks(rows: DataFrame, per_block: int, dim: int, name: str) -> DataFrame:
    """Blocks of rows with neighbouring ids: (name, ids, data), int64 in bytes.

    The range partitioning spreads rows evenly; each task cuts its own into blocks.
    """

    def cut(batches):
        from pyspark import TaskContext

        base, n, held = TaskContext.get().partitionId() << 32, 0, []

        def block(part):
            ids = part["vec_id"].to_numpy(np.int64)
            return pd.DataFrame({name: [base + n], "ids": [ids.tobytes()], "data": [_matrix(part["v"].tolist(), dim).tobytes()]})

        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= per_block:
                all_ = pd.concat(held)
                yield block(all_.iloc[:per_block])
                n += 1
                held = [all_.iloc[per_block:]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held))

    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInPandas(cut, f"{name} long, ids binary, data binary")


def _summaries(blocks: DataFrame, dim: int, per_group: int) -> DataFrame:
    """Term maxima of many blocks in one row: (blocks, hi, lo)."""

    def summarise(batches):
        held = []

        def group(part):
            return pd.DataFrame({k: [np.concatenate([p[i] for p in part]).tobytes()] for i, k in enumerate(("blocks", "hi", "lo"))})

        for pdf in batches:
            for r in pdf.itertuples():
                m = np.frombuffer(r.data, np.int64).reshape(-1, dim)
                held.append((np.array([r.block]), m.max(0), m.min(0)))
                if len(held) == per_group:
                    yield group(held)
                    held = []
        if held:
            yield group(held)

    return blocks.mapInPandas(summarise, "blocks binary, hi binary, lo binary")


def _paired(queries: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Every query block with every group of summaries, as an equi-join on a number drawn from the group's content."""
    numbered = groups.withColumn("group", F.pmod(F.xxhash64("blocks"), F.lit(n_groups)).cast("int"))
    return queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(numbered, "group")


def _bound_pairs(dim: int, first: bool):
    """Query block x summary group -> (qblock, block, queries): for each query its best block, or all blocks in reach."""

    def pairs(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                q = np.frombuffer(r.qdata, np.int64).reshape(-1, dim).astype(np.float64)
                hi = np.frombuffer(r.hi, np.int64).reshape(-1, dim).astype(np.float64)
                lo = np.frombuffer(r.lo, np.int64).reshape(-1, dim).astype(np.float64)
                ids = np.frombuffer(r.blocks, np.int64)
                bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                if first:
                    best = bound.argmax(1)
                    n = len(q)
                    yield pd.DataFrame({"qblock": np.full(n, r.qblock), "q": np.arange(n), "bound": bound[np.arange(n), best], "block": ids[best]})
                    continue
                slack = 1e-9 * (np.abs(bound) + 1)  # sums of products may be rounded here; never skip for that
                floor = np.frombuffer(r.floor, np.float64)
                at, blk = np.nonzero(bound + slack >= floor[:, None])
                yield pd.DataFrame({"qblock": np.full(len(at), r.qblock), "q": at, "bound": bound[at, blk], "block": ids[blk]})

    return pairs


def _score(dim: int, k: int):
    """Rows of a query block, the wanted queries in it, and a candidate block -> their k best there."""

    def score(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                at = np.unique(np.asarray(r.want, np.int64))
                q = np.frombuffer(r.qdata, np.int64).reshape(-1, dim)[at]
                qids = np.frombuffer(r.qids, np.int64)[at]
                ids = np.frombuffer(r.ids, np.int64)
                scores = _dot(q, np.frombuffer(r.data, np.int64).reshape(-1, dim))
                out = []
                for i, qid in enumerate(qids):
                    other = np.flatnonzero(ids != qid)
                    top = other[_best(scores[i][other], ids[other], k)]
                    out.append(pd.DataFrame({"qblock": r.qblock, "q": at[i], "query_id": qid, "vec_id": ids[top], "score": scores[i][top]}))
                yield pd.concat(out)

    return score


SCORED = "qblock long, q int, query_id long, vec_id long, score long"


def _top(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each query; each step of the merge keeps k a block, so a query has k rows a block at most."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, block: int = BLOCK, per_query_block: int = QUERIES_IN_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    ``vectors`` has vec_id and v (integers), ``is_query`` says which rows are queries.
    """
    spark = vectors.sparkSession
    dim = vectors.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = C.stored(_blocks(vectors, block, dim, "block"), "blocks")
    queries = _blocks(vectors.where(is_query).distinct(), per_query_block, dim, "qblock").withColumnsRenamed({"ids": "qids", "data": "qdata"})
    queries = C.stored(queries, "queries")
    groups = C.stored(_summaries(blocks.select("block", "data"), dim, SUMMARIES), "summaries")
    n_groups = groups.count()

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.groupBy("qblock", "block").agg(F.collect_list("q").alias("want"))  # at most a query block's queries
        return wanted.join(queries, "qblock").join(blocks, "block").select("qblock", "qids", "qdata", "want", "ids", "data").mapInPandas(_score(dim, k), SCORED)

    pair = "qblock long, q int, bound double, block long"
    first = _paired(queries.select("qblock", "qdata"), groups, n_groups).mapInPandas(_bound_pairs(dim, True), pair)
    first = first.groupBy("qblock", "q").agg(F.max_by("block", "bound").alias("block"))
    first = C.stored(first, "first")
    best = C.stored(_top(scored(first), k, "qblock", "q"), "best")

    def kth(best: DataFrame) -> DataFrame:
        return best.groupBy("qblock", "q").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))

    def floors(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row a query block: the k-th scores by position, -inf where fewer than k are known."""
        out = np.full(int(pdf["n"].iloc[0]), -np.inf)
        known = pdf.dropna(subset=["q", "floor"])
        out[known["q"].to_numpy(int)] = known["floor"].to_numpy(float)
        return pd.DataFrame({"qblock": [pdf["qblock"].iloc[0]], "floor": [out.tobytes()]})

    size = queries.select("qblock", (F.octet_length("qids") / 8).cast("int").alias("n"))
    floor = size.join(kth(best), "qblock", "left").groupBy("qblock").applyInPandas(floors, "qblock long, floor binary")
    ready = C.stored(queries.select("qblock", "qdata").join(floor, "qblock"), "floors")
    reach = _paired(ready, groups, n_groups).mapInPandas(_bound_pairs(dim, False), pair).join(first, ["qblock", "q", "block"], "left_anti")
    in_order = Window.partitionBy("qblock", "q").orderBy(F.col("bound").desc(), "block")
    reach = C.stored(reach.withColumn("place", F.row_number().over(in_order)), "reach")
    done, wave = 0, WIDER
    while True:
        ahead = reach.where(F.col("place").between(done + 1, done + wave)).join(kth(best), ["qblock", "q"], "left")
        slack = F.abs("bound") * 1e-9 + 1e-9
        ahead = C.stored(ahead.where(F.col("floor").isNull() | (F.col("bound") + slack >= F.col("floor"))).select("qblock", "q", "block"), "wave")
        if ahead.isEmpty():
            return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best = C.stored(_top(best.drop("rank").unionByName(scored(ahead)), k, "qblock", "q"), "best")
        done, wave = done + wave, wave * WIDER


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector."""
    vectors = quantised(C.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {"op10_topk": op10_topk}
ORACLE_SQL = {
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
}
