"""Nearest neighbours by a permutation index.

Pivots are vectors of the table.  Each vector is represented by its nearest pivots in
order and posted, with the place of the pivot in that order, in each one's inverted file.
A query walks the files of its own nearest pivots and adds up what it shares with the
vectors there, which ranks them by Spearman's footrule over the prefixes; the best of the
ranking are reranked by their inner products.

The vectors are dealt to shards of bounded size and the queries to blocks of bounded size;
each block meets each shard, and only a query's nearest of each shard go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, at most: they are broadcast (512 vectors).
PIVOTS = 512
#: Pivots that represent a vector.
PREFIX = 64
SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
#: Vectors of a shard of n that are reranked for a query: this times the root of n.
RERANK = 24


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` pivots with the largest inner product, best first."""
    near = x @ pivots.T
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


class Shard:
    """Inverted files of one shard: for each pivot the rows that hold it and its place."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int):
        self.x, self.pivots, self.prefix = x, pivots, prefix
        perm = orders(x, pivots, prefix)
        row = np.repeat(np.arange(len(x)), prefix)
        place = np.tile(np.arange(prefix), len(x))
        by = np.argsort(perm.ravel(), kind="stable")
        self.row, self.weight = row[by], (prefix - place[by]).astype(np.int32)
        self.first = np.searchsorted(perm.ravel()[by], np.arange(len(pivots) + 1))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """prefix * (prefix + 1) minus twice this is the footrule distance with absent
        pivots in the place behind the last: a larger value is nearer."""
        shared = np.zeros(len(self.x), np.int32)
        for place, p in enumerate(perm):
            a, b = self.first[p], self.first[p + 1]
            shared[self.row[a:b]] += np.minimum(self.weight[a:b], self.prefix - place)
        return shared

    def candidates(self, q: np.ndarray, most: int):
        """For each query, the rows that the ranking puts first."""
        for perm in orders(q, self.pivots, self.prefix):
            near = self.footrule(perm)
            yield np.argpartition(-near, most - 1)[:most] if most < len(near) else np.arange(len(near))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is a multiple of ``every``,
    the ``k`` others with the largest inner product, ties to the smaller id.

    Vectors that are null, zero, empty, or hold a null or non-finite component take no
    part, nor do rows without an id, nor vectors of another length than the most common
    one.  Rows that repeat an id and vector count once.  Of equal vectors the index holds
    the k + 1 with the smallest ids: no other can be among a query's k nearest.  Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == sizes["d"])
    copies = rows.dropDuplicates(["id", "v"]).withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1)
    shards = max(1, -(-sizes["n"] // SHARD_ROWS))
    is_query = F.col("id") % every == 0
    blocks = max(1, -(-sizes["n"] // (every * BLOCK_ROWS)))
    piv = np.array([r["v"] for r in rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(min(1.0, 4 * pivots / sizes["n"]) * 1_000_000)).dropDuplicates(["v"]).orderBy(F.xxhash64("v"), "id").limit(pivots).select("v").collect()])
    if not len(piv):
        piv = np.array([rows.orderBy("id").first()["v"]])
    shared = spark.sparkContext.broadcast(piv)
    prefix = min(prefix, len(piv))
    index = copies.select(F.col("id").alias("i_id"), F.col("v").alias("i_v"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("i_shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("i_block"))
    queries = rows.where(is_query).dropDuplicates(["id", "v"]).select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("q_block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("q_shard"))

    def meet(key, queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(index):
            x, q = np.stack(index["i_v"].to_numpy()), np.stack(queries["q_v"].to_numpy())
            ids = index["i_id"].to_numpy()
            shard = Shard(x, shared.value, prefix)
            most = min(len(x), max(4 * k, int(RERANK * np.sqrt(len(x)))))
            for one, name, rows in zip(q, queries["q_id"], shard.candidates(q, most), strict=True):
                score = x[rows] @ one
                score[ids[rows] == name] = -np.inf
                floor = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                take = np.flatnonzero((score >= floor - 1e-9 * max(1.0, abs(floor))) & np.isfinite(score))
                take = take[np.lexsort((ids[rows[take]], -score[take]))][: 2 * k]
                parts.append(pd.DataFrame({"query_id": name, "vec_id": ids[rows[take]], "q": [one] * len(take), "v": list(x[rows[take]])}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "q": [], "v": []})

    found = queries.groupBy("q_block", "q_shard").cogroup(index.groupBy("i_block", "i_shard")).applyInPandas(meet, "query_id bigint, vec_id bigint, q array<double>, v array<double>")
    # the score of record: products added one by one, so equal vectors score alike everywhere
    found = found.select("query_id", "vec_id", F.expr("aggregate(zip_with(q, v, (a, b) -> a * b), 0D, (s, x) -> s + x)").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
