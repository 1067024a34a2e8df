"""Exact searches: nearest neighbours, ranges, filters, merges.

Both sides are dealt over blocks by a hash of their id, and each pair of blocks
is one task: a matrix product and a local top k, then a window over what is left.
Nothing is broadcast or gathered, so either side may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.metrics import Metric, metric

PAIRS = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])


def top_k(found: DataFrame, k: int, best_first: Column | None = None) -> DataFrame:
    """``rank`` from 1 by (dist, id) within each ``qid``, up to ``k``."""
    order = F.col("dist") if best_first is None else best_first
    w = Window.partitionBy("qid").orderBy(order, "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vectors(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """``id``, ``v`` and ``more`` of the rows that have both; vectors as doubles."""
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks_of(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def tiled(base: DataFrame, queries: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], block_rows: int = 32_768, query_rows: int = 2048, keys: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(base ids, base vectors, query ids, query vectors)`` -> (qid, id, dist) over all pairs of blocks.

    With ``keys``, columns of both sides, only blocks of equal keys meet; a key of
    many rows is still dealt over all blocks.
    """
    n, asked = blocks_of(base.count(), block_rows), queries.count()
    # Few blocks would leave cores idle: then queries are cut finer, down to 64 a block.
    cores = base.sparkSession.sparkContext.defaultParallelism
    m = max(blocks_of(asked, query_rows), min(blocks_of(cores, n), blocks_of(asked, 64)))
    spread = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    left = base.select(*keys, "id", "v").withColumn("b", spread(n, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = queries.select(*keys, "id", "v").withColumn("qb", spread(m, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return PAIRS.empty_table()
        found = kernel(x["id"].to_numpy(), matrix(x["v"]), q["id"].to_numpy(), matrix(q["v"]))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(found, PAIRS, strict=True)], schema=PAIRS)

    return left.groupBy(*keys, "b", "qb").cogroup(right.groupBy(*keys, "b", "qb")).applyInArrow(run, "qid bigint, id bigint, dist double")


def knn(base: DataFrame, queries: DataFrame, k: int, metric_name: str = "l2", id_col: str = "id", vec_col: str = "v", skip_self: bool = False, block_rows: int = 32_768, query_rows: int = 2048) -> DataFrame:
    """``qid``, ``rank``, ``id``, ``dist`` of the ``k`` nearest; ties to the smaller id.

    Distances are computed directly (not from the product expansion) for the rows
    near the k-th, so equal vectors have equal distances. Null vectors take no part.
    """
    own = metric(metric_name)
    kernel = nearest_kernel(k, metric_name, skip_self)
    found = top_k(tiled(vectors(base, id_col, vec_col), vectors(queries, id_col, vec_col), kernel, block_rows, query_rows), k)
    return found.select("qid", "rank", "id", (F.col("dist") * own.sign).alias("dist"))


#: Rows beyond the k-th that are measured directly before ties are looked for.
SPARE = 8
#: Numbers that direct distances may hold at once.
DIRECT = 1 << 22


def ranked(ids: np.ndarray, x: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, own: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, exact distance) of the ``k`` nearest of each query, by (distance, id).

    ``near`` holds distances from the product expansion; infinite ones do not
    count. Queries with more rows about the k-th than ``SPARE`` are done alone.
    """
    n, m = len(ids), min(k + SPARE, len(ids))
    picked = np.argpartition(near, m - 1, axis=1)[:, :m] if m < n else np.broadcast_to(np.arange(n), near.shape)
    value = np.take_along_axis(near, picked, 1)
    dist = np.where(np.isfinite(value), own.exact(q[:, None, :], x[picked]), np.inf)
    name = ids[picked]
    order = np.lexsort((name, dist), axis=-1)[:, :k]
    dist, name = np.take_along_axis(dist, order, 1), np.take_along_axis(name, order, 1)
    kept = np.isfinite(dist)
    place = np.broadcast_to(np.arange(len(q))[:, None], dist.shape)
    if m < n:
        kth = np.partition(value, min(k, m) - 1, axis=1)[:, min(k, m) - 1]
        tied = value.max(axis=1) <= kth + 1e-9 * np.maximum(1.0, np.abs(kth))
        kept = kept & ~tied[:, None]
    out = [place[kept]], [name[kept]], [dist[kept]]
    for i in np.flatnonzero(tied) if m < n else ():
        close = np.flatnonzero((near[i] <= kth[i] + 1e-9 * max(1.0, abs(kth[i]))) & np.isfinite(near[i])) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(near[i]))
        exact = own.exact(q[i], x[close])
        best = np.lexsort((ids[close], exact))[:k]
        for c, values in zip(out, (np.full(len(best), i), ids[close][best], exact[best]), strict=True):
            c.append(values)
    return tuple(np.concatenate(c) for c in out)


def nearest_kernel(k: int, metric_name: str, skip_self: bool = False):
    """The ``k`` nearest of a block for each query of a block; keys to minimise, not reported values."""
    own = metric(metric_name)

    def kernel(ids, x, qids, q):
        out = ([], [], [])
        step = max(1, min(256, DIRECT // max(1, min(k + SPARE, len(ids)) * x.shape[1])))
        for at in range(0, len(q), step):
            part, names = q[at : at + step], qids[at : at + step]
            near = own.block(part, x)
            if skip_self:
                near[names[:, None] == ids[None, :]] = np.inf
            place, found, dist = ranked(ids, x, part, near, k, own)
            for c, values in zip(out, (names[place], found, dist), strict=True):
                c.append(values)
        return tuple(np.concatenate(c) if c else np.empty(0) for c in out)

    return kernel


def within(base: DataFrame, queries: DataFrame, radius: float, metric_name: str = "l2", id_col: str = "id", vec_col: str = "v", block_rows: int = 32_768, query_rows: int = 2048) -> DataFrame:
    """``qid``, ``id``, ``dist`` of all rows within ``radius`` (``mips``: products of at least ``-radius``'s opposite)."""
    own = metric(metric_name)

    def kernel(ids, x, qids, q):
        out = ([], [], [])
        for at in range(0, len(q), 256):
            i, j = np.nonzero(own.block(q[at : at + 256], x) <= radius + 1e-9)
            dist = own.exact(q[at : at + 256][i], x[j])
            held = dist <= radius
            for c, values in zip(out, (qids[at : at + 256][i[held]], ids[j[held]], dist[held]), strict=True):
                c.append(values)
        return tuple(np.concatenate(c) if c else np.empty(0) for c in out)

    found = tiled(vectors(base, id_col, vec_col), vectors(queries, id_col, vec_col), kernel, block_rows, query_rows)
    return found.select("qid", "id", (F.col("dist") * own.sign).alias("dist"))


def knn_sql(pairs: DataFrame, k: int, metric_name: str = "l2", base_vec: str = "v", query_vec: str = "qv") -> DataFrame:
    """Top ``k`` of candidate pairs (``qid``, ``id`` and both vectors) by column expressions alone."""
    own = metric(metric_name)
    scored = pairs.withColumn("dist", own.column(query_vec, base_vec))
    return top_k(scored, k, F.col("dist") * own.sign).select("qid", "rank", "id", "dist")


def knn_labelled(base: DataFrame, queries: DataFrame, k: int, metric_name: str = "l2", universal: str | None = None, id_col: str = "id", vec_col: str = "v", labels_col: str = "labels", block_rows: int = 32_768, query_rows: int = 2048) -> DataFrame:
    """Nearest among rows that share a label with the query or carry the universal one.

    Labels are arrays of strings. Blocks meet by label, so only rows of the
    query's labels are looked at; a row that shares several is kept once. Queries'
    universal labels match nothing by themselves.
    """
    own = metric(metric_name)
    wanted = F.array_union(labels_col, F.array(F.lit(universal))) if universal is not None else F.array_distinct(labels_col)
    x = vectors(base, id_col, vec_col, labels_col).select("id", "v", F.explode(F.array_distinct(labels_col)).alias("label"))
    q = vectors(queries, id_col, vec_col, labels_col).select("id", "v", F.explode(wanted).alias("label"))
    found = tiled(x, q, nearest_kernel(k, metric_name), block_rows, query_rows, ("label",))
    best = top_k(found.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)
    return best.select("qid", "rank", "id", (F.col("dist") * own.sign).alias("dist"))


def merged(parts: dict[str, DataFrame], k: int, metric_name: str = "l2") -> DataFrame:
    """The best ``k`` over several indices' results, with the part each came from."""
    frames = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    every = frames[0]
    for df in frames[1:]:
        every = every.unionByName(df)
    order = Window.partitionBy("qid").orderBy(F.col("dist") * metric(metric_name).sign, "id", "part")
    return every.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
