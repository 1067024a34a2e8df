"""Centroids, medoids, k-means and shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.metrics import l2_squared
from vecspark.operators.exact import matrix, vectors

# A linear congruence, plain enough for any SQL.
MULTIPLIER, MODULUS = 1103515245, 1 << 31


def hash_sample(id_col: str, rate: float, seed: int = 0) -> Column:
    """A predicate that holds for about ``rate`` of all ids, always the same ones; plain arithmetic."""
    mixed = (F.pmod(F.col(id_col), F.lit(MODULUS)) * F.lit(MULTIPLIER) + F.lit(12345 + seed)) % F.lit(MODULUS)
    return mixed < int(rate * MODULUS)


def fixed_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """The ``n`` rows of the smallest mixed ids, without replacement, always the same ones."""
    mixed = (F.pmod(F.col(id_col), F.lit(MODULUS)) * F.lit(MULTIPLIER) + F.lit(12345 + seed)) % F.lit(MODULUS)
    return df.orderBy(mixed, id_col).limit(n)


def with_global_ids(local: DataFrame, id_map: DataFrame) -> DataFrame:
    """Rows of ``shard``, ``local_id`` with the ``id`` they have over all shards."""
    return local.join(id_map, ["shard", "local_id"])


def local_ids(placed: DataFrame) -> DataFrame:
    """``shard``, ``local_id``, ``id``: places in each shard by id, from 0."""
    return placed.select("shard", (F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1).cast("bigint").alias("local_id"), "id")


def shard_labels(placed: DataFrame, points: DataFrame) -> DataFrame:
    """``shard``, ``id``, ``labels``: the labels of each shard's rows."""
    return placed.select("shard", "id").join(points.select("id", "labels"), "id").select("shard", "id", "labels")


def centroid(df: DataFrame, vec_col: str, *by: str) -> DataFrame:
    """``centroid``: the mean vector (of each group)."""
    parts = df.select(*by, F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def medoid(df: DataFrame, id_col: str, vec_col: str, *by: str) -> DataFrame:
    """The row nearest to the mean (of its group), ties to the smaller id: ``id``, ``dist``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), *by)
    means = centroid(rows, "v", *by)
    joined = rows.join(means, list(by)) if by else rows.join(F.broadcast(means))
    near = joined.withColumn("dist", l2_squared("v", "centroid")).groupBy(*by).agg(F.min(F.struct("dist", "id")).alias("best"))
    return near.select(*by, "best.id", "best.dist")


def nearest_centres(df: DataFrame, centres: np.ndarray, replicas: int = 1, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``id``, ``rank``, ``centre``, ``dist`` of the ``replicas`` nearest rows of ``centres`` (a fitted, bounded matrix)."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))
    schema = pa.schema([("id", pa.int64()), ("rank", pa.int32()), ("centre", pa.int32()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column(1))
                dist = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) if len(c) <= 64 else np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
                order = np.argsort(dist, axis=1, kind="stable")[:, :replicas]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(1, n + 1), len(x)), type=pa.int32()), pa.array(order.ravel(), type=pa.int32()), pa.array(np.take_along_axis(dist, order, 1).ravel())], schema=schema)

    return vectors(df, id_col, vec_col).mapInArrow(run, "id bigint, rank int, centre int, dist double")


def lloyd(df: DataFrame, centres: np.ndarray, id_col: str = "id", vec_col: str = "v") -> tuple[np.ndarray, float]:
    """One distributed round: new centres (an empty one stays) and the sum of distances to the old ones."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, size, cost = np.zeros_like(c), np.zeros(len(c), dtype=np.int64), np.zeros(len(c))
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                dist = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
                own = dist.argmin(axis=1)
                np.add.at(total, own, x)
                size += np.bincount(own, minlength=len(c))
                cost += np.bincount(own, dist[np.arange(len(x)), own], minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)), type=pa.int32()), pa.array(list(total), type=pa.list_(pa.float64())), pa.array(size), pa.array(cost)], names=["centre", "total", "n", "cost"])

    sums = vectors(df, id_col, vec_col).mapInArrow(run, "centre int, total array<double>, n bigint, cost double")
    parts = sums.select("centre", "n", "cost", F.posexplode("total").alias("pos", "x")).groupBy("centre", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    new = np.array(centres, dtype=np.float64)
    cost = 0.0
    for r in parts.collect():  # centres x dimensions rows
        if r.n:
            new[r.centre, r.pos] = r.x / r.n
        cost += r.cost if r.pos == 0 else 0.0
    return new, cost


def kmeans(df: DataFrame, k: int, rounds: int = 12, seed: int = 0, sample: int = 20_000, id_col: str = "id", vec_col: str = "v") -> np.ndarray:
    """k-means++ on a bounded sample, then Lloyd rounds over all rows until they gain less than 1e-5."""
    head = vectors(df, id_col, vec_col).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toArrow()
    centres = plus_plus(matrix(head["v"]), k, seed)
    last = None
    for _ in range(rounds):
        centres, cost = lloyd(df, centres, id_col, vec_col)
        if cost < 1e-12 or (last is not None and (last - cost) / cost < 1e-5):
            break
        last = cost
    return centres


def sampled_centres(df: DataFrame, k: int, rounds: int = 5, seed: int = 0, sample: int = 20_000, id_col: str = "id", vec_col: str = "v") -> np.ndarray:
    """k-means++ and Lloyd rounds on a bounded sample (at least a hundred rows a centre): where to cut, not what to keep."""
    head = vectors(df, id_col, vec_col).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(sample, 100 * k)).toArrow()
    x = matrix(head["v"])
    return lloyd_local(x, plus_plus(x, k, seed), rounds)


def plus_plus(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Seeded k-means++ starts: each drawn by squared distance to those before it."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(x)):
        total = near.sum()
        chosen.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def lloyd_local(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd rounds on a bounded matrix."""
    for _ in range(rounds):
        own = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def shards(df: DataFrame, centres: np.ndarray, replicas: int = 2, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``shard``, ``id``, ``v``: every row in the shards of its ``replicas`` nearest centres."""
    placed = nearest_centres(df, centres, replicas, id_col, vec_col).select("id", F.col("centre").alias("shard"))
    return placed.join(vectors(df, id_col, vec_col), "id").select("shard", "id", "v")


def ram_estimate(n: int, dim: int, degree: int, element_bytes: int = 4, slack: float = 1.3) -> float:
    """Bytes of a graph index of ``n`` rows: padded vectors, slack adjacency, a lock and a pointer each, a tenth more."""
    return 1.1 * n * ((dim + 7) // 8 * 8 * element_bytes + degree * 4 * slack + 40 + 24)


def centres_for_budget(df: DataFrame, budget: float, dim: int, degree: int, replicas: int = 2, sample_rate: float = 0.1, seed: int = 0, most: int = 1 << 14, id_col: str = "id", vec_col: str = "v") -> np.ndarray:
    """Centres of as few shards (3, then 2 more each time) as keep the largest estimated one in ``budget`` bytes.

    Counts that could not do even if all shards were equal are passed over. Raises
    if ``most`` shards are not enough.
    """
    part = df.where(hash_sample(id_col, sample_rate, seed))
    total = part.count() / sample_rate
    parts = 3
    while parts <= most and ram_estimate(int(total * replicas / parts), dim, degree) > budget:
        parts += 2
    while parts <= most:
        centres = kmeans(part, parts, 5, seed, id_col=id_col, vec_col=vec_col)
        sizes = nearest_centres(part, centres, replicas, id_col, vec_col).groupBy("centre").count().agg(F.max("count")).first()[0] or 0
        if ram_estimate(int(sizes / sample_rate), dim, degree) <= budget:
            return centres
        parts += 2
    raise ValueError(f"{budget} bytes are too few for any of {most} shards")


def clustered(df: DataFrame, centres: np.ndarray, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Rows by cluster: range-partitioned and sorted, each with its new position in its cluster."""
    placed = nearest_centres(df, centres, 1, id_col, vec_col).select("id", "centre").join(vectors(df, id_col, vec_col), "id")
    position = F.row_number().over(Window.partitionBy("centre").orderBy("id")) - 1
    return placed.withColumn("position", position).repartitionByRange("centre", "position").sortWithinPartitions("centre", "position")
