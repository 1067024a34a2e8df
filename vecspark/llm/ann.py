"""Approximate nearest neighbours with an inverted multi-index.

Two codebooks quantise the two halves of the vectors separately; a cell is a pair
of centroids, and its entries are listed under it. A query walks the pairs by
falling sum of its products with the two centroids, from a heap over the two
sorted lists, until enough entries are covered, and those are reranked by their
exact products.

Cells in order are cut into shelves of bounded size; a cell too large for one, of
a third of all rows say, is dealt over several. A query goes to the shelves that
hold a cell of its walk, with the cells it wants there, and to no other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm._common import stored

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``v`` (array of double) of the rows whose vectors take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    return picked.where(v.isNotNull() & F.col("id").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def kmeans(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids from a seeded start; an empty one stays where it is."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int, tile: int = 16) -> np.ndarray:
    """Cells (i * len(second) + j) by falling ``first[i] + second[j]`` until they hold ``wanted`` entries, ascending.

    The multi-sequence walk over the two sorted lists, cut into runs of ``tile``:
    a pair of runs enters the heap once both pairs before it have been taken.
    ``sizes`` has a row for each centroid of the first half. Empty cells are left out.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    grid = sizes[np.ix_(a, b)]
    rows, columns = np.arange(0, len(a), tile), np.arange(0, len(b), tile)
    count = np.add.reduceat(np.add.reduceat(grid, rows, axis=0), columns, axis=1, dtype=np.int64).tolist()
    fa = first[a][np.minimum(rows + tile // 2, len(a) - 1)].tolist()
    sb = second[b][np.minimum(columns + tile // 2, len(b) - 1)].tolist()
    n, m = len(fa), len(sb)
    taken, heap, done, held = np.zeros((n, m), dtype=bool), [(-(fa[0] + sb[0]), 0, 0)], [0] * n, 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        taken[i, j] = True
        held += count[i][j]
        if j + 1 < m and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(fa[i] + sb[j + 1]), i, j + 1))
        if i + 1 < n and done[i + 1] == j:
            heapq.heappush(heap, (-(fa[i + 1] + sb[j]), i + 1, j))
    i, j = np.nonzero((grid > 0) & np.repeat(np.repeat(taken, tile, axis=0)[: len(a)], tile, axis=1)[:, : len(b)])
    return np.sort(a[i] * len(b) + b[j])


def shelves(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first and last shelf: cells in order, about ``rows`` entries a shelf."""
    end = np.cumsum(sizes)
    return (end - sizes) // rows, np.maximum(end - 1, end - sizes) // rows


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search_block(ids: np.ndarray, cells: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, probes: list[np.ndarray], k: int, chunk: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of a shelf for each query among its probed cells: (query, id, score)."""
    own, cell = np.unique(cells, return_inverse=True)
    take = min(k, len(ids))
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(qids), chunk):
        asked, named = q[at : at + chunk], qids[at : at + chunk]
        wanted = np.zeros((len(named), len(own)), dtype=bool)
        for i, probed in enumerate(probes[at : at + chunk]):
            place = np.minimum(np.searchsorted(own, probed), len(own) - 1)
            wanted[i, place[own[place] == probed]] = True
        scores = asked @ v.T
        scores[~wanted[:, cell] | (ids[None, :] == named[:, None])] = -np.inf
        kth = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]
        slack = 1e-9 * np.maximum(1.0, np.abs(asked).sum(axis=1) * np.abs(v).max(initial=0.0))
        for i, name in enumerate(named):
            near = np.flatnonzero((scores[i] >= kth[i] - slack[i]) & np.isfinite(scores[i]))
            exact = (v[near] * asked[i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out[0].append(np.full(len(best), name))
            out[1].append(ids[near][best])
            out[2].append(exact[best])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, cells_per_half: int = 1024, share: float = 0.19, depth: int = 50, sample: int = 20_000, shelf_rows: int = 16_384, query_rows: int = 8192, rounds: int = 12, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest found by inner product.

    The codebooks are fitted on a bounded ``sample`` of rows (smallest hashes of
    the id); every row is indexed. A query's walk covers ``share`` of all rows and
    ``depth * k`` rows more: vectors without structure in many dimensions need so
    many for a recall over 0.9, others less. Rows whose vector is null, empty,
    zero or holds null or non-finite components, and rows without an id, take no
    part; nor do vectors of another length than the commonest one (of equally
    common ones the shortest). Ties go to the smaller id; repeated ids are all
    candidates, but not for their own id, which asks once, with its smallest
    vector. Too few candidates give fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.withColumn("vs_query", is_query).select(id_col, vec_col), id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = common["dim"]
    half = max(1, dim // 2)
    rows = rows.where(F.size("v") == dim)
    x = matrix(rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()["v"], dim)
    books = spark.sparkContext.broadcast((kmeans(x[:, :half], cells_per_half, rounds, seed), kmeans(x[:, half:], cells_per_half, rounds, seed + 1) if dim > 1 else np.zeros((1, 0))))
    n, m = (len(b) for b in books.value)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            v = matrix(batch.column(1), dim)
            cell = nearest(v[:, :half], first) * m + nearest(v[:, half:], second)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, type=pa.int32()), pa.array(np.arange(len(v)) + number)], names=["id", "v", "cell", "number"])
            number += len(v)

    indexed = stored(rows.mapInArrow(assign, "id bigint, v array<double>, cell int, number bigint"), "multi-index")
    found = indexed.groupBy("cell").count().toArrow()  # a row a cell: bounded by the codebooks
    sizes = np.zeros(n * m, dtype=np.int64)
    sizes[found["cell"].to_numpy()] = found["count"].to_numpy()
    total = int(sizes.sum())
    wanted = math.ceil(share * total) + depth * k
    counts = spark.sparkContext.broadcast((sizes.reshape(n, m).astype(np.int32), *shelves(sizes, shelf_rows)))
    schema = pa.schema([("shelf", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        size, low, high = counts.value
        for batch in batches:
            v = matrix(batch.column(1), dim)
            a, b = v[:, :half] @ first.T, v[:, half:] @ second.T
            for i, name in enumerate(batch.column(0).to_pylist()):
                cells = walk(a[i], b[i], size, wanted)
                copies = high[cells] - low[cells] + 1
                shelf = np.repeat(low[cells] - np.cumsum(copies) + copies, copies) + np.arange(int(copies.sum()))
                order = np.argsort(shelf, kind="stable")
                at, begin = np.unique(shelf[order], return_index=True)
                lists = np.split(np.repeat(cells, copies)[order], begin[1:])
                yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array([name] * len(at), type=pa.int64()), pa.array([v[i]] * len(at), type=schema.field(2).type), pa.array(lists, type=schema.field(3).type)], schema=schema)

    asked = usable(vectors.where(is_query).select(id_col, vec_col), id_col, vec_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(asked, "queries")
    query_blocks = max(1, math.ceil(asked.count() / query_rows))
    dealt = counts.value
    place = spark.createDataFrame(pa.table({"cell": pa.array(np.flatnonzero(sizes), type=pa.int32()), "low": dealt[1][sizes > 0], "high": dealt[2][sizes > 0]}))
    shelved = indexed.join(F.broadcast(place), "cell").withColumn("shelf", F.expr("low + pmod(xxhash64(number), high - low + 1)"))
    entries = shelved.select("shelf", "id", "v", "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    # A walk takes far longer than reading its query, so the queries are dealt over all cores.
    spread = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    queries = spread.mapInArrow(probe, "shelf bigint, id bigint, v array<double>, cells array<int>").withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        probes = [np.asarray(x.values) for x in right["cells"]]
        best = search_block(left["id"].to_numpy(), left["cell"].to_numpy(), matrix(left["v"], dim), right["id"].to_numpy(), matrix(right["v"], dim), probes, k)
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip((best[0].astype(np.int64), best[1].astype(np.int64), best[2]), FOUND, strict=True)], schema=FOUND)

    found = entries.groupBy("shelf", "qb").cogroup(queries.groupBy("shelf", "qb")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
