"""Product quantisation: chunks, codebooks, codes, lookup-table distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.metrics import metric
from vecspark.operators.exact import matrix, tiled, top_k, vectors
from vecspark.operators.partition import lloyd_local, plus_plus

# Centres of a chunk, rows to train on, Lloyd rounds; OPQ rounds and Lloyd rounds in each.
CENTRES, TRAINING_ROWS, ROUNDS, OPQ_ROUNDS, OPQ_LLOYD = 256, 256_000, 12, 20, 8


def chunk_bounds(dim: int, chunks: int) -> list[int]:
    """Where the chunks begin and end: sizes differ by one at most, larger ones first."""
    if not 0 < chunks <= dim:
        raise ValueError(f"{chunks} chunks of {dim} dimensions")
    small, more = divmod(dim, chunks)
    return np.cumsum([0, *([small + 1] * more), *([small] * (chunks - more))]).tolist()


def chunks_for_budget(budget: float, n: int, dim: int, most: int = 512) -> int:
    """Bytes a row that ``budget`` allows, within 1 and min(dim, ``most``)."""
    return int(max(1, min(budget // max(n, 1), dim, most)))


@dataclass(frozen=True)
class Codebook:
    """Centres by chunk, the mean taken off first, and a rotation or none."""

    bounds: tuple[int, ...]
    centres: tuple[np.ndarray, ...]
    mean: np.ndarray
    rotation: np.ndarray | None = None

    @property
    def chunks(self) -> int:
        return len(self.centres)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        x = self.prepared(x)
        out = np.empty((len(x), self.chunks), dtype=np.int32)
        for j, c in enumerate(self.centres):
            part = x[:, self.bounds[j] : self.bounds[j + 1]]
            out[:, j] = ((part[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1) if len(c) <= 32 else ((c * c).sum(1) - 2 * part @ c.T).argmin(axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        x = np.concatenate([c[codes[:, j]] for j, c in enumerate(self.centres)], axis=1)
        return (x if self.rotation is None else x @ self.rotation.T) + self.mean

    def table(self, q: np.ndarray, metric_name: str = "l2") -> list[np.ndarray]:
        """For each chunk, queries x centres: partial distances whose sum is that of the coded vector."""
        if metric_name == "l2":
            q = self.prepared(q)
            return [((q[:, None, self.bounds[j] : self.bounds[j + 1]] - c[None]) ** 2).sum(axis=2) for j, c in enumerate(self.centres)]
        turned = q if self.rotation is None else q @ self.rotation
        out = [-(turned[:, self.bounds[j] : self.bounds[j + 1]] @ c.T) for j, c in enumerate(self.centres)]
        out[0] = out[0] - (q @ self.mean)[:, None]
        return out

    def distances(self, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Queries x rows, by lookup."""
        return sum(t[:, codes[:, j]] for j, t in enumerate(tables))


def training_rows(df: DataFrame, id_col: str, vec_col: str, most: int, seed: int) -> np.ndarray:
    return matrix(vectors(df, id_col, vec_col).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).toArrow()["v"])


def trained(df: DataFrame, chunks: int, centres: int = CENTRES, zero_mean: bool = True, rows: int = TRAINING_ROWS, seed: int = 0, id_col: str = "id", vec_col: str = "v") -> Codebook:
    """A codebook from at most ``rows`` rows (smallest hashes)."""
    x = training_rows(df, id_col, vec_col, rows, seed)
    mean = x.mean(axis=0) if zero_mean else np.zeros(x.shape[1])
    x = x - mean
    bounds = chunk_bounds(x.shape[1], chunks)
    books = [lloyd_local(x[:, a:b], plus_plus(x[:, a:b], centres, seed + j), ROUNDS) for j, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return Codebook(tuple(bounds), tuple(books), mean)


def trained_rotated(df: DataFrame, chunks: int, centres: int = CENTRES, rows: int = 20_000, rounds: int = OPQ_ROUNDS, seed: int = 0, id_col: str = "id", vec_col: str = "v") -> Codebook:
    """OPQ: rotation and centres improved in turn, the rotation from the SVD of the correlation."""
    x = training_rows(df, id_col, vec_col, rows, seed)
    dim = x.shape[1]
    bounds = chunk_bounds(dim, chunks)
    turn = np.eye(dim)
    books = [plus_plus(x[:, a:b], centres, seed + j) for j, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    for _ in range(rounds):
        y = x @ turn
        books = [lloyd_local(y[:, a:b], c, OPQ_LLOYD) for (a, b), c in zip(zip(bounds, bounds[1:]), books)]
        book = Codebook(tuple(bounds), tuple(books), np.zeros(dim))
        u, _, vt = np.linalg.svd(x.T @ book.decode(book.encode(y)))
        turn = u @ vt
    return replace(book, rotation=turn)


def fixed(centres: np.ndarray, chunks: int) -> Codebook:
    """A codebook whose chunks are cut from given full vectors."""
    bounds = chunk_bounds(centres.shape[1], chunks)
    return Codebook(tuple(bounds), tuple(centres[:, a:b].copy() for a, b in zip(bounds, bounds[1:])), np.zeros(centres.shape[1]))


def _mapped(df: DataFrame, book: Codebook, id_col: str, vec_col: str, of, kind: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), of(shared.value, matrix(part.column(1)))], names=["id", "out"])

    return vectors(df, id_col, vec_col).mapInArrow(run, f"id bigint, out {kind}")


def encoded(df: DataFrame, book: Codebook, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``id``, ``code``: the number of the nearest centre in each chunk."""
    return _mapped(df, book, id_col, vec_col, lambda b, x: pa.array(list(b.encode(x)), type=pa.list_(pa.int32())), "array<int>").withColumnRenamed("out", "code")


def inflated_error(df: DataFrame, book: Codebook, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``id``, ``error``: squared distance between a vector and what its code stands for."""
    return _mapped(df, book, id_col, vec_col, lambda b, x: pa.array(((x - b.decode(b.encode(x))) ** 2).sum(axis=1)), "double").withColumnRenamed("out", "error")


def lookup_distances(df: DataFrame, queries: DataFrame, book: Codebook, k: int | None = None, metric_name: str = "l2", id_col: str = "id", vec_col: str = "v", labels_col: str | None = None, universal: str | None = None) -> DataFrame:
    """``qid``, ``id``, ``dist`` by lookup tables; the ``k`` nearest of each query, or all pairs.

    With ``labels_col`` (arrays on both sides) only rows that share a label with
    the query or carry the universal one are looked at: blocks meet by label.
    """
    shared = df.sparkSession.sparkContext.broadcast(book)

    def kernel(ids, x, qids, q):
        b = shared.value
        codes, out = b.encode(x), ([], [], [])
        for at in range(0, len(q), 256):
            dist = b.distances(b.table(q[at : at + 256], metric_name), codes)
            for i, row in enumerate(dist):
                near = np.lexsort((ids, row))[:k]
                for c, values in zip(out, (np.full(len(near), qids[at + i]), ids[near], row[near]), strict=True):
                    c.append(values)
        return tuple(np.concatenate(c) if c else np.empty(0) for c in out)

    if labels_col is None:
        found = tiled(vectors(df, id_col, vec_col), vectors(queries, id_col, vec_col), kernel)
    else:
        wanted = F.array_union(labels_col, F.array(F.lit(universal))) if universal is not None else F.array_distinct(labels_col)
        x = vectors(df, id_col, vec_col, labels_col).select("id", "v", F.explode(F.array_distinct(labels_col)).alias("label"))
        q = vectors(queries, id_col, vec_col, labels_col).select("id", "v", F.explode(wanted).alias("label"))
        found = tiled(x, q, kernel, keys=("label",)).groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    return found if k is None else top_k(found, k)


def reranked(df: DataFrame, queries: DataFrame, book: Codebook, k: int, factor: int = 3, metric_name: str = "l2", id_col: str = "id", vec_col: str = "v", labels_col: str | None = None, universal: str | None = None) -> DataFrame:
    """The ``k`` nearest by exact distance among the ``factor * k`` nearest by lookup."""
    own = metric(metric_name)
    near = lookup_distances(df, queries, book, factor * k, metric_name, id_col, vec_col, labels_col, universal).select("qid", "id")
    x, q = vectors(df, id_col, vec_col), vectors(queries, id_col, vec_col).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    scored = near.join(q, "qid").join(x, "id").withColumn("dist", own.column("qv", "v"))
    return top_k(scored, k, F.col("dist") * own.sign).select("qid", "rank", "id", "dist")
