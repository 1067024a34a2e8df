"""Sharding by a two-pass external shuffle.

Pass one scatters the records over buckets that fit in memory, by a seeded hash;
pass two reads one bucket at a time, brings it into a fixed order, shuffles it
(Fisher-Yates, seeded by the bucket) and writes it. Buckets end to end are one
random permutation of all records; shards are equal runs of it, so record counts
differ by one at most (law ``rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm._common import stored


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of range(n): each place swaps with one at or before it, from the last."""
    order = np.arange(n)
    if n > 1:
        last = np.arange(n - 1, 0, -1)
        partners = np.random.default_rng(seed).integers(0, last + 1)
        for i, j in zip(last.tolist(), partners.tolist()):
            order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, seed: int = 17, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in shuffled buckets, stored in the shared folder.

    All columns of ``docs`` stay; added are ``vs_bucket`` and ``vs_place`` (the
    place in the bucket, from 0), ``vs_size`` (UTF-8 bytes of the text plus 1,
    null text: 1) and ``vs_crc32``. The hash takes id and text, so the scatter is
    uniform whatever hot source or group of copies the rows have. Rows of equal
    id and text are interchangeable. Columns of these names in ``docs`` are
    replaced.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    sized = docs.drop("vs_bucket", "vs_place", "vs_size", "vs_crc32").withColumns({"vs_size": F.octet_length(text).cast("bigint") + 1, "vs_crc32": F.crc32(text.cast("binary"))})
    total = sized.agg(F.sum("vs_size")).first()[0] or 1
    buckets = max(1, math.ceil(total / bucket_bytes))
    dealt = sized.withColumn("vs_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(buckets)).cast("int"))
    moved = dealt.repartitionById(buckets, F.col("vs_bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        keys = [("vs_bucket", "ascending"), (id_col, "ascending"), ("vs_crc32", "ascending"), (text_col, "ascending")]
        table = table.take(pa.compute.sort_indices(table.select([k for k, _ in keys]), sort_keys=keys))
        bucket = table["vs_bucket"].to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(bounds, bounds[1:]):
            if a < b:
                mixed = table.slice(a, b - a).take(pa.array(fisher_yates(b - a, (seed, int(bucket[a])))))
                yield from mixed.append_column("vs_place", pa.array(np.arange(b - a))).to_batches(max_chunksize=2000)

    kinds = T.StructType([*moved.schema.fields, T.StructField("vs_place", T.LongType())])
    return stored(moved.mapInArrow(run, kinds), "buckets")


def dealt(buckets: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot for the rows of ``shuffled``: equal runs of the permutation, slots from 0 without gaps.

    The counts of the buckets, one row each (their number is total bytes over
    bucket size), are all that is gathered.
    """
    spark = buckets.sparkSession
    counts = sorted((r[0], r[1]) for r in buckets.groupBy("vs_bucket").count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    total = before[-1]
    offsets = spark.createDataFrame([(b, o) for (b, _), o in zip(counts, before)], "vs_bucket int, vs_before bigint")
    at = F.col("vs_before") + F.col("vs_place")
    shard = F.expr(f"cast((vs_before + vs_place) * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return buckets.drop("shard", "slot").join(F.broadcast(offsets), "vs_bucket").withColumn("shard", shard).withColumn("slot", at - first).drop("vs_before")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: see :func:`shuffled` and :func:`dealt`.

    Null texts have size 1; empty tables give empty shards; repeated rows each get
    their own slot; columns of clashing names are replaced.
    """
    return dealt(shuffled(docs, seed, bucket_bytes, id_col, text_col), shards)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as Parquet folders ``shard=k``; a bucket's rows keep their order in its files."""
    sharded.drop("vs_bucket", "vs_place", "vs_size", "vs_crc32").write.partitionBy("shard").option("compression", "zstd").parquet(path)
