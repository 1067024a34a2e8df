"""Connected components of an edge table, by alternating large and small stars.

Neither edges nor components reach the driver, only two numbers a round; each
round is a table in the shared folder, so a lost executor repeats one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._common import forget, stored


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes that aren't smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def thinned(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each batch of edges becomes a forest of stars."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], type=pa.int64()) for i in (0, 1)], schema=schema)

    return edges.mapInArrow(run, "u bigint, v bigint")


#: Parts that the rows of one key are dealt over where they meet what is known of it.
SALTS = 256


def salted_join(rows: DataFrame, known: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``known`` (one row a ``key``), inner.

    Rows of a key are dealt over salts by ``spread``, and what is known goes to
    the salts that the key has rows in: a key of a third of all rows is no burden,
    a key of one row costs one. All joins merge, as these tables grow with the documents.
    """
    dealt = rows.withColumn("vs_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("smallint"))
    told = dealt.select(key, "vs_salt").distinct().join(known.hint("merge"), key)
    return dealt.join(told.hint("merge"), [key, "vs_salt"]).drop("vs_salt")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of ``edges`` that isn't a root: the last table made.

    ``edges`` has two bigint columns without nulls, in any direction, repeats and
    loops allowed; no edges give no rows.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = stored(thinned(pairs).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now.sparkSession, -2, -1)  # the round before


def named_components(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    """``node``, ``component_id``: the least ``first`` in each component of ``nodes`` (``node`` unique, ``first``).

    ``rooted`` is what :func:`components` gives. Only linked nodes meet by component.
    """
    nodes = nodes.select("node", "first")
    tops = rooted.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    linked = nodes.join(rooted.select("node", "root").unionByName(tops).hint("merge"), "node")
    known = salted_join(linked, linked.groupBy("root").agg(F.min("first").alias("least")), "root", "node").select("node", "least")
    return nodes.join(known.hint("merge"), "node", "left").select("node", F.coalesce("least", "first").alias("component_id"))
