"""Recall and percentile rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_ties(truth: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of a truth set (``qid``, ``rank``, ``id``, ``dist``) and all at the k-th distance."""
    last = truth.where(F.col("rank") == k).select("qid", F.col("dist").alias("kth"))
    return truth.join(last, "qid", "left").where((F.col("rank") <= k) | (F.col("dist") == F.col("kth"))).select("qid", "id")


def recall_at(truth: DataFrame, found: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """One row, ``recall``: per cent of the ``k`` places of each query that hold true neighbours."""
    good = with_ties(truth, k) if ties else truth.where(F.col("rank") <= k).select("qid", "id")
    hits = found.where(F.col("rank") <= k).select("qid", "id").join(good, ["qid", "id"]).agg(F.count("*").alias("hits"))
    asked = truth.agg(F.countDistinct("qid").alias("n"))
    return hits.join(F.broadcast(asked)).select((100.0 * F.col("hits") / (F.col("n") * k)).alias("recall"))


def active_truth(truth: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """The first ``k`` true neighbours that are among the ``active`` ids, ranked anew."""
    w = Window.partitionBy("qid").orderBy("rank")
    return truth.join(active.select("id"), "id", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def range_recall(truth: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the mean over queries of per cent found; a query without true results counts 100."""
    size = truth.groupBy("qid").agg(F.count("*").alias("size"))
    hits = truth.join(found.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    each = queries.select("qid").join(size, "qid", "left").join(hits, "qid", "left")
    return each.agg(F.avg(F.when(F.col("size").isNull(), 100.0).otherwise(100.0 * F.coalesce("hits", F.lit(0)) / F.col("size"))).alias("recall"))


def ratio_of_sums(truth: DataFrame, found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("found")).join(F.broadcast(truth.agg(F.count("*").alias("true")))).select("found", "true", (F.col("found") / F.col("true")).alias("ratio"))


def at_fractions(values: DataFrame, value_col: str, fractions: list[float], top: bool = False) -> DataFrame:
    """``p``, ``value``: the sorted value at index floor(p * n), not interpolated; with ``top`` the largest at p = 1.

    Counts by distinct value with a running total by range: values of one range
    partition stay together, so no task sorts everything.
    """
    counts = values.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("value")).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    before = parts.groupBy("part").agg(F.sum("n").alias("held"))
    before = before.withColumn("before", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    high = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    placed = parts.join(F.broadcast(before.select("part", "before")), "part").select("value", (high - F.col("n")).alias("low"), high.alias("high"))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = values.sparkSession.createDataFrame([(float(p),) for p in fractions] + ([(1.0,)] if top else []), "p double")
    index = F.least(F.floor(F.col("p") * F.col("total")), F.col("total") - 1)
    at = wanted.join(F.broadcast(total)).withColumn("index", index)
    return placed.join(F.broadcast(at), (F.col("low") <= F.col("index")) & (F.col("index") < F.col("high"))).select("p", "value")


def simulated_recall(spark: SparkSession, parts: int, k: int, recalls: list[float], rounds: int, seed: int = 0) -> DataFrame:
    """One row: expected recall if ``k`` neighbours fall at random into ``parts`` partitions of the given recall by rank."""

    def run(batches):
        for batch in batches:
            out = []
            for i in batch["id"]:
                hits = np.bincount(np.random.default_rng((seed, int(i))).integers(0, parts, k), minlength=parts)
                out.append(sum(c * recalls[min(c, len(recalls)) - 1] for c in hits if c) / k)
            yield pd.DataFrame({"recall": out})

    return spark.range(rounds).mapInPandas(run, "recall double").agg(F.avg("recall").alias("recall"))
