"""Scenarios over time: a sliding window of live rows, and incremental builds with snapshots.

Rows arrive in order of their position; a window keeps the last ``window`` of them
plus the batch just added. On a stream each micro-batch inserts its rows, deletes
those that left the window and compacts, as a new version of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.dynamic import active, inserted


def check_window(window: int, interval: int, most: int) -> None:
    if most < window + interval:
        raise ValueError("the table must hold the window and one interval")
    if interval < most / 1000:
        raise ValueError("the interval is less than a thousandth of the table")


def steps(rows: DataFrame, window: int, interval: int, id_col: str = "id") -> DataFrame:
    """``step``, ``first``, ``last``, ``n_live``: which ids live after each step, for dense ids from 0.

    Step 0 inserts the window; each later one inserts ``interval`` rows, and from
    the second on the oldest ``interval`` go.
    """
    top = rows.agg((F.max(id_col) + 1).alias("n"))
    steps_in_all = F.greatest(F.lit(0), F.floor((F.col("n") - window) / interval)).cast("bigint")
    # Ids are counted by blocks that no window cuts; a block is in few steps, so it names them.
    size = math.gcd(window, interval)
    blocks = rows.groupBy(F.floor(F.col(id_col) / size).cast("bigint").alias("block")).agg(F.count("*").alias("rows"))
    begin = F.col("block") * size
    early = F.greatest(F.lit(0), F.ceil((begin + size - window) / interval)).cast("bigint")
    late = F.least(steps_in_all, (F.floor(begin / interval) + 1).cast("bigint"))
    named = blocks.join(F.broadcast(top)).where(early <= late).select("n", "rows", F.explode(F.sequence(early, late)).alias("step"))
    first = F.greatest(F.col("step") - 1, F.lit(0)) * interval
    last = F.least(F.col("n"), window + F.col("step") * interval) - 1
    return named.groupBy(F.col("step").cast("int").alias("step"), first.alias("first"), last.alias("last")).agg(F.sum("rows").alias("n_live"))


def snapshots(rows: DataFrame, first: int, batch: int, every: int, id_col: str = "id") -> DataFrame:
    """``snapshot``, ``n_rows``: an incremental build of ``first`` rows and batches, saved after each ``every`` batches."""
    step = F.when(F.col(id_col) < first, 0).otherwise(F.floor((F.col(id_col) - first) / batch) + 1)
    counts = rows.groupBy(F.ceil(step / every).cast("int").alias("snapshot")).agg(F.count("*").alias("n"))
    # A row a snapshot: the running total is over as many rows as there are saved versions.
    return counts.select("snapshot", F.sum("n").over(Window.orderBy("snapshot")).alias("n_rows"))


class WindowedTable:
    """The live rows as versioned Parquet folders; one micro-batch makes one version."""

    def __init__(self, spark, path: str, window: int):
        self.spark, self.path, self.window, self.version = spark, path, window, -1

    def live(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/v{self.version}") if self.version >= 0 else None

    def apply(self, batch: DataFrame, version: int) -> None:
        """Insert ``batch``, drop rows that left the window; a version seen before is written over alike."""
        if version < self.version:
            return
        before = self.live() if version > self.version else (self.spark.read.parquet(f"{self.path}/v{version - 1}") if version > 0 else None)
        now = batch.dropDuplicates(["id"]) if before is None else inserted(before, batch)
        newest = now.agg(F.max("id")).first()[0]
        if newest is not None:
            gone = now.where(F.col("id") <= newest - self.window).select("id")
            now = active(now, gone)
        now.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.version = version

    def follow(self, stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Run over a streaming frame (``id`` and other columns) until what is available is used up."""

        def each(batch: DataFrame, version: int) -> None:
            self.apply(batch, version)
            if then:
                then(self.live(), version)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
