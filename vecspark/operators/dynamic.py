"""A mutable set of vectors: inserts with a status, tombstones, compaction, graph repair.

State is a table of live rows and a table of tombstones; every step gives new
tables, so a step that fails leaves the old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of an insert.
INSERTED, REFUSED = 0, -1


def insert_status(rows: DataFrame, live: DataFrame, capacity: int | None = None, labels_col: str | None = None) -> DataFrame:
    """``rows`` with ``status``: refused are id 0 or null, ids that live, repeats in the batch, and what exceeds capacity.

    With ``labels_col`` rows without labels are refused. Among rows that fit, the
    smaller ids go first. A total order is needed only where capacity is short, so
    only then is there one window over the accepted rows.
    """
    marked = rows.join(live.select("id").distinct().withColumn("vs_lives", F.lit(True)), "id", "left")
    first = F.row_number().over(Window.partitionBy("id").orderBy(*(c for c in rows.columns if c != "id")))
    bad = F.col("id").isNull() | (F.col("id") == 0) | F.col("vs_lives").isNotNull() | (F.col("vs_first") > 1)
    if labels_col:
        bad = bad | F.col(labels_col).isNull() | (F.size(labels_col) == 0)
    marked = marked.withColumn("vs_first", first).withColumn("status", F.when(bad, REFUSED).otherwise(INSERTED))
    if capacity is not None:
        room = capacity - live.count()
        good = marked.where(F.col("status") == INSERTED)
        if good.count() > room:
            fits = good.orderBy("id").limit(max(room, 0)).select("id", F.lit(True).alias("vs_fits"))
            marked = marked.join(fits, "id", "left").withColumn("status", F.when(F.col("vs_fits") & (F.col("status") == INSERTED), INSERTED).otherwise(REFUSED))
    return marked.select(*rows.columns, "status")


def inserted(live: DataFrame, rows: DataFrame, **options) -> DataFrame:
    good = insert_status(rows, live, **options).where(F.col("status") == INSERTED).drop("status")
    return live.unionByName(good.select(*live.columns))


def failed_deletes(live: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids to delete that do not live."""
    return ids.select("id").distinct().join(live.select("id"), "id", "left_anti")


def active(live: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Live rows without a tombstone."""
    return live.join(tombstones.select("id"), "id", "left_anti")


def repaired_candidates(graph: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``id``, ``nbrs`` of every live row: its live neighbours and those of its deleted neighbours, itself left out.

    Lists longer than the degree go through ``graph.pruned`` afterwards.
    """
    dead = tombstones.select("id").distinct()
    live = graph.join(dead, "id", "left_anti")
    edges = live.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))
    gone = dead.select(F.col("id").alias("dst"))
    kept = edges.join(gone, "dst", "left_anti").select("src", "dst")
    second = graph.join(dead, "id", "left_semi").select(F.col("id").alias("mid"), F.explode("nbrs").alias("dst"))
    through = edges.join(gone, "dst", "left_semi").select("src", F.col("dst").alias("mid")).join(second, "mid").join(gone, "dst", "left_anti").select("src", "dst")
    lists = kept.unionByName(through).where("src != dst").distinct().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    return live.select("id").join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def consolidated(live: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live rows after compaction, one-row report: active, deleted, unknown tombstones)."""
    left = active(live, tombstones)
    report = left.agg(F.count("*").alias("active")).join(F.broadcast(live.join(tombstones.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("deleted")))).join(F.broadcast(failed_deletes(live, tombstones).agg(F.count("*").alias("unknown"))))
    return left, report


def capacity_check(n_live: int, n_removed: int, n_new: int, most: int) -> bool:
    """Whether a batch fits after consolidating; raises if not even then. Consolidate first if it returns False."""
    if n_live + n_new <= most:
        return True
    if n_live - n_removed + n_new <= most:
        return False
    raise RuntimeError(f"{n_new} vectors do not fit: {n_live} of {most} in use, {n_removed} of them deleted")
