"""Labels of points: files, numbering, statistics, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators.evaluate import at_fractions


def parse_labels(lines: DataFrame, line_col: str = "value") -> Column:
    """A line ``a,b,c`` as a sorted array of strings, without blanks and carriage returns."""
    clean = F.regexp_replace(F.col(line_col), r"[\r\n\t ]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(clean, ","), lambda x: x != "")))


def matches(point: Column, query: Column, universal: str | None = None, building: bool = False) -> Column:
    """Whether the label sets meet; the universal label passes on the point, at build time on either side."""
    found = F.arrays_overlap(point, query)
    if universal is not None:
        found = found | F.array_contains(point, universal)
        if building:
            found = found | F.array_contains(query, universal)
    return found


def label_map(points: DataFrame, labels_col: str = "labels", universal: str | None = None) -> DataFrame:
    """``label``, ``label_id``: from 1 in order of the names; the universal label is 0."""
    names = points.select(F.explode(labels_col).alias("label")).distinct()
    plain = names.where(F.col("label") != universal) if universal is not None else names
    # The universe of labels is a dimension table: one window over its distinct names.
    numbered = plain.withColumn("label_id", F.row_number().over(Window.orderBy("label")))
    if universal is None:
        return numbered
    return numbered.unionByName(points.sparkSession.createDataFrame([(universal, 0)], "label string, label_id int"))


def converted(wanted: DataFrame, mapping: DataFrame, label_col: str = "label", universal: bool = False) -> DataFrame:
    """``wanted`` with ``label_id``; an unknown label becomes 0 where there is a universal label, else an error."""
    unknown = F.lit(0) if universal else F.raise_error(F.concat(F.lit("unknown label: "), F.col(label_col))).cast("int")
    return wanted.join(mapping.withColumnRenamed("label", label_col), label_col, "left").withColumn("label_id", F.coalesce("label_id", unknown))


def histogram(points: DataFrame, labels_col: str = "labels") -> DataFrame:
    return points.select(F.explode(labels_col).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def statistics(points: DataFrame, labels_col: str = "labels", dense: int = 10) -> DataFrame:
    """One row: points, labels, share of points with at least ``dense`` labels, means."""
    each = points.agg(F.count("*").alias("n_points"), F.avg(F.size(labels_col)).alias("labels_per_point"), F.avg((F.size(labels_col) >= dense).cast("double")).alias("dense_share"))
    return each.join(F.broadcast(histogram(points, labels_col).agg(F.count("*").alias("n_labels"), F.avg("n").alias("points_per_label"))))


def count_percentiles(points: DataFrame, labels_col: str = "labels") -> DataFrame:
    """Points per label at 0, 5, ... 95 per cent of the labels."""
    return at_fractions(histogram(points, labels_col), "n", [p / 100 for p in range(0, 100, 5)])


def most_frequent(points: DataFrame, labels_col: str = "labels", k: int = 3) -> DataFrame:
    return histogram(points, labels_col).orderBy(F.desc("n"), "label").limit(k)


def broken_up(points: DataFrame, most: int, id_col: str = "id", labels_col: str = "labels") -> DataFrame:
    """Points of more than ``most`` labels as several copies of up to ``most``.

    ``id``, ``copy`` (0 is the point itself) and ``labels``; the copy's number with
    the id replaces a map from clones to points.
    """
    parts = points.select(F.col(id_col).alias("id"), F.posexplode(labels_col).alias("pos", "label"))
    return parts.groupBy("id", F.floor(F.col("pos") / most).cast("int").alias("copy")).agg(F.array_sort(F.collect_list("label")).alias("labels"))


def having_any(points: DataFrame, wanted: DataFrame, id_col: str = "id", labels_col: str = "labels") -> DataFrame:
    """Ids of points with one of the ``wanted.label``, by a semi-join."""
    return points.select(F.col(id_col).alias("id"), F.explode(labels_col).alias("label")).join(wanted.select("label"), "label", "left_semi").select("id").distinct()
