"""Text files beside the vectors: label maps, query filters, labels of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.operators.labels import parse_labels
from vecspark.sources.binary import numbered_lines


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``label``, ``label_id`` of a file of ``label<TAB>number`` lines."""
    return spark.read.schema("label string, label_id int").csv(path, sep="\t")


def write_label_map(mapping: DataFrame, path: str) -> None:
    mapping.select("label", "label_id").orderBy("label_id").coalesce(1).write.csv(path, sep="\t")


def read_point_labels(spark: SparkSession, path: str) -> DataFrame:
    """``id`` (the line's number from 0), ``labels``; a line without a label is an error."""
    lines = numbered_lines(spark, path)
    found = lines.select(F.col("line").alias("id"), parse_labels(lines).alias("labels"))
    missing = F.raise_error(F.concat(F.lit("no label in line "), F.col("id").cast("string"))).cast("array<string>")
    return found.select("id", F.when(F.size("labels") > 0, F.col("labels")).otherwise(missing).alias("labels"))


def query_filters(lines: DataFrame, unique: bool = False) -> DataFrame:
    """``line``, ``label`` of numbered lines (``line``, ``value``) up to the first blank one; a comma is an error.

    With ``unique`` only the first line of each label stays.
    """
    clean = lines.select("line", F.regexp_replace("value", r"[\r\n\t ]", "").alias("label"))
    stop = clean.where("label = ''").agg(F.min("line").alias("stop"))
    kept = clean.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("line") < F.col("stop"))).drop("stop")
    one = F.when(F.col("label").contains(","), F.raise_error(F.concat(F.lit("several labels: "), F.col("label"))).cast("string")).otherwise(F.col("label"))
    kept = kept.select("line", one.alias("label"))
    return kept.groupBy("label").agg(F.min("line").alias("line")).select("line", "label") if unique else kept
