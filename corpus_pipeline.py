"""From raw documents to token ids: five stages, each written to the shared folder and read again.

Every stage takes null and empty texts, very long ones, rows of equal or no id,
more columns of any names, and empty tables; what it does with them is said below
and, in full, at the operator that it calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import bpe, decontaminate, pii, quality, simhash
from vecspark.llm._common import stored
from vecspark.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within that of trusted ones of their language; null and empty texts stay."""
    return quality.judged(docs, table(spark, sf_dir, "labels"), only_kept=True)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (null: largest); texts without words are alike."""
    return simhash.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item; each row is judged by its own text."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; a null text stays null."""
    return pii.redacted_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts (none for null), checked against what they decode to; columns of clashing names are replaced."""
    return bpe.tokenized(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_dedup", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: SQL expresses neither the perplexity model nor the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
