"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; where a stage
changes a text, n_chars follows. The last returns a row for each document left, with the words that
the mix takes of it.

Defined cases, of every stage: an empty table gives an empty result; other columns than those of
documents are carried through (mixing drops them), whatever their names; null sources are a source
of their own. Null, empty and blank texts fail the quality rules; the later stages leave them as
they are, but for the join, to which null and empty texts are copies of each other, and the mix, which
takes nothing of them. Of rows equal in doc_id and text line_dedup keeps one and empties the others,
and the join keeps one. A null doc_id comes first in line_dedup; the join keeps the least id of a
class that has any. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.bayes_join import keep_one
from gridwright.llm.common import files_for, materialize, release, table
from gridwright.llm.fair_mix import fair_mix
from gridwright.llm.line_frequency import clean_documents
from gridwright.llm.line_windows import dedup_lines
from gridwright.llm.string_tiling import without_leaks


def _packed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df, made of docs, in partitions that are worth a file."""
    return df.coalesce(files_for(docs))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted; takes frequent lines out of the rest."""
    return _counted(_packed(clean_documents(docs), docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later occurrences of repeated three-line windows out; a document that is nothing else keeps an empty text."""
    return _counted(_packed(dedup_lines(docs), docs).drop("line_spans"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return _packed(keep_one(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaked."""
    return _packed(without_leaks(docs, table(spark, sf_dir, "benchmark")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of what is left."""
    return fair_mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the join's classes nor the tiling. Every stage and run() are held against plain versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
