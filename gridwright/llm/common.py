"""What the operators of this package share: tables, shared storage and column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.storage import files_for, materialize, release, shared_dir, spread

__all__ = ["BLANKS", "WORD", "again_shuffled", "ascii_lower", "files_for", "keyed", "let", "materialize", "release", "shared_dir", "table", "word_count", "words"]

#: A word, as every operator here counts it: a run of characters other than the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row: Catalyst may else copy an expensive expression into every use, lambda bodies included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs[columns] under the names given, with k1 and k2: 128 bits that tell rows apart by all these columns. Equal rows have equal keys."""
    first = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return docs.select(*columns, F.xxhash64(*first).alias("k1"), F.xxhash64(F.lit(1), *reversed(first)).alias("k2"))


#: For small sides of joins whose other side may have hot keys.
again_shuffled = spread
