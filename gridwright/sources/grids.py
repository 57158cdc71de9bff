"""Delimited text and plain lines as grids."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.core import text_of, trim_ws
from gridwright.operators.headers import unique_headers
from gridwright.operators.result import ROW
from gridwright.storage import pinned


def with_rows(df: DataFrame) -> DataFrame:
    """df with _row, contiguous from 0 in its order: rows are counted for each partition, and each partition starts where those before it end. No sort and no exchange; the counts are one row for each partition. df is checkpointed, as a second evaluation might deal its rows otherwise."""
    marked = pinned(df.withColumn("_id", F.monotonically_increasing_id()))
    counts = marked.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_p"], total))
        total += r["n"]
    table = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return marked.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(table), "_p").select((F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(ROW), *df.columns)


def read_csv(spark: SparkSession, path: str, multiline: bool = True, **options) -> DataFrame:
    """Every cell a string and never null, blank rows left out, headers unique. Quotes are doubled inside quotes. With multiline cells may hold line ends, and a file is read by one task; without it large files are split."""
    how = dict(multiLine=multiline, quote='"', escape='"', **options)
    told = [c or "" for c in spark.read.csv(path, header=False, **how).first() or [""]]
    names = unique_headers(told)
    # Files' headers are held against the first one's, unless that had to be changed.
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=names != told, **how)
    df = raw.toDF(*names)
    filled = F.exists(F.array(*[text_of(F.col("`" + c.replace("`", "``") + "`")) for c in names]), lambda x: trim_ws(x) != "")
    return with_rows(df.where(filled).select(*[text_of(F.col("`" + c.replace("`", "``") + "`")).alias(c) for c in names]))


def parse_csv(files: DataFrame) -> DataFrame:
    """files(file, content) of whole texts to file, row, cells: for many small files in one table. Blank lines are left out and rows padded to the file's widest."""

    def parse(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch["file"], batch["content"], strict=True):
                rows = [r for r in csv.reader(io.StringIO(content or "", newline="")) if any(c.strip() for c in r)]
                width = max(map(len, rows), default=0)
                out += [(name, i, r + [""] * (width - len(r))) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["file", "row", "cells"])

    return files.select("file", "content").mapInPandas(parse, "file string, row int, cells array<string>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, trimmed, without blank ones."""
    return with_rows(spark.read.text(path).select(trim_ws(F.col("value")).alias("value")).where("value != ''"))
