"""Edits of tables in long form: cells(table_id, row, col, text), headers alike, and tables(table_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .headers import tool_headers
from .result import ROW, columns_of

KEY = ["table_id", "row", "col"]


def set_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(table_id, row, col, text) laid over cells; edits outside the grid do nothing. Works on headers too."""
    e = edits.select(*KEY, F.col("text").alias("_new"))
    return cells.join(e, KEY, "left").select(*KEY, F.coalesce("_new", "text").alias("text"))


def delete_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Without rows(table_id, row), renumbered."""
    return _renumbered(cells.join(rows, ["table_id", "row"], "left_anti"), "row")


def delete_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return _renumbered(cells.join(columns, ["table_id", "col"], "left_anti"), "col")


def _renumbered(cells: DataFrame, axis: str) -> DataFrame:
    n = F.dense_rank().over(W.partitionBy("table_id").orderBy(axis)) - 1
    return cells.withColumn(axis, n)


def insert_rows_after(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """A blank row after each of rows(table_id, row)."""
    kind = dict(cells.dtypes)["row"]
    blank = cells.join(rows, ["table_id", "row"], "left_semi").select("table_id", F.col("row").cast("double") + 0.5, "col", F.lit("").alias("text"))
    out = _renumbered(cells.select("table_id", F.col("row").cast("double").alias("row"), "col", "text").unionByName(blank.toDF("table_id", "row", "col", "text")), "row")
    return out.withColumn("row", F.col("row").cast(kind))


def promote_rows(cells: DataFrame, headers: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(table_id, row) leave the body and become the last header row of their table. (cells, headers)"""
    moved = cells.join(rows, ["table_id", "row"], "left_semi")
    depth = headers.groupBy("table_id").agg((F.max("row") + 1).alias("_d"))
    added = moved.join(depth, "table_id", "left").select("table_id", F.coalesce("_d", F.lit(0)).cast(dict(headers.dtypes)["row"]).alias("row"), "col", "text")
    return delete_rows(cells, rows), headers.select(*KEY, "text").unionByName(added)


def demote_headers(cells: DataFrame, headers: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of tables(table_id), the header rows become the first body rows. (cells, headers)"""
    moved = headers.join(tables.select("table_id"), "table_id", "left_semi")
    n = moved.groupBy("table_id").agg((F.max("row") + 1).alias("_n"))
    shifted = cells.join(n, "table_id", "left").select("table_id", (F.col("row") + F.coalesce("_n", F.lit(0))).cast(dict(cells.dtypes)["row"]).alias("row"), "col", "text")
    return shifted.unionByName(moved.select(*KEY, "text")), headers.join(tables.select("table_id"), "table_id", "left_anti")


def select_tables(tables: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(table_id, selected) laid over tables."""
    return tables.join(chosen.withColumnRenamed("selected", "_s"), "table_id", "left").withColumn("selected", F.coalesce("_s", "selected")).drop("_s")


def set_meta(tables: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(table_id, ...) laid over tables: of the columns that both have, what isn't null replaces what is there."""
    shared = [c for c in patches.columns if c != "table_id" and c in tables.columns]
    p = patches.select("table_id", *[F.col(c).alias(f"_{c}") for c in shared])
    return tables.join(p, "table_id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in shared else F.col(c) for c in tables.columns])


def select_documents(tables: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(doc_id, selected) laid over all tables of a document."""
    return tables.join(chosen.withColumnRenamed("selected", "_s"), "doc_id", "left").withColumn("selected", F.coalesce("_s", "selected")).drop("_s")


def map_columns(labels: DataFrame, names: DataFrame) -> DataFrame:
    """names(table_id, col, name), the declared names of detected columns, laid over labels(table_id, col, label)."""
    n = names.select("table_id", "col", F.nullif(F.trim("name"), F.lit("")).alias("_n"))
    return labels.join(n, ["table_id", "col"], "left").select("table_id", "col", F.coalesce("_n", "label").alias("label"))


def add_warnings(tables: DataFrame, told: DataFrame) -> DataFrame:
    """told(table_id, warning) added to tables' warnings, each once, in alphabetic order after those that are there."""
    more = told.groupBy("table_id").agg(F.array_sort(F.collect_set("warning")).alias("_w"))
    return tables.join(more, "table_id", "left").withColumn("warnings", F.array_union(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce("_w", F.array().cast("array<string>")))).drop("_w")


def session_stats(files: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """files, docs, tables, selected, pages, ocr_pages, needs_ocr, warnings of a session: files(path), pages(doc_id, page, needs_ocr, ocr_applied), tables(table_id, selected, warnings). Single rows meet."""
    p = pages.agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("pages"), F.count_if("ocr_applied").alias("ocr_pages"), F.count_if(F.col("needs_ocr") & ~F.col("ocr_applied")).alias("needs_ocr"))
    t = tables.agg(F.count(F.lit(1)).alias("tables"), F.count_if("selected").alias("selected"), F.coalesce(F.sum(F.size(F.coalesce("warnings", F.array().cast("array<string>")))), F.lit(0)).alias("warnings"))
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(p).crossJoin(t).select("files", "docs", "tables", "selected", "pages", "ocr_pages", "needs_ocr", "warnings")


def to_grid(cells: DataFrame, headers: DataFrame, table_id: str) -> DataFrame:
    """One table of a session as a tool's grid: _row, and its columns under the stacked headers, each distinct text once. The header is metadata; a table has as many columns as it has."""
    own = F.col("table_id") == table_id
    width = (cells.where(own).agg(F.max("col")).first()[0] or 0) + 1
    stack: dict[int, dict[int, str]] = {}
    for r in headers.where(own & (F.col("col") < width)).select("row", "col", "text").collect():
        stack.setdefault(r["row"], {})[r["col"]] = r["text"]
    if stack:
        names = tool_headers([[stack[r].get(c, "") for c in range(width)] for r in sorted(stack)], width)
    else:
        names = ["row_label", *[f"column_{c}" for c in range(1, width)]]
    at = lambda c: F.coalesce(F.max(F.when(F.col("col") == c, F.col("text"))), F.lit(""))
    return cells.where(own).groupBy(F.col("row").cast("long").alias(ROW)).agg(*[at(c).alias(n) for c, n in enumerate(names)])


def preview(df: DataFrame, rows: int = 80, columns: int = 40) -> tuple[DataFrame, int, int]:
    """The first rows and columns of a grid, and how many of each are left out: a look at it, not the data."""
    names = columns_of(df)
    return df.orderBy(ROW).select(ROW, *[F.col(f"`{c}`") for c in names[:columns]]).limit(rows), max(0, df.count() - rows), max(0, len(names) - columns)


def with_defaults(tables: DataFrame) -> DataFrame:
    """Tables as they arrive, with what may be lacking filled in."""
    d = {"title": "", "note_ref": "", "section": "other", "units": "", "origin": "unknown", "source_file": ""}
    out = tables
    for c, v in d.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in tables.columns else F.lit(v))
    confidence = F.coalesce(F.col("confidence"), F.lit(0.5)) if "confidence" in tables.columns else F.lit(0.5)
    return out.withColumns({"confidence": F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), "selected": F.coalesce(F.col("selected"), F.lit(True)) if "selected" in tables.columns else F.lit(True)})
