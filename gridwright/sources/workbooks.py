"""Workbooks and Word files, with nothing but the standard library, as long cells; and tables out of sheets.

sheet_cells(file, sheet, sheet_no, r, c, text) is the boundary: where it comes from doesn't matter
to what follows, which is windows only.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions.core import text_of, trim_ws
from gridwright.operators.extract.grids import classify, flagged, header_counts
from gridwright.storage import materialize

SHEET = ["file", "sheet", "sheet_no"]
ISLAND = [*SHEET, "island"]
# Sheets that describe others, and what counts as a table.
METADATA_NAME = r"(?i)^_TM_|^_xl|^Sheet\d+_meta$"
METADATA_HEAD = ["left", "top", "right", "bottom", "ref"]
MIN_ROWS, MIN_COLUMNS, MIN_CELLS, MAX_HEADERS, LEAST_CONFIDENCE = 2, 2, 4, 4, 0.75
COLUMN_GAP, ROW_GAP = 1, 2
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Za-z]+", ref)[0].upper():
        n = 26 * n + ord(ch) - 64
    return n - 1


def read_workbook(content: bytes):
    """(sheet, number from 1, row, column, text) of filled cells, and (sheet, number, r0, c0, r1, c1) of merged ranges."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    cells, merges = [], []
    for no, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
        target = targets[sheet.get(f"{_R}id")]
        root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        at = -1
        for row in root.iter(f"{_S}row"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            c = -1
            for cell in row.iter(f"{_S}c"):
                c = _column(cell.get("r")) if cell.get("r") else c + 1
                kind, v = cell.get("t"), cell.find(f"{_S}v")
                text = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "b":
                    text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
                if text.strip():
                    cells.append((sheet.get("name"), no, at, c, text.strip()))
        for m in root.iter(f"{_S}mergeCell"):
            a, _, b = m.get("ref").partition(":")
            merges.append((sheet.get("name"), no, int(re.search(r"\d+", a)[0]) - 1, _column(a), int(re.search(r"\d+", b or a)[0]) - 1, _column(b or a)))
    return cells, merges


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under path, merged ranges filled with their first cell's text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                cells, merges = read_workbook(content)
                grid = {(s, n, r, c): t for s, n, r, c, t in cells}
                for s, n, r0, c0, r1, c1 in merges:
                    if t := grid.get((s, n, r0, c0)):
                        grid |= {(s, n, r, c): t for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
                out += [(name.rpartition("/")[2], *k, t) for k, t in grid.items()]
            yield pd.DataFrame(out, columns=[*SHEET, "r", "c", "text"])

    return files.mapInPandas(run, "file string, sheet string, sheet_no int, r int, c int, text string")


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """The same natively: merges(file, sheet, sheet_no, r0, c0, r1, c1) laid over cells."""
    first = cells.join(merges, SHEET).where("r = r0 and c = c0")
    rows = first.select(*SHEET, "text", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("r"))
    cover = rows.select(*SHEET, "r", F.explode(F.sequence("c0", "c1")).alias("c"), "text")
    key = [*SHEET, "r", "c"]
    return cells.join(cover.select(*key), key, "left_anti").unionByName(cover.dropDuplicates(key))


def data_sheets(cells: DataFrame) -> DataFrame:
    """cells without metadata sheets: by name, or by the first five filled cells of their first filled row."""
    filled = cells.where(trim_ws(F.col("text")) != "")
    head = filled.withColumn("k", F.dense_rank().over(W.partitionBy(*SHEET).orderBy("r"))).where("k = 1")
    names = head.groupBy(*SHEET).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("c", "text"))), lambda x: F.lower(trim_ws(x["text"]))), 1, 5).alias("h"))
    meta = names.where(F.col("h") == F.array(*[F.lit(h) for h in METADATA_HEAD]))
    return cells.where(~F.col("sheet").rlike(METADATA_NAME)).join(meta, SHEET, "left_anti")


def skipped_sheets(cells: DataFrame) -> DataFrame:
    """file, sheet, warning: sheets that describe others, or hold no region large enough to be a table."""
    every = cells.select(*SHEET).distinct()
    data = data_sheets(cells)
    meta = every.join(data.select(*SHEET).distinct(), SHEET, "left_anti").withColumn("warning", F.lit("skipped: a sheet of metadata"))
    small = data.select(*SHEET).distinct().join(islands(data).select(*SHEET).distinct(), SHEET, "left_anti").withColumn("warning", F.lit("skipped: no region large enough to be a table"))
    return meta.unionByName(small).select("file", "sheet", "warning")


def used_range(cells: DataFrame) -> DataFrame:
    f = cells.where(trim_ws(F.col("text")) != "")
    return f.groupBy(*SHEET).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def _runs(cells: DataFrame, keys: list[str], axis: str, gap: int, name: str) -> DataFrame:
    """cells with the number of their run along an axis; a run ends where gap lines or more are blank."""
    d = cells.select(*keys, axis).distinct()
    w = W.partitionBy(*keys).orderBy(axis)
    d = d.withColumn("_new", F.coalesce((F.col(axis) - F.lag(axis).over(w) > gap).cast("int"), F.lit(0)))
    d = d.withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    return cells.join(d, [*keys, axis])


def islands(cells: DataFrame) -> DataFrame:
    """cells with island and their box (r0, r1, c0, c1): a sheet is cut at every blank column, each strip at two blank rows or more; what is left is large enough to be a table."""
    f = cells.where(trim_ws(F.col("text")) != "")
    cut = _runs(_runs(f, SHEET, "c", COLUMN_GAP, "strip"), [*SHEET, "strip"], "r", ROW_GAP, "part")
    box = cut.groupBy(*SHEET, "strip", "part").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"))
    box = box.where((F.col("r1") - F.col("r0") + 1 >= MIN_ROWS) & (F.col("c1") - F.col("c0") + 1 >= MIN_COLUMNS) & (F.col("n") >= MIN_CELLS))
    box = box.withColumn("island", F.row_number().over(W.partitionBy(*SHEET).orderBy("r0", "c0")) - 1)
    return cut.join(box.drop("n"), [*SHEET, "strip", "part"]).select(*ISLAND, "r0", "r1", "c0", "c1", "r", "c", "text")


def island_grids(found: DataFrame) -> DataFrame:
    """Rectangles: island keys, row, col, text with '' where a cell is blank."""
    box = found.select(*ISLAND, "r0", "r1", "c0", "c1").distinct()
    slots = box.select(*ISLAND, "r0", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("r")).select(*ISLAND, "r0", "c0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return slots.join(found.select(*ISLAND, "r", "c", "text"), [*ISLAND, "r", "c"], "left").select(*ISLAND, (F.col("r") - F.col("r0")).alias("row"), (F.col("c") - F.col("c0")).alias("col"), text_of(F.col("text")).alias("text"))


def header_rows(grid: DataFrame) -> DataFrame:
    """island keys, n_headers: rows before the first of which half the filled cells are magnitudes; four at most, and a body row is left."""
    t = F.col("text")
    big = F.col("is_numeric") & ~F.col("is_period")
    rows = flagged(grid).groupBy(*ISLAND, "row").agg(F.count_if(t != "").alias("n"), F.count_if((t != "") & big).alias("m"))
    data = F.min(F.when((F.col("n") > 0) & (F.col("m") * 2 >= F.col("n")), F.col("row")))
    return rows.groupBy(*ISLAND).agg(F.greatest(F.least(F.coalesce(data, F.max("row")), F.lit(MAX_HEADERS), F.max("row")), F.lit(0)).alias("n_headers"))


def sheet_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """tables, cells and headers of sheet_cells: confidence is at least LEAST_CONFIDENCE, as a sheet is a grid already."""
    # Several branches read the grid, so it is written once, with its figures told apart.
    grid = materialize(flagged(island_grids(islands(data_sheets(cells)))))
    verdict = classify(grid, keys=ISLAND)
    ident = F.concat_ws("-", "file", F.concat(F.lit("s"), "sheet_no"), F.concat(F.lit("t"), "island"))
    tables = verdict.join(header_rows(grid), ISLAND).withColumns({"table_id": ident, "confidence": F.greatest("confidence", F.lit(LEAST_CONFIDENCE)), "title": F.col("sheet"), "section": F.lit("other"), "origin": F.lit("xlsx"), "page": F.col("sheet_no")})
    rows = grid.join(tables.select(*ISLAND, "table_id", "n_headers"), ISLAND)
    return {
        "tables": tables, "headers": rows.where("row < n_headers").select("table_id", "row", "col", "text"),
        "cells": rows.where("row >= n_headers").select("table_id", (F.col("row") - F.col("n_headers")).alias("row"), "col", "text"),
    }


def is_docx(content) -> F.Column:
    """A Word file that can be read begins as a ZIP archive; older ones don't."""
    return F.substring(content, 1, 2) == F.lit(b"PK")


def docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, table_no, row, col, text of all tables in Word files under path, spans filled."""
    files = spark.read.format("binaryFile").load(path).where(is_docx(F.col("content"))).select("path", "content")

    def run(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                for n, table in enumerate(body.iter(f"{_W}tbl")):
                    above: dict[int, str] = {}
                    for r, row in enumerate(table.findall(f"{_W}tr")):
                        c = 0
                        for cell in row.findall(f"{_W}tc"):
                            p = cell.find(f"{_W}tcPr")
                            span = p.find(f"{_W}gridSpan") if p is not None else None
                            merge = p.find(f"{_W}vMerge") if p is not None else None
                            text = " ".join("".join(t.text or "" for t in x.iter(f"{_W}t")) for x in cell.findall(f"{_W}p")).strip()
                            if merge is not None and merge.get(f"{_W}val") != "restart":
                                text = above.get(c, "")
                            for _ in range(int(span.get(f"{_W}val")) if span is not None else 1):
                                out.append((name.rpartition("/")[2], n, r, c, text))
                                above[c] = text
                                c += 1
            yield pd.DataFrame(out, columns=["file", "table_no", "row", "col", "text"])

    return files.mapInPandas(run, "file string, table_no int, row int, col int, text string")


def word_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """docx_tables as every source gives them: tables, headers and cells. Header rows are found as on a printed page."""
    own = ["file", "table_no"]
    grid = materialize(flagged(docx_tables(spark, path)))
    size = grid.groupBy(*own).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")).where("width >= 2")
    heads = size.join(header_counts(grid, keys=own), own, "left").na.fill(0, ["n_headers"]).where("n_headers < height").withColumn("table_id", F.concat_ws("-", "file", F.concat(F.lit("t"), "table_no")))
    heads = materialize(heads)
    rows = grid.join(heads.select(*own, "table_id", "n_headers"), own)
    body = materialize(rows.where("row >= n_headers").withColumn("row", F.col("row") - F.col("n_headers")).drop("n_headers"))
    verdict = classify(body, keys=own).select(*own, "column_count", "row_count", "confidence", "warnings")
    return {"tables": heads.drop("height", "width").join(verdict, own).withColumn("origin", F.lit("docx")), "headers": rows.where("row < n_headers").select("table_id", "row", "col", "text"), "cells": body.select("table_id", "row", "col", "text")}
