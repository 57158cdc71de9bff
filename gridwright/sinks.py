"""What leaves the engine: tidy and wide rows, indexes, manifests, workbooks, bundles.

tables(table_id, source_file, page, origin, section, note_ref, title, units, column_count, row_count,
confidence, warnings), cells(table_id, row, col, text) and labels(table_id, col, label).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import text
from gridwright.functions.core import text_of, trim_ws
from gridwright.functions.numbers import parse_number
from gridwright.operators.verify import check_totals
from gridwright.storage import numbered

MACHINE = ["source_file", "page", "table_id", "table_title", "note_ref", "section", "row_label", "column", "value", "unit"]
NOTES = ["source_file", "page", "note_ref", "note_title", "table_id", "row_label", "column", "value", "raw", "unit"]
INDEX = ["table_id", "source_file", "page", "origin", "section", "note_ref", "title", "units", "columns", "rows", "confidence", "warnings"]
MANIFEST = ["file", "kind", "bytes", "source", "page", "created", "note"]


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every cell quoted, quotes doubled, CRLF."""
    df.write.mode(mode).csv(path, header=True, quoteAll=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", nullValue="")


def csv_line(cells: list[Column]) -> Column:
    """One record as text."""
    quoted = [F.concat(F.lit('"'), F.replace(text_of(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return F.concat_ws(",", *quoted)


def _long(tables: DataFrame, cells: DataFrame, labels: DataFrame) -> DataFrame:
    label = cells.where("col = 0").select("table_id", "row", trim_ws(text_of(F.col("text"))).alias("row_label"))
    body = cells.where("col >= 1").where(trim_ws(text_of(F.col("text"))) != "")
    p = parse_number(F.col("text"))
    value = F.when(F.col("p.is_numeric"), F.col("p.clean")).when(F.col("p.is_nil"), "").otherwise(trim_ws(F.col("text")))
    named = F.coalesce("label", F.concat(F.lit("column_"), F.col("col").cast("string")))
    return body.withColumn("p", p).join(label, ["table_id", "row"], "left").join(labels, ["table_id", "col"], "left").join(tables, "table_id").select(
        "*", value.alias("value"), named.alias("column"), text_of(F.col("note_ref")).alias("_note"), text_of(F.col("title")).alias("_title"), text_of(F.col("section")).alias("_section"), text_of(F.col("units")).alias("unit")
    )


def machine_rows(tables: DataFrame, cells: DataFrame, labels: DataFrame, keys: bool = False) -> DataFrame:
    """Tidy rows: one for each filled cell beyond the label; figures plain, nil as ''. keys adds row and col."""
    return _long(tables, cells, labels).select(*["row", "col"] * keys, "source_file", "page", "table_id", F.col("_title").alias("table_title"), F.col("_note").alias("note_ref"), F.col("_section").alias("section"), F.coalesce("row_label", F.lit("")).alias("row_label"), "column", "value", "unit")


def note_order(note_ref: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(text_of(note_ref), r"[^\d.]", ""), r"^(\d*\.?\d+)", 1).try_cast("double"), F.lit(float(2**53 - 1)))


def notes_rows(tables: DataFrame, cells: DataFrame, labels: DataFrame, ordered: bool = True, keys: bool = False) -> DataFrame:
    """The same of tables in the notes, with the raw text, by note number."""
    rows = _long(tables.where("section = 'notes'"), cells, labels)
    out = rows.withColumns({"note_ref": F.col("_note"), "note_title": F.col("_title"), "raw": F.col("text")})
    if ordered and not keys:
        out = out.orderBy(note_order(F.col("note_ref")), "page", "table_id", "row", "col")
    return out.select(*["row", "col"] * keys, "source_file", "page", "note_ref", "note_title", "table_id", F.coalesce("row_label", F.lit("")).alias("row_label"), "column", "value", "raw", "unit")


def analyst_rows(tables: DataFrame, cells: DataFrame, labels: DataFrame) -> DataFrame:
    """table_id, source_file, page, row, cells (array, as printed), check_total: one for each row, wide without a schema of its own for each table."""
    wide = cells.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", text_of(F.col("text")).alias("t")))), lambda x: x["t"]).alias("cells"))
    checks = check_totals(cells, labels)
    return wide.join(checks, ["table_id", "row"], "left").join(tables.select("table_id", "source_file", "page"), "table_id").select("table_id", "source_file", "page", "row", "cells", F.coalesce("check_total", F.lit("")).alias("check_total"))


def index_rows(tables: DataFrame) -> DataFrame:
    t = lambda c: text_of(F.col(c)).alias(c)
    return tables.select("table_id", "source_file", "page", "origin", t("section"), t("note_ref"), t("title"), t("units"), F.col("column_count").alias("columns"), F.col("row_count").alias("rows"), F.format_string("%.2f", F.col("confidence").cast("double")).alias("confidence"), F.array_join("warnings", " | ").alias("warnings"))


def review_names(tables: DataFrame) -> DataFrame:
    """table_id, review_file: numbered within file and page."""
    n = F.row_number().over(W.partitionBy("source_file", "page").orderBy("table_id"))
    return tables.select("table_id", F.format_string("%s_p%s_t%d_review.csv", text.filename_base(F.col("source_file")), F.col("page").cast("string"), n).alias("review_file"))


def manifest_rows(entries: DataFrame, created: str, source: str = "") -> DataFrame:
    """entries(name, content, kind, source, page, note) to manifest rows."""
    return entries.select(
        F.col("name").alias("file"), F.coalesce(F.when(F.col("kind") != "", F.col("kind")), text.kind_from_name(F.col("name"))).alias("kind"), text.content_size(F.col("content")).alias("bytes"),
        F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit(source)).alias("source"), text_of(F.col("page")).alias("page"), F.lit(created).alias("created"), text_of(F.col("note")).alias("note"),
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def unique_entry_names(entries: DataFrame, order: str) -> DataFrame:
    """entries with entry: a name that repeats, case aside, gets _2, _3 before its extension. One name may be all entries'."""
    n = F.col("__nth")
    again = F.concat(F.regexp_replace("name", r"(\.[^.]*)?$", ""), F.lit("_"), n.cast("string"), F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return numbered(entries.withColumn("__low", F.lower("name")), "__low", order, "__nth").withColumn("entry", F.when(n == 1, F.col("name")).otherwise(again)).drop("__low", "__nth")


# Bundles: all files of an export as lines, however many tables there are


def bundle_lines(tables: DataFrame, cells: DataFrame, labels: DataFrame, index: bool = True) -> DataFrame:
    """file, at, line: the CSV files of an export, for each source file its tidy rows ({base}_data.csv), its tables as printed ({base}_p{page}_t{n}_review.csv), its notes, if it has any, and its index. Tables that are not selected stay out; lines are in order of at, which begins with 0 for a header."""
    if "selected" in tables.columns:
        tables = tables.where(F.coalesce("selected", F.lit(True)))
    base = text.filename_base(F.col("source_file"))
    named = lambda suffix: F.concat(base, F.lit(suffix)).alias("file")
    place = lambda *parts: F.struct(*[p.alias(f"p{i}") for i, p in enumerate([*parts, *[F.lit("")] * (4 - len(parts))])])
    row = lambda df, file, at, columns: df.select(file, at.alias("at"), csv_line(columns).alias("line"))
    digits = lambda c: F.lpad(F.coalesce(F.col(c), F.lit(0)).cast("string"), 12, "0")
    first = place(F.lit("0"))
    after = lambda *parts: place(F.lit("1"), *parts)
    sources = tables.select("source_file").distinct()

    def tidy(part: DataFrame, suffix: str, names: list[str], of) -> DataFrame:
        """Rows by table, row and column, under a header for each source that has any table of the kind."""
        rows = of(part, cells, labels, keys=True)
        head = row(part.select("source_file").distinct(), named(suffix), first, [F.lit(n) for n in names])
        return head.unionByName(row(rows, named(suffix), after(F.concat(*([F.lpad(F.format_string("%.4f", note_order(F.col("note_ref"))), 24, "0"), digits("page")] if suffix == "_notes.csv" else [F.lit("")])), F.col("table_id"), F.concat(digits("row"), digits("col"))), [F.col(n) for n in names]))

    data = tidy(tables, "_data.csv", MACHINE, machine_rows)
    notes = tidy(tables.where("section = 'notes'"), "_notes.csv", NOTES, notes_rows)
    names = review_names(tables).withColumnRenamed("review_file", "file")
    header = labels.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "label"))), lambda x: x["label"]).alias("labels"))
    quoted = lambda values: F.array_join(F.transform(values, lambda c: F.concat(F.lit('"'), F.replace(text_of(c), F.lit('"'), F.lit('""')), F.lit('"'))), ",")
    top = names.join(header, "table_id").select("file", first.alias("at"), quoted(F.concat(F.array(F.lit("source_file"), F.lit("page")), "labels", F.array(F.lit("check_total")))).alias("line"))
    review = analyst_rows(tables, cells, labels).join(names, "table_id").select("file", after(digits("row")).alias("at"), quoted(F.concat(F.array("source_file", F.col("page").cast("string")), "cells", F.array("check_total"))).alias("line"))
    out = [data, notes, top, review]
    if index:
        listed = index_rows(tables)
        out += [row(sources, named("_index.csv"), first, [F.lit(n) for n in INDEX]), row(listed, named("_index.csv"), after(digits("page"), F.col("table_id")), [F.col(n) for n in INDEX])]
    return reduce(DataFrame.unionByName, out)


def write_bundle(lines: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """bundle_lines as text, a folder for each file; its parts follow each other in order."""
    lines.repartitionByRange(F.col("file"), F.col("at")).sortWithinPartitions("file", "at").select("file", "line").write.mode(mode).partitionBy("file").option("lineSep", "\r\n").text(folder)


# Files made on the driver: bundles are deliverables of bounded size, not datasets.


def safe_sheet_name(name: str, taken: set[str]) -> str:
    """Without what workbooks forbid, 31 characters at most, unique case aside."""
    base = re.sub(r"[\[\]:*?/\\]", "_", str(name or "")).strip("'").strip()[:31] or "Sheet"
    out, n = base, 2
    while out.lower() in taken:
        tail = f"_{n}"
        out, n = base[: 31 - len(tail)] + tail, n + 1
    taken.add(out.lower())
    return out


def workbook_bytes(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook of string cells."""
    taken: set[str] = set()
    names = [safe_sheet_name(n, taken) for n, _ in sheets]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()

    def letters(c: int) -> str:
        s = ""
        while c >= 0:
            s, c = chr(65 + c % 26) + s, c // 26 - 1
        return s

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row) if str(v) != "") + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def to_workbook(tables: list[dict]) -> bytes:
    """tables: dicts with page, header (list of rows), rows, and index fields. INDEX first, then p{page}_t{n}."""
    count: dict = {}
    sheets = [("INDEX", [INDEX, *[[str(t.get(k, "")) for k in INDEX] for t in tables]])]
    for t in tables:
        count[t["page"]] = count.get(t["page"], 0) + 1
        sheets.append((f"p{t['page']}_t{count[t['page']]}", [*t["header"], *t["rows"]]))
    return workbook_bytes(sheets)


def grids_to_workbook(grids: dict[str, list[list[str]]]) -> bytes:
    """Several grids in one workbook, with an index of sheet, source, rows, columns."""
    taken: set[str] = {"index"}
    named = [(safe_sheet_name(re.sub(r"\.[^.]+$", "", n), taken), n, g) for n, g in grids.items()]
    index = [["sheet", "source", "rows", "columns", "notes"], *[[s, n, str(max(0, len(g) - 1)), str(max(map(len, g), default=0)), "" if len(g) > 1 else "no data rows"] for s, n, g in named]]
    return workbook_bytes([("INDEX", index), *[(s, g) for s, _, g in named]])


def workbook_to_csvs(name: str, content: bytes) -> dict[str, str]:
    """{book}_{sheet}.csv for each sheet."""
    from gridwright.sources.workbooks import read_workbook

    cells, _ = read_workbook(content)
    book = re.sub(r"[^A-Za-z0-9_-]+", "_", re.sub(r"\.[^.]+$", "", name)).strip("_") or "export"
    grids: dict[str, dict] = {}
    for sheet, _, r, c, t in cells:
        grids.setdefault(sheet, {})[r, c] = t
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    out = {}
    for sheet, g in grids.items():
        height, width = (max(k[i] for k in g) + 1 for i in (0, 1))
        out[f"{book}_{re.sub(r'[^A-Za-z0-9_-]+', '_', sheet).strip('_')}.csv"] = "\r\n".join(",".join(quote(g.get((r, c), "")) for c in range(width)) for r in range(height))
    return out


def bundle_bytes(entries: dict[str, str | bytes], manifest: list[dict], created: str, title: str = "Export") -> bytes:
    """A ZIP of the entries with MANIFEST.csv and manifest.json."""
    quote = lambda v: '"' + str(v).replace('"', '""') + '"'
    table = "\r\n".join(",".join(quote(x) for x in row) for row in [MANIFEST, *[[m.get(k, "") for k in MANIFEST] for m in manifest]])
    told = {"title": title, "created": created, "fileCount": len(manifest), "totalBytes": sum(int(m["bytes"]) for m in manifest), "files": [{"name": m["file"], "kind": m["kind"], "bytes": int(m["bytes"]), "source": m.get("source") or None, "page": m.get("page") or None, "note": m.get("note") or None} for m in manifest]}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, content in entries.items():
            z.writestr(n, content)
        z.writestr("MANIFEST.csv", table)
        z.writestr("manifest.json", json.dumps(told, indent=2))
    return out.getvalue()
