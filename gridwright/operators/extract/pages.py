"""What belongs to a page rather than a table: furniture, scans, sections, notes; and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import numbers, text
from gridwright.functions.core import trim_ws
from gridwright.storage import materialize

from . import grids
from .lines import PAGE, assign_lines, bands, lines, normalise_words, page_metrics, split_cells

TEXT_LAYER_MIN, FURNITURE_SHARE, FURNITURE_CHARS = 180, 0.4, 120
REGION_SIDE, REGION_CHARS = 60, 40
BAND = grids.BAND


def furniture(line_rows: DataFrame, share: float = FURNITURE_SHARE) -> DataFrame:
    """doc_id, key, pages, text: what stands at the same spot of at least two pages and so many of all."""
    total = line_rows.groupBy("doc_id").agg(F.countDistinct("page").alias("total"))
    keyed = line_rows.where(F.length("text") <= FURNITURE_CHARS).select("doc_id", "page", text.furniture_key(F.col("center"), F.col("x"), F.col("text")).alias("key"), "text")
    seen = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"), F.min_by("text", "page").alias("text"))
    return seen.join(total, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") * share))).select("doc_id", "key", "pages", "text")


def strip_furniture(line_rows: DataFrame, pages: DataFrame | None = None, minimum: int = TEXT_LAYER_MIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept lines, removed lines with reason, pages with text_chars, has_text_layer, needs_ocr). pages(doc_id, page) adds pages without any line."""
    keyed = line_rows.withColumns({"key": text.furniture_key(F.col("center"), F.col("x"), F.col("text")), "stamp": text.stamp_kind(F.col("text"))})
    found = furniture(line_rows).select("doc_id", "key", F.lit(True).alias("repeated"))
    marked = keyed.join(found, ["doc_id", "key"], "left")
    gone = F.col("stamp").isNotNull() | F.col("repeated").isNotNull()
    kept = marked.where(~gone).select(*line_rows.columns)
    reason = F.when(F.col("stamp").isNotNull(), F.concat(F.lit("stamp:"), "stamp")).otherwise("repeated-across-pages")
    removed = marked.where(gone).select(*PAGE, "line", "text", reason.alias("reason"))
    every = (pages if pages is not None else line_rows).select(*PAGE).distinct()
    chars = kept.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("n"))
    return kept, removed, flag_scanned(every.join(chars, PAGE, "left").select(*PAGE, F.coalesce("n", F.lit(0)).cast("long").alias("text_chars")), minimum)


def flag_scanned(pages: DataFrame, minimum: int = TEXT_LAYER_MIN) -> DataFrame:
    layer = F.col("text_chars") >= minimum
    return pages.withColumns({"has_text_layer": layer, "needs_ocr": ~layer})


def textless_regions(regions: DataFrame, line_rows: DataFrame) -> DataFrame:
    """regions(doc_id, page, region, x, y, w, h) of some size that fewer than REGION_CHARS characters lie over."""
    r, n = regions.where(f"w >= {REGION_SIDE} and h >= {REGION_SIDE}").alias("r"), line_rows.alias("l")
    over = F.expr("r.doc_id = l.doc_id and r.page = l.page and l.x1 > r.x and l.x < r.x + r.w and l.bottom > r.y and l.top < r.y + r.h")
    chars = r.join(n, over, "left").groupBy("r.doc_id", "r.page", "r.region").agg(F.coalesce(F.sum(F.length("l.text")), F.lit(0)).alias("chars"))
    return regions.join(chars.where(f"chars < {REGION_CHARS}"), [*PAGE, "region"])


def sections(line_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, section: the first heading in a page's first quarter (six lines at least), carried on until the next."""
    page = W.partitionBy(*PAGE)
    top = line_rows.withColumns({"i": F.row_number().over(page.orderBy("line")), "n": F.count(F.lit(1)).over(page)}).where(F.col("i") <= F.greatest(F.lit(6), F.ceil(F.col("n") * 0.25)))
    hits = top.withColumn("s", text.section_for(F.col("text"))).where("s is not null").groupBy(*PAGE).agg(F.min_by("s", "i").alias("hit"))
    doc = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return pages.select(*PAGE).join(hits, PAGE, "left").select(*PAGE, F.coalesce(F.last("hit", ignorenulls=True).over(doc), F.lit("other")).alias("section"))


def doc_meta(line_rows: DataFrame) -> DataFrame:
    """doc_id, company, period_label, currency, units_scale: each from the first line of the first four pages that tells it."""
    head = line_rows.withColumn("rank", F.dense_rank().over(W.partitionBy("doc_id").orderBy("page"))).where("rank <= 4")
    at = F.struct("page", "line")
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), at))
    units = text.detect_units(F.col("text"))
    return head.groupBy("doc_id").agg(
        first(F.when(text.is_company(F.col("text")), trim_ws(F.col("text")))).alias("company"), first(text.period_label(F.col("text"))).alias("period_label"),
        first(text.detect_currency(F.col("text"))).alias("currency"), first(F.when(units.isNotNull(), numbers.unit_scale(units))).alias("units_scale"),
    )


def note_headings(line_rows: DataFrame) -> DataFrame:
    return line_rows.withColumn("note", text.note_heading(F.col("text"))).where("note is not null").select(*PAGE, "center", "note.number", "note.title")


def annotate(tables: DataFrame, line_rows: DataFrame, context: DataFrame, page_sections: DataFrame) -> DataFrame:
    """tables(doc_id, page, band, top) with title, note_ref, units, section: the nearest note heading above names a table, else the last telling line of its context(doc_id, page, band, center, text)."""
    n = note_headings(line_rows).select("doc_id", "page", F.col("center").alias("nc"), "number", F.col("title").alias("note_title"))
    above = tables.select(*BAND, "top").join(n, PAGE).where("nc < top").groupBy(*BAND).agg(F.max_by("number", "nc").alias("number"), F.max_by("note_title", "nc").alias("note_title"))
    t = trim_ws(F.col("text"))
    telling = (t != "") & ~F.coalesce(text.detect_units(F.col("text")) == t, F.lit(False)) & ~t.rlike(text.NOTES) & ~t.rlike("(?i)^for the (year|period)|^as at\\b")
    lines_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("center", "text"))), lambda x: x["text"]), " \n ")
    said = context.groupBy(*BAND).agg(F.max_by(F.when(telling, t), F.when(telling, F.col("center"))).alias("caption"), text.detect_units(lines_text).alias("units"))
    out = tables.join(above, BAND, "left").join(said, BAND, "left").join(page_sections, PAGE, "left")
    section = F.when(F.col("number").isNotNull(), "notes").when(F.col("section") == "front", "other").otherwise(F.col("section"))
    return out.select(*tables.columns, F.coalesce("note_title", "caption").alias("title"), F.col("number").alias("note_ref"), "units", section.alias("section"))


def extract_tables(words: DataFrame, minimum: int = TEXT_LAYER_MIN, min_confidence: float = grids.MIN_CONFIDENCE) -> dict[str, DataFrame]:
    """The pipeline: words to pages, tables, their long cells (body rows, and headers), and what was rejected, with reasons.

    What several branches read (words with lines, lines kept, bands, cells told apart as figures, verdicts) is written to the shared folder once, so no branch is planned or run through what came before."""
    raw = materialize(assign_lines(normalise_words(words)))
    raw_lines = materialize(lines(raw))
    kept, removed, pages = strip_furniture(raw_lines, words.select(*PAGE), minimum)
    kept, pages = materialize(kept), materialize(pages)
    readable = pages.where("has_text_layer").select(*PAGE)
    body = raw.drop("line_center").join(kept.select(*PAGE, "line"), [*PAGE, "line"], "left_semi").join(readable, PAGE, "left_semi").drop("line")
    again = materialize(assign_lines(body))
    metrics = materialize(page_metrics(again))
    banded = materialize(bands(lines(again), metrics))
    cells = materialize(split_cells(again, metrics))
    found = materialize(grids.band_cells(cells, banded, metrics))
    good = materialize(grids.flagged(found.where("reason is null").drop("reason")))
    verdict = materialize(grids.classify(good, metrics.select(*PAGE, "median_height")))
    headers = grids.header_counts(good)
    passed = verdict.where(F.col("is_table") & (F.col("confidence") >= min_confidence)).join(headers, BAND, "left").na.fill(0, ["n_headers"])
    spans = good.select(*BAND, "line").distinct().join(banded, [*BAND, "line"]).groupBy(*BAND).agg(F.min("x").alias("left"), F.min("top").alias("top"), F.max("x1").alias("right"), F.max("bottom").alias("bottom"), F.min("line").alias("first_line"))
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("band")) - 1
    tables = materialize(passed.join(spans, BAND).withColumn("table_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.concat(F.lit("p"), "page"), F.concat(F.lit("t"), number))))
    context = banded.join(tables.select(*BAND, "first_line"), BAND).where("line < first_line").select(*BAND, "center", "text").dropDuplicates()
    by_page = materialize(sections(kept, pages))
    rows = good.join(tables.select(*BAND, "table_id", "n_headers"), BAND)
    at = F.col("row") - F.col("n_headers")
    low = verdict.where(~F.col("is_table") | (F.col("confidence") < min_confidence)).select(*BAND, "confidence", "reasons")
    rejected = found.where("reason is not null").select(*BAND, F.lit(0.0).alias("confidence"), F.array("reason").alias("reasons")).unionByName(low)
    return {
        "pages": pages.join(by_page, PAGE), "tables": annotate(tables, kept, context, by_page), "cells": rows.where("row >= n_headers").select("table_id", at.alias("row"), "col", "text"),
        "headers": rows.where("row < n_headers").select("table_id", "row", "col", "text"), "rejected": rejected, "removed": removed, "meta": doc_meta(kept),
    }


# Pages that were read optically. How far such readings are trusted.
LOW_CONFIDENCE, WARNED_AT_MOST, OPTICAL_AT_MOST = 60.0, 0.85, 0.9
VERIFY = "extracted by OCR — verify figures against the page image"


def refine_numeric(cells: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """cells(text, conf, ...) of a page read optically, with warning: texts never change; a doubtful reading is named."""
    fixed = numbers.coerce_numeric_reading(F.col("text"))
    p, q = numbers.parse_number(F.col("text")), numbers.parse_number(fixed)
    ambiguous = ~p["is_numeric"] & q["is_numeric"] & F.col("text").rlike(r"\d")
    return cells.withColumn("warning", F.when(ambiguous, F.concat(F.lit('"'), "text", F.lit('" may read '), fixed)).when(p["is_numeric"] & (F.col("conf") < low), F.concat(F.lit('low confidence figure "'), "text", F.lit('"'))))


def page_confidence(words: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """doc_id, page, mean_confidence, warning: pages whose words were read with less than low on average are named."""
    mean = words.groupBy(*PAGE).agg(F.avg("conf").alias("mean_confidence"))
    said = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": mean OCR confidence "), F.floor(F.col("mean_confidence") + 0.5).cast("string"), F.lit("% — treat figures as provisional"))
    return mean.withColumn("warning", F.when(F.col("mean_confidence") < low, said))


def extract_optical(words: DataFrame, pages: DataFrame | None = None, low: float = LOW_CONFIDENCE, origin: str = "pdf-ocr", minimum: int = 1) -> dict[str, DataFrame]:
    """extract_tables of words that were read optically, on pages(doc_id, page) only if given. Tables get the origin, warnings on doubtful figures and pages, and confidence of OPTICAL_AT_MOST, WARNED_AT_MOST where anything is doubtful."""
    read = words if pages is None else words.join(pages.select(*PAGE).distinct(), PAGE, "left_semi")
    confidence = materialize(page_confidence(read, low))
    found = extract_tables(read, minimum)
    per_cell = found["cells"].join(found["tables"].select("table_id", *PAGE), "table_id")
    # A cell's confidence is that of its least certain word on the page.
    by_word = read.select(*PAGE, trim_ws(F.col("text")).alias("word"), "conf").groupBy(*PAGE, "word").agg(F.min("conf").alias("conf"))
    parts = per_cell.select("table_id", *PAGE, "row", "col", "text", F.explode(F.split("text", r"\s+")).alias("word")).join(by_word, [*PAGE, "word"], "left").groupBy("table_id", "row", "col", "text").agg(F.min("conf").alias("conf"))
    doubts = refine_numeric(parts, low).where("warning is not null").groupBy("table_id").agg(F.array_sort(F.collect_set("warning")).alias("_doubts"))
    none = F.array().cast("array<string>")
    tables = found["tables"].join(doubts, "table_id", "left")
    warnings = F.concat("warnings", F.coalesce("_doubts", none))
    capped = F.least(F.when(F.size(warnings) > 0, F.least("confidence", F.lit(WARNED_AT_MOST))).otherwise(F.col("confidence")), F.lit(OPTICAL_AT_MOST))
    tables = tables.withColumns({"confidence": capped, "warnings": F.concat(warnings, F.array(F.lit(VERIFY))), "origin": F.lit(origin)}).drop("_doubts")
    told = found["pages"].join(confidence, PAGE, "left").withColumn("ocr_applied", F.lit(True))
    return found | {"tables": tables, "pages": told}


def merge_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages of the text layer, each that needs it replaced by what optical reading gave for it."""
    wanted = pages.where("needs_ocr").select(*PAGE)
    new = ocr.join(wanted, PAGE, "left_semi")
    return pages.join(new.select(*PAGE), PAGE, "left_anti").unionByName(new, allowMissingColumns=True)
