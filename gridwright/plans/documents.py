"""Queries on pages of text: furniture, scans, sections, notes; and tables from positioned words."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import text
from gridwright.operators.extract import grids, lines, pages
from gridwright.sources import workbooks

from .cells import CENTS
from .registry import query, re2, table


def doc_lines(spark, d):
    """Every document's source is a report and the document a page of it; line i of a text stands 20 points below the last, under a running header and above a page number."""
    docs = table(spark, d, "documents")
    body = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    page = F.col("doc_id").cast("int")
    own = body.select(F.col("source").alias("doc_id"), page.alias("page"), (F.col("i") + 1).alias("line"), (F.col("i") * 20.0 + 100).alias("center"), F.lit(50.0).alias("x"), F.trim("text").alias("text"))
    head = docs.select(F.col("source").alias("doc_id"), page.alias("page"), F.lit(0).alias("line"), F.lit(40.0).alias("center"), F.lit(50.0).alias("x"), F.concat(F.lit("Annual report "), F.col("source")).alias("text"))
    foot = docs.select(F.col("source").alias("doc_id"), page.alias("page"), F.lit(99999).alias("line"), F.lit(9e6).alias("center"), F.lit(300.0).alias("x"), F.concat(F.lit("Page "), (F.col("doc_id") % 1000).cast("string")).alias("text"))
    rows = own.unionByName(head).unionByName(foot)
    return rows.select("doc_id", "page", "line", "center", (F.col("center") - 5).alias("top"), (F.col("center") + 5).alias("bottom"), "x", (F.col("x") + F.length("text") * 5.0).alias("x1"), "text")


# The lines of doc_lines and what the page operators find in them, as SQL. RE2 knows no u flag, and its \s lacks the vertical tab.
_WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trimmed(value: str) -> str:
    return f"regexp_replace({value}, '^{_WS}+|{_WS}+$', '', 'g')"


def _first(value: str, patterns) -> str:
    """The name of the first pattern that matches."""
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, {re2(p)}) THEN '{name}'" for p, name in patterns) + " END"


_LINES = f"""
WITH split AS (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents),
body AS (SELECT source, doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS i FROM split),
l AS (SELECT source, doc_id, i + 1 AS line, i * 20.0 + 100 AS center, 50.0 AS x, trim(raw, ' ') AS text FROM body WHERE trim(raw, ' ') <> ''
  UNION ALL SELECT source, doc_id, 0, 40.0, 50.0, 'Annual report ' || source FROM documents UNION ALL SELECT source, doc_id, 99999, 9e6, 300.0, 'Page ' || doc_id % 1000 FROM documents),
keyed AS (SELECT *, concat_ws('|', CAST(floor(center / 14 + 0.5) AS BIGINT), CAST(floor(x / 14 + 0.5) AS BIGINT), {_trimmed(f"regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '{_WS}+', ' ', 'g')")}) AS key, {_first(_trimmed("text"), text.STAMPS)} AS stamp FROM l),
total AS (SELECT source, count(DISTINCT doc_id) AS total FROM l GROUP BY source),
f AS (SELECT source, key, pages FROM (SELECT source, key, count(DISTINCT doc_id) AS pages FROM keyed WHERE length(text) <= {pages.FURNITURE_CHARS} GROUP BY source, key) JOIN total USING (source) WHERE pages >= greatest(2, ceil(total * {pages.FURNITURE_SHARE}))),
marked AS (SELECT k.*, f.key IS NOT NULL AS repeated FROM keyed k LEFT JOIN f ON k.source = f.source AND k.key = f.key)
"""


@query("furniture", _LINES + "SELECT source AS doc_id, key, pages FROM f")
def furniture(spark, d):
    return pages.furniture(doc_lines(spark, d)).select("doc_id", "key", "pages")


@query(
    "scanned_pages",
    _LINES
    + f""", k AS (SELECT doc_id, sum(length(text)) AS n FROM marked WHERE stamp IS NULL AND NOT repeated GROUP BY doc_id)
SELECT d.source AS doc_id, CAST(d.doc_id AS INTEGER) AS page, CAST(coalesce(n, 0) AS BIGINT) AS text_chars, coalesce(n, 0) >= {pages.TEXT_LAYER_MIN} AS has_text_layer, coalesce(n, 0) < {pages.TEXT_LAYER_MIN} AS needs_ocr FROM documents d LEFT JOIN k USING (doc_id)""",
)
def scanned_pages(spark, d):
    return pages.strip_furniture(doc_lines(spark, d))[2]


@query("removed_lines", _LINES + "SELECT source AS doc_id, CAST(doc_id AS INTEGER) AS page, CAST(line AS INTEGER) AS line, text, CASE WHEN stamp IS NOT NULL THEN 'stamp:' || stamp ELSE 'repeated-across-pages' END AS reason FROM marked WHERE stamp IS NOT NULL OR repeated")
def removed_lines(spark, d):
    return pages.strip_furniture(doc_lines(spark, d))[1].select("doc_id", "page", "line", "text", "reason")


def _told_lines(spark, d, told):
    """Every line of every document, and after its last one a line of told that is drawn by doc_id: doc_id, line, text."""
    docs = table(spark, d, "documents")
    line = F.element_at(F.array(*[F.lit(t) for t in told]), (F.col("doc_id") % len(told) + 1).cast("int"))
    own = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return own.unionByName(docs.select("doc_id", F.lit(-1).alias("line"), line.alias("text")))


def _told_sql(told) -> str:
    return f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS text FROM split UNION ALL SELECT doc_id, -1, [{", ".join("'" + t.replace("'", "''") + "'" for t in told)}][doc_id % {len(told)} + 1] FROM documents)
"""


_STAMPS = ("name.x+y@mail.example.com", "Downloaded by someone", "https://example.com/a?b=c", "Page 3 of 44", "2011", "© 2011 Group", "Inventories")


@query("stamp_kind", _told_sql(_STAMPS) + f"SELECT doc_id, CAST(line AS INTEGER) AS line, {_first(_trimmed('text'), text.STAMPS)} AS kind FROM l")
def stamp_kind(spark, d):
    return _told_lines(spark, d, _STAMPS).select("doc_id", "line", text.stamp_kind(F.col("text")).alias("kind"))


_HEADS = ("Notes to the financial statements", "Statement of Financial Position", "Chairman's Review", None, None)


@query(
    "sections",
    f"""
WITH split AS (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents),
body AS (SELECT source, doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS i FROM split),
l AS (SELECT source, doc_id, i + 1 AS line, trim(raw, ' ') AS text FROM body WHERE trim(raw, ' ') <> '' UNION ALL SELECT source, doc_id, 99999, 'Page ' || doc_id % 1000 FROM documents
  UNION ALL SELECT source, doc_id, 0, coalesce([{", ".join("'" + h.replace("'", "''") + "'" if h else "NULL" for h in _HEADS)}][doc_id % 5 + 1], 'Plain line') FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
h AS (SELECT doc_id, arg_min(s, i) AS hit FROM (SELECT doc_id, i, {_first("text", [(text.NOTES, "notes"), *[(p, "statements") for p in text.STATEMENTS], *[(p, "front") for p in text.FRONT]])} AS s FROM n WHERE i <= greatest(6, ceil(n * 0.25))) WHERE s IS NOT NULL GROUP BY doc_id)
SELECT source AS doc_id, CAST(d.doc_id AS INTEGER) AS page, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY source ORDER BY d.doc_id), 'other') AS section FROM documents d LEFT JOIN h USING (doc_id)""",
)
def sections(spark, d):
    head = F.element_at(F.array(*[F.lit(t) for t in _HEADS]), (F.col("page") % 5 + 1).cast("int"))
    rows = doc_lines(spark, d).withColumn("text", F.when(F.col("line") == 0, F.coalesce(head, F.lit("Plain line"))).otherwise(F.col("text")))
    return pages.sections(rows, rows.select("doc_id", "page").distinct())


_NOTES = ("15.  Inventories", "NOTE 16 - RECEIVABLES", "Note 7: Cash and", "15 1,234", "31 December 2011", "Inventories 15", "120. Too large")


def _heading_sql() -> str:
    """Number and title by the first form that gives a good one; a title that is a figure is no title."""
    t = f"regexp_replace({_trimmed('text')}, '{_WS}+', ' ', 'g')"
    part = lambda p, i: f"regexp_extract(t, {re2(p)}, {i})"
    title = lambda p: f"regexp_replace({_trimmed(part(p, 2))}, '[.:;,]+$', '')"
    good = lambda p: rf"""regexp_matches(t, {re2(p)}) AND length({title(p)}) >= 2 AND NOT regexp_matches({title(p)}, '^[0-9(][0-9,. ()%-]*$') AND NOT regexp_matches({title(p)}, '(?i)\b(the|of|and|to|a|in|for|is|are|was|were)$') AND len(string_split({title(p)}, ' ')) <= 12 AND TRY_CAST({part(p, 1)} AS DOUBLE) <= 99"""
    case = lambda of: "CASE WHEN t = '' OR length(t) > 110 THEN NULL " + " ".join(f"WHEN {good(p)} THEN {of(p)}" for p in text.NOTE_HEADINGS) + " END"
    return f", s AS (SELECT doc_id, line, {t} AS t FROM l) SELECT doc_id, CAST(line AS INTEGER) AS line, {case(lambda p: part(p, 1))} AS number, {case(title)} AS title FROM s"


@query("note_heading", _told_sql(_NOTES) + _heading_sql())
def note_heading(spark, d):
    return _told_lines(spark, d, _NOTES).select("doc_id", "line", text.note_heading(F.col("text")).alias("n")).select("doc_id", "line", "n.number", "n.title")


_UNITS = ("GH¢ thousands", "in thousands of Ghana cedis", "US$ '000", "All in £ millions", "Inventories", "€ 5 and NGN 3")


@query(
    "units_and_currency",
    _told_sql(_UNITS)
    + f""", c AS (SELECT *, upper(regexp_extract(text, {re2(text.CURRENCY)}, 0)) AS t FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, CASE {" ".join(f"WHEN regexp_matches(text, {re2(p)}) THEN " + _trimmed(f"regexp_replace(regexp_extract(text, {re2(p)}, 0), '{_WS}+', ' ', 'g')") for p in text.UNITS)} END AS units,
  CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, 'GH|₵') THEN 'GHS' WHEN regexp_matches(t, 'US|\\$') THEN 'USD' WHEN t = '£' THEN 'GBP' WHEN t = '€' THEN 'EUR' WHEN t = 'NGN' THEN 'NGN' END AS currency FROM c""",
)
def units_and_currency(spark, d):
    line = F.col("text")
    return _told_lines(spark, d, _UNITS).select("doc_id", "line", text.detect_units(line).alias("units"), text.detect_currency(line).alias("currency"))


@query("doc_meta", "SELECT source AS doc_id, 'Example Oil Company Limited' AS company, '31 December 2011' AS period_label, 'GHS' AS currency, 1000::DOUBLE AS units_scale FROM documents GROUP BY source")
def doc_meta(spark, d):
    """Every line of every page, under a title page that says what a report says."""
    own = doc_lines(spark, d)
    said = F.posexplode(F.array(*[F.lit(t) for t in ("Example Oil Company Limited", "for the year ended 31 December 2011", "GH¢ thousands")])).alias("line", "text")
    title = own.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("page"), said)
    return pages.doc_meta(own.select("doc_id", "page", "line", "text").unionByName(title))


# Tables laid out as words: customer's orders, label left, two right-aligned columns of figures.


def statement_words(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderkey", f"format_number({CENTS}, 0) as a", f"format_number({CENTS} + 1234, 0) as b")
    o = o.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("o_orderkey")))
    size, step = 10.0, 14.0
    word = lambda t, x, x1: F.struct(t.alias("text"), x.alias("x"), x1.alias("x1"))
    left = lambda t, x: word(F.lit(t), F.lit(float(x)), F.lit(float(x + 5 * len(t))))
    right = lambda c, edge: word(F.col(c), F.lit(float(edge)) - 5 * F.length(c), F.lit(float(edge)))
    number = F.col("o_orderkey").cast("string")
    body = o.select("k", "r", F.posexplode(F.array(left("Order", 50), left("number", 78), word(number, F.lit(111.0), 111.0 + 5 * F.length(number)), right("a", 400), right("b", 500))).alias("i", "w"))
    head = o.select("k").distinct().select("k", F.lit(0).alias("r"), F.posexplode(F.array(left("2011", 380), left("2010", 480))).alias("i", "w"))
    every = body.unionByName(head)
    y = F.col("r") * step + 100
    return every.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("doc_id"), F.lit(1).alias("page"), (F.col("r") * 10 + F.col("i")).cast("long").alias("word_idx"), "w.text", "w.x", y.alias("y"), "w.x1", (y + size).alias("y1"), (F.col("w.x1") - F.col("w.x")).alias("w"), F.lit(size).alias("h"), F.lit(None).cast("double").alias("conf"))


_ORDERS = """
WITH o AS (SELECT 'c' || o_custkey AS doc_id, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
"""


@query("line_texts", _ORDERS + "SELECT doc_id, CAST(r AS INTEGER) AS line, 'Order number ' || o_orderkey || ' ' || format('{:,}', c) || ' ' || format('{:,}', c + 1234) AS text FROM o UNION ALL SELECT DISTINCT doc_id, 0, '2011 2010' FROM o")
def line_texts(spark, d):
    return lines.lines(lines.assign_lines(lines.normalise_words(statement_words(spark, d)))).select("doc_id", "line", "text")


@query("line_cells", _ORDERS + "SELECT doc_id, CAST(r AS INTEGER) AS line, i AS cell, CASE i WHEN 0 THEN 'Order number ' || o_orderkey WHEN 1 THEN format('{:,}', c) ELSE format('{:,}', c + 1234) END AS text, i > 0 AS is_figure FROM o, (SELECT unnest([0, 1, 2]) AS i) UNION ALL SELECT DISTINCT doc_id, 0, i, CASE i WHEN 0 THEN '2011' ELSE '2010' END, true FROM o, (SELECT unnest([0, 1]) AS i)")
def line_cells(spark, d):
    w = lines.assign_lines(lines.normalise_words(statement_words(spark, d)))
    return lines.split_cells(w, lines.page_metrics(w)).select("doc_id", "line", "cell", "text", "is_figure")


@query("page_metrics", _ORDERS + "SELECT doc_id, 1 AS page, 10::DOUBLE AS median_height, CAST(n + 1 AS BIGINT) AS line_count, CAST(n * 5 + 2 AS BIGINT) AS word_count, 14::DOUBLE AS median_line_spacing FROM o GROUP BY doc_id, n")
def page_metrics(spark, d):
    w = lines.assign_lines(lines.normalise_words(statement_words(spark, d)))
    return lines.page_metrics(w).select("doc_id", "page", "median_height", "line_count", "word_count", "median_line_spacing")


# A page with so little text passes for a scan and is not read: a heading of nine characters and the orders' lines.
_READABLE = f", r AS (SELECT doc_id FROM o GROUP BY doc_id HAVING 9 + sum(length('Order number ' || o_orderkey || ' ' || format('{{:,}}', c) || ' ' || format('{{:,}}', c + 1234))) >= {pages.TEXT_LAYER_MIN})"


@query(
    "extracted_cells",
    _ORDERS.rstrip() + _READABLE + " SELECT doc_id, CAST(r - 1 AS INTEGER) AS row, i AS col, CASE i WHEN 0 THEN 'Order number ' || o_orderkey WHEN 1 THEN format('{:,}', c) ELSE format('{:,}', c + 1234) END AS text FROM o JOIN r USING (doc_id), (SELECT unnest([0, 1, 2]) AS i)",
)
def extracted_cells(spark, d):
    found = pages.extract_tables(statement_words(spark, d))
    return found["cells"].select(F.element_at(F.split("table_id", "-"), 1).alias("doc_id"), "row", "col", "text")


@query(
    "extracted_tables",
    _ORDERS.rstrip()
    + _READABLE
    + """ SELECT doc_id, 3 AS column_count, CAST(any_value(n) + 1 AS BIGINT) AS row_count, 1 AS n_headers, true AS confident, NULL::VARCHAR AS title, NULL::VARCHAR AS note_ref, NULL::VARCHAR AS units, 'other' AS section, 50.0::DOUBLE AS "left", 100.0::DOUBLE AS top, 500.0::DOUBLE AS "right", 100 + 14.0::DOUBLE * any_value(n) + 10 AS bottom FROM o JOIN r USING (doc_id) GROUP BY doc_id""",
)
def extracted_tables(spark, d):
    found = pages.extract_tables(statement_words(spark, d))
    return found["tables"].select("doc_id", "column_count", "row_count", "n_headers", (F.col("confidence") > 0.8).alias("confident"), "title", "note_ref", "units", "section", "left", "top", "right", "bottom")


def _reports(spark, d):
    """Each customer's statement under a note's heading and a line of units, above it a paragraph that is no table, on pages with a running header and a stamp."""
    w = statement_words(spark, d)
    docs = w.select("doc_id").distinct()
    k = F.expr("cast(substring(doc_id, 2) as bigint)")
    said = lambda y, t: F.struct(F.lit(float(y)).alias("y"), t.alias("t"))
    prose = "The directors have looked at these orders with all due care and found them to be in order throughout the whole of the year under review"
    above = F.array(said(20, F.concat(F.lit("Group report "), "doc_id")), said(66, F.concat(F.lit("Note "), (k % 40 + 1).cast("string"), F.lit(": Orders of customers"))), said(82, F.lit("GH¢ thousands")), said(-60, F.lit(prose)), said(-46, F.lit(prose)), said(-32, F.lit(prose)), said(-90, F.lit("Downloaded by a reader")))
    lines_ = docs.select("doc_id", F.explode(above).alias("s")).select("doc_id", F.col("s.y").alias("y"), F.posexplode(F.split("s.t", " ")).alias("i", "text"), F.col("s.t").alias("t"))
    at = F.expr("length(substring_index(t, ' ', i))") + F.when(F.col("i") > 0, 1).otherwise(0)
    x = 50.0 + 3.0 * at
    own = lines_.select("doc_id", F.lit(1).alias("page"), (F.col("y").cast("long") * 1000 + F.col("i")).alias("word_idx"), "text", x.alias("x"), "y", (x + 3.0 * F.length("text")).alias("x1"), (F.col("y") + 10).alias("y1"), (3.0 * F.length("text")).alias("w"), F.lit(10.0).alias("h"), F.lit(None).cast("double").alias("conf"))
    return w.unionByName(own)


@query("report_tables", _ORDERS + "SELECT doc_id, 3 AS column_count, CAST(any_value(n) + 1 AS BIGINT) AS row_count, 'Orders of customers' AS title, CAST(CAST(substr(doc_id, 2) AS BIGINT) % 40 + 1 AS VARCHAR) AS note_ref, 'GH¢ thousands' AS units, 'notes' AS section FROM o GROUP BY doc_id, n")
def report_tables(spark, d):
    """Tables named by the note heading above them, with its units."""
    return pages.extract_tables(_reports(spark, d))["tables"].select("doc_id", "column_count", "row_count", "title", "note_ref", "units", "section")


@query("report_rejected", _ORDERS + "SELECT DISTINCT doc_id, 'no vertical gutter separates two columns' AS reason FROM o")
def report_rejected(spark, d):
    """Bands of prose, with why they are no tables."""
    return pages.extract_tables(_reports(spark, d))["rejected"].where(F.array_contains("reasons", grids.NO_GUTTER)).select("doc_id", F.element_at("reasons", 1).alias("reason")).distinct()


@query("page_verdicts", _ORDERS + "SELECT DISTINCT doc_id, 1 AS page, 'tabular' AS verdict FROM o")
def page_verdicts(spark, d):
    w = lines.assign_lines(lines.normalise_words(statement_words(spark, d)))
    return grids.classify_page(lines.lines(w), lines.split_cells(w, lines.page_metrics(w)))


@query("words_from_items", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) AS BIGINT) AS n, 0::BIGINT AS outside, CAST(greatest(length(text), 1) * 2 AS BIGINT) AS chars FROM documents WHERE regexp_matches(text, '[^\x09-\x0D\x20]')")
def words_from_items(spark, d):
    """Each document as one item of a text layer, two points a character wide: its words lie inside it, in order, and each is as wide as its share."""
    docs = table(spark, d, "documents")
    width = F.greatest(F.length("text"), F.lit(1)) * 2.0
    items = docs.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("item_idx"), F.col("text").alias("str"), F.lit(50.0).alias("x"), F.lit(700.0).alias("baseline"), width.alias("width"), F.lit(10.0).alias("height"), F.lit(842.0).alias("page_height"))
    w = lines.words_from_items(items).join(items.select("doc_id", "width"), "doc_id")
    out = (F.col("x") < 49.999) | (F.col("x1") > F.col("width") + 50.001) | (F.abs(F.col("w") - 2 * F.length("text")) > 0.001)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("outside"), F.max(F.col("width").cast("long")).alias("chars"))


# Sheets: a workbook for each nation; of its customers two statements side by side and one below, and two sheets of metadata.


def sheet(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_name").alias("name"), (F.col("c_custkey") + 1500).cast("string").alias("v"), (F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("k"), F.count(F.lit(1)).over(W.partitionBy("c_nationkey")).alias("m"))
    k, m = F.col("k"), F.col("m").cast("int")
    cell = lambda r, col, t: F.struct(r.alias("r"), F.lit(col).alias("c"), t.alias("text"))
    name, v = F.col("name"), F.col("v")
    # Columns 0-1: all customers from row 4; columns 3-4: the same from row 2; ten rows below the first, columns 0-1: the first five again.
    body = c.select("n", F.explode(F.array(cell(k + 4, 0, name), cell(k + 4, 1, v), cell(k + 2, 3, name), cell(k + 2, 4, v))).alias("x"))
    low = c.where("k < 5").select("n", F.explode(F.array(cell(k + m + 14, 0, name), cell(k + m + 14, 1, v))).alias("x"))
    head = c.select("n").distinct().select("n", F.explode(F.array(*[cell(F.lit(r), col, F.lit(t)) for r, col, t in ((3, 0, "Customer"), (3, 1, "2011"), (1, 3, "Customer"), (1, 4, "2010"))])).alias("x"))
    data = body.unionByName(low).unionByName(head).select("n", F.lit("Positions").alias("sheet"), F.lit(1).alias("sheet_no"), "x.*")
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(i).alias("sheet_no"), F.lit(0).alias("r"), F.lit(col).alias("c"), F.lit(t).alias("text")) for s, i in (("_TM_1", 2), ("Boxes", 3)) for col, t in enumerate(("Left", "Top", "Right", "Bottom", "Ref"))]))
    meta = c.select("n").distinct().select("n", named.alias("x")).select("n", "x.*")
    return data.unionByName(meta).select(F.concat(F.lit("book"), F.col("n").cast("string"), F.lit(".xlsx")).alias("file"), "sheet", "sheet_no", "r", "c", "text")


_BOOKS = "WITH b AS (SELECT 'book' || c_nationkey || '.xlsx' AS file, CAST(count(*) AS INTEGER) AS m, c_nationkey AS k FROM customer GROUP BY c_nationkey) "


@query("used_range", _BOOKS + "SELECT file, 'Positions' AS sheet, 1 AS r0, m + 13 + least(m, 5) AS r1, 0 AS c0, 4 AS c1 FROM b UNION ALL SELECT file, s, 0, 0, 0, 4 FROM b, (SELECT unnest(['_TM_1', 'Boxes']) AS s)")
def used_range(spark, d):
    return workbooks.used_range(sheet(spark, d)).select("file", "sheet", "r0", "r1", "c0", "c1")


_ISLANDS = _BOOKS + ", i AS (SELECT file, 0 AS island, 1 AS r0, m + 1 AS r1, 3 AS c0, 4 AS c1, m FROM b UNION ALL SELECT file, 1, 3, m + 3, 0, 1, m FROM b UNION ALL SELECT file, 2, m + 14, m + 13 + least(m, 5), 0, 1, m FROM b WHERE m >= 2) "


@query("sheet_islands", _ISLANDS + "SELECT file, 'Positions' AS sheet, island, r0, r1, c0, c1 FROM i")
def sheet_islands(spark, d):
    return workbooks.islands(workbooks.data_sheets(sheet(spark, d))).select("file", "sheet", "island", "r0", "r1", "c0", "c1").distinct()


@query("sheet_tables", _ISLANDS + "SELECT file, island, CASE WHEN island < 2 THEN 1 ELSE 0 END AS n_headers, CAST(r1 - r0 + 1 AS BIGINT) AS row_count, true AS floor_kept FROM i")
def sheet_tables(spark, d):
    return workbooks.sheet_tables(sheet(spark, d))["tables"].select("file", "island", "n_headers", "row_count", (F.col("confidence") >= 0.75).alias("floor_kept"))


@query("skipped_sheets", _BOOKS + "SELECT file, s AS sheet, 'skipped: a sheet of metadata' AS warning FROM b, (SELECT unnest(['_TM_1', 'Boxes']) AS s)")
def skipped_sheets(spark, d):
    return workbooks.skipped_sheets(sheet(spark, d))


@query(
    "sheet_cells",
    """
WITH n AS (SELECT 'book' || c_nationkey || '.xlsx' AS file, c_name, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS row, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer),
t AS (SELECT *, unnest(CASE WHEN row < 5 AND m >= 2 THEN [0, 1, 2] ELSE [0, 1] END) AS island FROM n)
SELECT file || '-s1-t' || island AS table_id, row, 0 AS col, c_name AS text FROM t UNION ALL SELECT file || '-s1-t' || island, row, 1, (c_custkey + 1500)::VARCHAR FROM t""",
)
def sheet_cells(spark, d):
    return workbooks.sheet_tables(sheet(spark, d))["cells"]


@query("fill_merges", "SELECT c_custkey AS r, c, c_name AS text FROM customer, (SELECT unnest([0, 1, 2]) AS c)")
def fill_merges(spark, d):
    n = table(spark, d, "customer").select(F.lit("b").alias("file"), F.lit("s").alias("sheet"), F.lit(1).alias("sheet_no"), F.col("c_custkey").cast("int").alias("r"), F.lit(0).alias("c"), F.col("c_name").alias("text"))
    merges = n.select("file", "sheet", "sheet_no", F.col("r").alias("r0"), F.lit(0).alias("c0"), F.col("r").alias("r1"), F.lit(2).alias("c1"))
    return workbooks.fill_merges(n, merges).select(F.col("r").cast("long").alias("r"), "c", "text")
