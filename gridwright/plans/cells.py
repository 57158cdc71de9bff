"""Queries on single cells: figures, keys, labels. Texts are made from whole numbers by one formula, so both sides know what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.functions import numbers, text

from .registry import query, table

CENTS = "cast(round(o_totalprice * 100) as bigint)"


def orders_text(spark, d):
    """orders with an amount printed in one of eight ways."""
    o = table(spark, d, "orders").selectExpr("o_orderkey as k", f"{CENTS} as cents", f"format_number({CENTS}, 0) as grouped", "o_orderkey % 8 as way")
    way = lambda n, v: (F.col("way") == n, v)
    raw = F.lit(None).cast("string")
    shapes = [
        way(0, F.col("grouped")), way(1, F.concat(F.lit("("), "grouped", F.lit(")"))), way(2, F.concat("grouped", F.lit("-"))), way(3, F.concat(F.lit("GHS "), "grouped")),
        way(4, F.concat("grouped", F.lit("²"))), way(5, F.concat(F.col("cents").cast("string"), F.lit("%"))), way(6, F.lit("–")), way(7, F.concat(F.replace("grouped", F.lit(","), F.lit(".")), F.lit(",50"))),
    ]
    for cond, v in shapes:
        raw = F.when(cond, v).otherwise(raw)
    return o.select("k", "cents", "way", raw.alias("raw"))


@query(
    "parse_number",
    """
WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % 8 AS w FROM orders)
SELECT k, CASE WHEN w IN (0, 3, 4) THEN CAST(c AS DOUBLE) WHEN w IN (1, 2) THEN -CAST(c AS DOUBLE) WHEN w = 5 THEN c / 100.0::DOUBLE WHEN w = 7 THEN c + 0.5::DOUBLE END AS value,
  w <> 6 AS is_numeric, w IN (1, 2) AS is_negative, w = 5 AS is_percent, w = 1 AS had_parens, w = 6 AS is_nil, CASE WHEN w = 3 THEN 'GHS' END AS currency, CASE WHEN w = 4 THEN '²' END AS footnote
FROM o""",
)
def parse_number(spark, d):
    o = orders_text(spark, d).withColumn("p", numbers.parse_number(F.col("raw")))
    return o.select("k", *[f"p.{c}" for c in ("value", "is_numeric", "is_negative", "is_percent", "had_parens", "is_nil", "currency", "footnote")])


@query(
    "clean_value",
    """
WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % 8 AS w FROM orders)
SELECT k, CASE WHEN w IN (1, 2) THEN '-' || c WHEN w = 5 THEN CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) ELSE rtrim(c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '0') END
  WHEN w = 6 THEN '' WHEN w = 7 THEN c || '.5' ELSE CAST(c AS VARCHAR) END AS clean FROM o""",
)
def clean_value(spark, d):
    return orders_text(spark, d).select("k", numbers.clean_value(F.col("raw")).alias("clean"))


@query(
    "apply_scale",
    "SELECT o_orderkey AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS VARCHAR) AS thousands, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || '.00' AS fixed FROM orders",
)
def apply_scale(spark, d):
    v = F.expr(CENTS).cast("double")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), numbers.apply_scale(v, 1000).alias("thousands"), numbers.apply_scale(v, 1, 2).alias("fixed"))


@query(
    "period_label",
    """
SELECT o_orderkey AS k, o_orderkey % 6 IN (0, 1, 2, 3) AS is_period FROM orders""",
)
def period_label(spark, d):
    y = F.year("o_orderdate").cast("string")
    w = F.col("o_orderkey") % 6
    label = F.when(w == 0, y).when(w == 1, F.concat(F.lit("FY "), y)).when(w == 2, F.concat(y, F.lit("/12"))).when(w == 3, F.concat(y, F.lit(" restated"))).when(w == 4, F.concat(F.lit("1"), y)).otherwise(F.concat(F.lit("Note "), y))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), numbers.is_period_label(label).alias("is_period"))


@query(
    "unit_scale",
    """
SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 1e3::DOUBLE WHEN 1 THEN 1e6::DOUBLE WHEN 2 THEN 1e9::DOUBLE WHEN 3 THEN 1e3::DOUBLE ELSE 1::DOUBLE END AS scale FROM part""",
)
def unit_scale(spark, d):
    w = F.col("p_partkey") % 5
    unit = F.when(w == 0, "GH¢'000").when(w == 1, "US$ millions").when(w == 2, "in billions").when(w == 3, "thousands of cedis").otherwise("GHS")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), numbers.unit_scale(unit).alias("scale"))


@query(
    "format_bytes",
    """
WITH b AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders), u AS (SELECT k, n, CASE WHEN n < 1048576 THEN 1024 ELSE 1048576 END AS u FROM b),
t AS (SELECT k, n, u, (n * 20 + u) // (u * 2) AS tenths FROM u)
SELECT k, CASE WHEN n < 1024 THEN n || ' B' ELSE CASE WHEN n < u * 10 THEN tenths // 10 || '.' || tenths % 10 ELSE CAST((n * 2 + u) // (u * 2) AS VARCHAR) END || CASE WHEN u = 1024 THEN ' KB' ELSE ' MB' END END AS size FROM t""",
)
def format_bytes(spark, d):
    """The SQL rounds halves up in whole numbers."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), numbers.format_bytes(F.expr(CENTS)).alias("size"))


@query("coerce_numeric_reading", "SELECT o_orderkey AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS fixed FROM orders")
def coerce_numeric_reading(spark, d):
    misread = F.translate(F.expr(CENTS).cast("string"), "0158", "OlSB")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), numbers.coerce_numeric_reading(misread).alias("fixed"))


@query(
    "cell_keys",
    """
SELECT p_partkey AS k, trim(regexp_replace(lower(p_name || ' — ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key, p_name || ' ' || p_brand AS clean,
  lower(trim(regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS snake FROM part""",
)
def cell_keys(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    messy = F.concat(F.lit("  "), n, F.lit("  \t"), b, F.lit("​ "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.normalise_key(F.concat(n, F.lit(" — "), b)).alias("key"), text.clean_cell(messy).alias("clean"), text.to_snake(F.concat(F.lower(n), F.lit(" '"), F.lower(b))).alias("snake"))


@query(
    "header_similarity",
    """
WITH k AS (SELECT p_partkey AS k, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS b FROM part),
t AS (SELECT *, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM k)
SELECT k, CASE WHEN a = '' OR b = '' THEN 0::DOUBLE WHEN a = b THEN 1::DOUBLE ELSE least(1::DOUBLE, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb)))::DOUBLE
  + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.5 ELSE 0 END) END AS score FROM t""",
)
def header_similarity(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.similarity(F.col("p_name"), F.col("p_type")).alias("score"))


_LABELS = (
    ("Total assets", True, True, True), ("Sub-total", True, True, True), ("Net position", True, True, True), ("Net profit", False, True, True), ("Gross profit", False, False, True),
    ("Lump sum payments", True, False, False), ("Grand total", True, True, False), ("Inventories", False, False, False), ("Closing balance", False, False, True),
)


@query(
    "total_labels",
    "SELECT o_orderkey AS k, " + ", ".join(f"o_orderkey % {len(_LABELS)} IN ({', '.join(str(i) for i, x in enumerate(_LABELS) if x[j])}) AS {n}" for j, n in ((1, "in_table"), (2, "label"), (3, "live"))) + " FROM orders",
)
def total_labels(spark, d):
    label = F.element_at(F.array(*[F.lit(x[0]) for x in _LABELS]), (F.col("o_orderkey") % len(_LABELS) + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.is_total(label, text.TOTAL_IN_TABLE).alias("in_table"), text.is_total(label, text.TOTAL_LABEL).alias("label"), text.is_total(label, text.TOTAL_LIVE).alias("live"))


@query("looks_like_date", "SELECT o_orderkey AS k, o_orderkey % 7 < 5 AS is_date FROM orders")
def looks_like_date(spark, d):
    day, w = F.col("o_orderdate"), F.col("o_orderkey") % 7
    forms = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "MMMM d, yyyy")
    shown = F.when(w == 5, F.concat(F.lit("31/13/"), F.year(day))).otherwise(F.concat(F.lit("day "), F.year(day)))
    for i, form in enumerate(forms):
        shown = F.when(w == i, F.date_format(day, form)).otherwise(shown)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.looks_like_date(shown).alias("is_date"))


@query(
    "file_names",
    """
SELECT p_partkey AS k, regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9_-]+', '_', 'g') AS base,
  CASE p_partkey % 4 WHEN 0 THEN 'machine csv (tidy/long)' WHEN 1 THEN 'csv' WHEN 2 THEN 'excel workbook' ELSE 'file' END AS kind,
  CAST(octet_length(encode(p_name || '¢')) AS BIGINT) AS bytes FROM part""",
)
def file_names(spark, d):
    w = F.col("p_partkey") % 4
    name = F.concat("p_name", F.lit(" "), "p_brand", F.when(w == 0, "_data.csv").when(w == 1, ".csv").when(w == 2, ".xlsx").otherwise(".bin"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace(text.filename_base(name), "_data$", "").alias("base"), text.kind_from_name(name).alias("kind"), text.content_size(F.concat("p_name", F.lit("¢"))).alias("bytes"))


@query("escape_html", "SELECT o_orderkey AS k, '&lt;b&gt;' || o_orderpriority || ' &amp; &quot;' || o_orderstatus || '&quot;&lt;/b&gt;' AS escaped FROM orders")
def escape_html(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.escape_html(F.concat(F.lit("<b>"), "o_orderpriority", F.lit(' & "'), "o_orderstatus", F.lit('"</b>'))).alias("escaped"))


@query(
    "number_clean",
    """
SELECT o_orderkey AS row_key, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS amount, o_orderpriority AS priority FROM orders""",
)
def number_clean(spark, d):
    from gridwright.operators.clean import number_clean as op

    grid = table(spark, d, "orders").selectExpr("o_orderkey as _row", f"concat('GHS ', format_number({CENTS}, 0)) as amount", "o_orderpriority as priority")
    return op(grid, "amount").data.withColumnRenamed("_row", "row_key")


@query(
    "number_clean_log",
    """
SELECT o_orderkey + 1 AS row, 'amount' AS "column", '(' || format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) || ')' AS raw, '-' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS clean, 'parentheses negative' AS notes FROM orders""",
)
def number_clean_log(spark, d):
    from gridwright.operators.clean import number_clean as op

    grid = table(spark, d, "orders").selectExpr("o_orderkey as _row", f"concat('(', format_number({CENTS}, 0), ')') as amount", "o_orderpriority as priority")
    return op(grid).audits["changes"]


@query("number_clean_lines", "SELECT o_orderkey AS _row, format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) AS raw, CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS VARCHAR) AS clean, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value, '' AS notes FROM orders")
def number_clean_lines(spark, d):
    from gridwright.operators.clean import number_clean_lines as op

    return op(table(spark, d, "orders").selectExpr("o_orderkey as _row", f"concat(' ', format_number({CENTS}, 0), ' ') as value"), 1000)


#: Thousands set apart by blanks and marks of all kinds.
_SOFT = ("\u00a0", "\u202f", "\u2009", "\u2007", "'", "\u2019", "\u02bc", " ")
_DASHES = ("-", "–", "—", "−", " — ", "--")
_PRICES = (("US$ ", "USD"), ("£", "GBP"), ("€", "EUR"), ("GH₵", "GHS"), ("NGN ", "NGN"), ("GHS ", "GHS"))


@query(
    "number_forms",
    f"""
WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % 26 AS w FROM orders), g AS (SELECT *, format('{{:,}}', c) AS g, CAST(c AS VARCHAR) AS t FROM o)
SELECT k, CASE WHEN w < 8 THEN c WHEN w < 14 THEN NULL WHEN w < 20 THEN c WHEN w = 20 THEN c / 100.0::DOUBLE WHEN w = 21 THEN c WHEN w = 22 THEN CASE WHEN length(g) - length(t) > 1 THEN c WHEN length(g) = length(t) THEN c ELSE c / 1000.0::DOUBLE END WHEN w = 23 THEN c + 0.25::DOUBLE WHEN w = 24 THEN c + 0.5::DOUBLE ELSE c END AS value,
  w BETWEEN 8 AND 13 AS is_nil, CASE w {" ".join(f"WHEN {14 + i} THEN '{c}'" for i, (_, c) in enumerate(_PRICES))} END AS currency,
  CASE WHEN w = 20 THEN 1 WHEN w = 21 AND NOT regexp_matches(substr(t, 1, 1) || ',' || substr(t, 2), '^[0-9],([0-9]{{3}}|[0-9]{{1,2}})$') THEN 1 WHEN w = 21 AND length(t) IN (2, 3) THEN 1 WHEN w = 24 AND NOT regexp_matches(replace(g, ',', '.') || ',5', '^[0-9]{{1,3}}([.][0-9]{{3}})+,[0-9]+$') THEN 1 ELSE 0 END AS n_warnings FROM g""",
)
def number_forms(spark, d):
    """Soft separators, dashes, currencies, and every way that commas and points can stand."""
    o = table(spark, d, "orders").selectExpr("o_orderkey as k", f"{CENTS} as cents", f"format_number({CENTS}, 0) as grouped", "o_orderkey % 26 as way")
    grouped, plain, raw = F.col("grouped"), F.col("cents").cast("string"), F.lit(None).cast("string")
    shapes = [F.replace(grouped, F.lit(","), F.lit(s)) for s in _SOFT] + [F.lit(x) for x in _DASHES] + [F.concat(F.lit(p), grouped) for p, _ in _PRICES]
    cents = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    points = F.replace(grouped, F.lit(","), F.lit("."))
    shapes += [cents, F.concat(F.substring(plain, 1, 1), F.lit(","), F.substring(plain, 2, 20)), points, F.concat(grouped, F.lit(".25")), F.concat(points, F.lit(",5")), F.concat(F.lit("+"), grouped)]
    for way, shape in enumerate(shapes):
        raw = F.when(F.col("way") == way, shape).otherwise(raw)
    return o.withColumn("p", numbers.parse_number(raw)).select("k", "p.value", "p.is_nil", "p.currency", F.size("p.warnings").alias("n_warnings"))


@query("scaled_values", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1 END * CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS scaled, CAST(format('{:.14e}', CAST(round(o_totalprice * 100) AS BIGINT) / 7.0::DOUBLE) AS DOUBLE) AS footed FROM orders")
def scaled_values(spark, d):
    w, v = F.col("o_orderkey") % 3, F.expr(CENTS).cast("double")
    unit = F.when(w == 0, "GH¢'000").when(w == 1, "US$ millions").otherwise("GHS")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), numbers.scale_value(v, unit).alias("scaled"), numbers.round_foot(v / 7).alias("footed"))


@query("markup_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'), ' ') AS said FROM pages")
def markup_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.markup_text(F.col("html")).alias("said"))


_FILES = (("a.PDF", "pdf", "PDF"), ("b.xls", "xlsx", "Workbook"), ("c.doc", "docx", "Word"), ("d.csv", "csv", "CSV"), ("e.TIFF", "image", "Image"), ("f.ods", "unknown", "Unsupported"), ("noext", "unknown", "Unsupported"))


@query("file_kinds", f"SELECT p_partkey AS k, [{', '.join(repr(x[1]) for x in _FILES)}][p_partkey % 7 + 1] AS kind, [{', '.join(repr(x[2]) for x in _FILES)}][p_partkey % 7 + 1] AS label FROM part")
def file_kinds(spark, d):
    from gridwright.sources.registry import classify_file

    name = F.concat(F.col("p_name"), F.element_at(F.array(*[F.lit(x[0]) for x in _FILES]), (F.col("p_partkey") % 7 + 1).cast("int")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), classify_file(name).alias("c")).select("k", "c.kind", "c.label")


def _ragged(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("_row"), F.slice(F.array("o_orderstatus", F.lit(None).cast("string"), "o_orderpriority", F.lit("x")), F.lit(1), (F.col("o_orderkey") % 5).cast("int")).alias("cells"))


@query("rectangular", "SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 5 >= 1 THEN o_orderstatus ELSE '' END AS column_1, '' AS column_2, CASE WHEN o_orderkey % 5 >= 3 THEN o_orderpriority ELSE '' END AS column_3, CASE WHEN o_orderkey % 5 >= 4 THEN 'x' ELSE '' END AS column_4 FROM orders")
def rectangular(spark, d):
    from gridwright.operators.clean import rectangular as op

    return op(_ragged(spark, d), "cells", 4)


@query("grid_dims", "SELECT count(*) AS n_rows, CAST(max(o_orderkey % 5) AS INTEGER) AS n_columns FROM orders")
def grid_dims(spark, d):
    from gridwright.operators.clean import grid_dims as op

    return op(_ragged(spark, d), "cells")
