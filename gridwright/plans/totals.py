"""Queries on totals, schemas and emitted rows. A table is a customer's orders: label, amount in cents as printed, and a total row that is off by nine for every tenth customer."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright import sinks
from gridwright.operators import verify
from gridwright.operators.extract import grids

from .cells import CENTS
from .registry import query, table

# Shared by both sides: rows 0..n-1 are orders, row n is the total.
_SQL = """
WITH o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders),
t AS (SELECT k, count(*) AS row, CAST(sum(cents) AS BIGINT) AS s, CAST(sum(cents) AS BIGINT) + CASE WHEN k % 10 = 0 THEN 9 ELSE 0 END AS printed FROM o GROUP BY k),
c AS (SELECT 'c' || k AS table_id, row, 0 AS col, 'Order ' || o_orderkey AS text, k, NULL::BIGINT AS v FROM o UNION ALL SELECT 'c' || k, row, 1, format('{:,}', cents), k, cents FROM o UNION ALL SELECT 'c' || k, row, 2, o_orderpriority, k, NULL FROM o
  UNION ALL SELECT 'c' || k, row, 0, 'Total', k, NULL FROM t UNION ALL SELECT 'c' || k, row, 1, '(' || format('{:,}', printed) || ')', k, -printed FROM t WHERE k % 7 = 0 UNION ALL SELECT 'c' || k, row, 1, format('{:,}', printed), k, printed FROM t WHERE k % 7 <> 0 UNION ALL SELECT 'c' || k, row, 2, '', k, NULL FROM t)
"""


def statement_cells(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderkey", f"{CENTS} as cents", "o_orderpriority")
    rows = o.withColumn("row", (F.row_number().over(W.partitionBy("k").orderBy("o_orderkey")) - 1).cast("int"))
    t = o.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("row"), (F.sum("cents") + F.when(F.col("k") % 10 == 0, 9).otherwise(0)).alias("p"))
    cell = lambda i, v: F.struct(F.lit(i).alias("col"), v.alias("text"))
    shown = F.format_number("cents", 0)
    body = rows.select("k", "row", F.explode(F.array(cell(0, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))), cell(1, shown), cell(2, F.col("o_orderpriority")))).alias("x"))
    total = F.when(F.col("k") % 7 == 0, F.concat(F.lit("("), F.format_number("p", 0), F.lit(")"))).otherwise(F.format_number("p", 0))
    last = t.select("k", "row", F.explode(F.array(cell(0, F.lit("Total")), cell(1, total), cell(2, F.lit("")))).alias("x"))
    return body.unionByName(last).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("table_id"), "row", "x.*")


def statement_labels(spark, d):
    return statement_cells(spark, d).select("table_id").distinct().withColumn("x", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.lit("item").alias("label")), F.struct(F.lit(1).alias("col"), F.lit("2011").alias("label")), F.struct(F.lit(2).alias("col"), F.lit("priority").alias("label"))))).select("table_id", "x.*")


def statement_tables(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("o_custkey")
    return n.select(
        F.concat(F.lit("c"), k.cast("string")).alias("table_id"), F.lit("annual.pdf").alias("source_file"), (k % 50).cast("int").alias("page"), F.lit("pdf-text").alias("origin"), F.when(k % 3 == 0, "notes").otherwise("statements").alias("section"),
        F.when(k % 3 == 0, (k % 40).cast("string")).alias("note_ref"), F.concat(F.lit("Orders of "), k.cast("string")).alias("title"), F.lit("GHS").alias("units"), F.lit(3).alias("column_count"), (F.col("n") + 1).cast("int").alias("row_count"),
        (F.lit(0.5) + (k % 4) / 8).alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("warnings"),
    )


@query(
    "foot_check_total",
    _SQL
    + """, n AS (SELECT k, row, s, CASE WHEN k % 7 = 0 THEN -printed ELSE printed END AS p FROM t)
SELECT 'c' || k AS table_id, CAST(row AS INTEGER) AS row, CASE WHEN row < 2 THEN '' WHEN s = p THEN '2011: ok' ELSE '2011: calc ' || s || ' vs printed ' || p || ' (diff ' || (s - p) || ')' END AS check_total FROM n""",
)
def foot_check_total(spark, d):
    return verify.check_totals(statement_cells(spark, d), statement_labels(spark, d))


@query("numeric_columns", _SQL + "SELECT DISTINCT table_id, 1 AS col FROM c")
def numeric_columns(spark, d):
    return verify.numeric_columns(statement_cells(spark, d))


@query(
    "live_foot",
    _SQL
    + """SELECT 'c' || k AS table_id, CAST(row AS INTEGER) AS row, 1 AS col, CAST(p AS DOUBLE) AS printed, CAST(s AS DOUBLE) AS computed, CAST(p - s AS DOUBLE) AS delta, p = s AS ok FROM (SELECT *, CASE WHEN k % 7 = 0 THEN -printed ELSE printed END AS p FROM t)""",
)
def live_foot(spark, d):
    return verify.live_foot(statement_cells(spark, d))


def _pending_cells(spark, d):
    """For each nation: two lines, a total, two lines, a total, and a grand total of both."""
    n = F.col("n_nationkey")
    rows = [("a", n), ("b", n + 1), ("Total one", 2 * n + 1), ("c", n * 3), ("d", n * 4), ("Total two", n * 7 + (n % 2)), ("Total", 9 * n + 1 + (n % 2)), ("e", n), ("f", n), ("Total three", n * 2), ("Total", 11 * n + 1 + (n % 2))]
    cells = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), (F.lit(lab) if c == 0 else v.cast("string")).alias("text")) for r, (lab, v) in enumerate(rows) for c in (0, 1)]
    return table(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("table_id"), F.explode(F.array(*cells)).alias("x")).select("table_id", "x.*")


@query(
    "live_foot_pending",
    """
WITH x AS (SELECT n_nationkey::DOUBLE AS n, n_nationkey % 2 AS o FROM nation)
SELECT 'n' || CAST(n AS INT) AS table_id, r AS row, 1 AS col, p AS printed, c AS computed, p - c AS delta, p = c AS ok FROM (
SELECT n, 2 AS r, 2 * n + 1 AS p, 2 * n + 1 AS c FROM x UNION ALL SELECT n, 5, 7 * n + o, 7 * n FROM x UNION ALL SELECT n, 6, 9 * n + 1 + o, 9 * n + 1 + o FROM x
UNION ALL SELECT n, 9, 2 * n, 2 * n FROM x UNION ALL SELECT n, 10, 11 * n + 1 + o, 11 * n + 1 + o FROM x)""",
)
def live_foot_pending(spark, d):
    return verify.live_foot(_pending_cells(spark, d))


@query("sum_cells", _SQL + "SELECT table_id, CAST(sum(v) AS DOUBLE) AS sum, count(v) AS count, 0::BIGINT AS nils, 0::BIGINT AS skipped FROM c WHERE col = 1 GROUP BY table_id")
def sum_cells(spark, d):
    return verify.sum_cells(statement_cells(spark, d).where("col = 1"), "text", "table_id")


@query(
    "foot_lines",
    """
WITH x AS (SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderkey % 10 <> 0) AS BIGINT) AS s, count(*) FILTER (o_orderkey % 10 <> 0) AS n, count(*) FILTER (o_orderkey % 10 = 0) AS k FROM orders)
SELECT m AS metric, v AS value FROM (SELECT unnest(['values counted', 'values skipped (not numeric)', 'computed sum', 'expected total', 'difference', 'status']) AS m, unnest([n::VARCHAR, k::VARCHAR, s::VARCHAR, '1000', (s - 1000)::VARCHAR,
 CASE WHEN (s - 1000) % 9 = 0 THEN 'DOES NOT FOOT (difference divisible by 9 — often two transposed digits)' ELSE 'DOES NOT FOOT' END]) AS v FROM x)""",
)
def foot_lines(spark, d):
    lines = table(spark, d, "orders").selectExpr("o_orderkey as _row", f"case when o_orderkey % 10 = 0 then '-' else format_number({CENTS}, 0) end as value")
    return verify.foot_lines(lines, "1,000")


@query(
    "foot_grid",
    """
WITH x AS (SELECT CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) AS s, CAST(sum(c_nationkey) AS DOUBLE) AS n, count(*) AS k FROM customer)
SELECT 'balance' AS "column", k AS values_counted, s AS computed_sum, s AS expected, 0::DOUBLE AS difference, 'FOOTS' AS status, 'printed row "Grand total"' AS expected_source FROM x
UNION ALL SELECT 'nation', k, n, n + 10, -10, 'DOES NOT FOOT', 'printed row "Grand total"' FROM x""",
)
def foot_grid(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey - 1 as _row", "c_name as name", "cast(round(c_acctbal * 100) as bigint) as b", "c_nationkey as n", "c_mktsegment as segment")
    body = c.selectExpr("_row", "name", "cast(b as string) as balance", "cast(n as string) as nation", "segment")
    total = c.agg(F.count(F.lit(1)).alias("_row"), F.sum("b").alias("b"), F.sum("n").alias("n")).selectExpr("_row", "'Grand total' as name", "cast(b as string) as balance", "cast(n + 10 as string) as nation", "'' as segment")
    return verify.foot_grid(body.unionByName(total))


RULES = """
code: integer, required, unique, min=10, max=1400
name: text, pattern=^Customer#\\d{1,9}$, maxlen=18
balance: number, min=0
segment: enum=building|machinery|household
day: date
flag: boolean
"""


def _schema(spark, d):
    grid = table(spark, d, "customer").selectExpr(
        "c_custkey - 1 as _row", "case when c_custkey % 100 = 0 then '' when c_custkey % 100 = 1 then 'x' else cast(c_custkey as string) end as code", "case when c_custkey % 50 = 0 then concat(c_name, '000') else c_name end as name",
        "format_number(cast(round(c_acctbal * 100) as bigint), 0) as balance", "c_mktsegment as segment", "case when c_custkey % 90 = 0 then '31/13/2011' else '2011-12-31' end as day", "case when c_custkey % 80 = 0 then 'maybe' else 'Yes' end as flag", "'' as extra",
    )
    return verify.schema_check(grid, verify.parse_rules(RULES)[0])


_ISSUES = """
WITH c AS (SELECT c_custkey AS k, c_custkey + 1 AS row, CASE WHEN c_custkey % 50 = 0 THEN c_name || '000' ELSE c_name END AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS b, c_mktsegment AS segment FROM customer),
i AS (SELECT row, 'code' AS "column", 'required value is empty' AS message, '' AS value FROM c WHERE k % 100 = 0
UNION ALL SELECT row, 'code', 'expected a integer, got text', 'x' FROM c WHERE k % 100 = 1
UNION ALL SELECT row, 'code', 'below min=10', k::VARCHAR FROM c WHERE k % 100 NOT IN (0, 1) AND k < 10
UNION ALL SELECT row, 'code', 'above max=1400', k::VARCHAR FROM c WHERE k % 100 NOT IN (0, 1) AND k > 1400
UNION ALL SELECT row, 'name', 'longer than maxlen=18 (' || length(name) || ' chars)', name FROM c WHERE length(name) > 18
UNION ALL SELECT row, 'name', 'does not match ^Customer#\\d{1,9}$', name FROM c WHERE NOT regexp_matches(name, '^Customer#\\d{1,9}$')
UNION ALL SELECT row, 'balance', 'below min=0', format('{:,}', b) FROM c WHERE b < 0
UNION ALL SELECT row, 'segment', 'not one of: building, machinery, household', segment FROM c WHERE lower(segment) NOT IN ('building', 'machinery', 'household')
UNION ALL SELECT row, 'day', 'not a recognisable date', '31/13/2011' FROM c WHERE k % 90 = 0
UNION ALL SELECT row, 'flag', 'not a boolean', 'maybe' FROM c WHERE k % 80 = 0)
"""


@query("schema_issues", _ISSUES + "SELECT * FROM i")
def schema_issues(spark, d):
    return _schema(spark, d).data


@query("schema_stats", _ISSUES + "SELECT (SELECT count(*) FROM c) AS rows_checked, count(*) AS issue_count, count(DISTINCT row) AS rows_with_issues, 6 AS rules_applied FROM i")
def schema_stats(spark, d):
    return _schema(spark, d).audits["stats"]


@query("schema_passing", _ISSUES + "SELECT k - 1 AS _row FROM c WHERE row NOT IN (SELECT row FROM i)")
def schema_passing(spark, d):
    return _schema(spark, d).audits["passing"].select("_row")


@query("schema_unique", "SELECT event_id + 2 AS row, 'user' AS \"column\", 'duplicate value, first seen at row ' || (f + 2) AS message, CAST(user_id AS VARCHAR) AS value FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM events) WHERE event_id > f")
def schema_unique(spark, d):
    grid = table(spark, d, "events").selectExpr("event_id as _row", "cast(user_id as string) as user")
    return verify.schema_check(grid, [verify.Rule("user", unique=True)]).data


_MACHINE = _SQL + """, m AS (SELECT k, table_id, row, label AS row_label, CASE col WHEN 1 THEN '2011' ELSE 'priority' END AS "column",
 CASE WHEN col = 1 THEN v::VARCHAR ELSE text END AS value, text AS raw FROM c JOIN (SELECT table_id, row, text AS label FROM c WHERE col = 0) USING (table_id, row) WHERE col >= 1 AND trim(text) <> '')"""


@query(
    "machine_rows",
    _MACHINE + """SELECT 'annual.pdf' AS source_file, CAST(k % 50 AS INTEGER) AS page, table_id, 'Orders of ' || k AS table_title, CASE WHEN k % 3 = 0 THEN (k % 40)::VARCHAR ELSE '' END AS note_ref, CASE WHEN k % 3 = 0 THEN 'notes' ELSE 'statements' END AS section, row_label, "column", value, 'GHS' AS unit FROM m""",
)
def machine_rows(spark, d):
    return sinks.machine_rows(statement_tables(spark, d), statement_cells(spark, d), statement_labels(spark, d))


@query("notes_rows", _MACHINE + """SELECT 'annual.pdf' AS source_file, CAST(k % 50 AS INTEGER) AS page, (k % 40)::VARCHAR AS note_ref, 'Orders of ' || k AS note_title, table_id, row_label, "column", value, raw, 'GHS' AS unit FROM m WHERE k % 3 = 0""")
def notes_rows(spark, d):
    return sinks.notes_rows(statement_tables(spark, d), statement_cells(spark, d), statement_labels(spark, d))


@query(
    "analyst_rows",
    _SQL + """, n AS (SELECT k, row, s, CASE WHEN k % 7 = 0 THEN -printed ELSE printed END AS p FROM t)
SELECT table_id, 'annual.pdf' AS source_file, CAST(any_value(c.k) % 50 AS INTEGER) AS page, CAST(c.row AS INTEGER) AS row, string_agg(text, '|' ORDER BY col) AS cells,
 coalesce(any_value(CASE WHEN n.row < 2 THEN '' WHEN s = p THEN '2011: ok' ELSE '2011: calc ' || s || ' vs printed ' || p || ' (diff ' || (s - p) || ')' END), '') AS check_total
FROM c LEFT JOIN n ON c.k = n.k AND c.row = n.row GROUP BY table_id, c.row""",
)
def analyst_rows(spark, d):
    return sinks.analyst_rows(statement_tables(spark, d), statement_cells(spark, d), statement_labels(spark, d)).withColumn("cells", F.array_join("cells", "|"))


@query(
    "index_rows",
    """
SELECT 'c' || o_custkey AS table_id, 'annual.pdf' AS source_file, CAST(o_custkey % 50 AS INTEGER) AS page, 'pdf-text' AS origin, CASE WHEN o_custkey % 3 = 0 THEN 'notes' ELSE 'statements' END AS section, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 40)::VARCHAR ELSE '' END AS note_ref,
 'Orders of ' || o_custkey AS title, 'GHS' AS units, 3 AS columns, CAST(count(*) + 1 AS INTEGER) AS rows, ['0.50', '0.63', '0.75', '0.88'][o_custkey % 4 + 1] AS confidence, 'a | b' AS warnings FROM orders GROUP BY o_custkey""",
)
def index_rows(spark, d):
    return sinks.index_rows(statement_tables(spark, d))


@query("review_names", "SELECT 'c' || k AS table_id, 'annual_p' || k % 50 || '_t' || row_number() OVER (PARTITION BY k % 50 ORDER BY 'c' || k) || '_review.csv' AS review_file FROM (SELECT DISTINCT o_custkey AS k FROM orders)")
def review_names(spark, d):
    return sinks.review_names(statement_tables(spark, d))


def _entries(spark, d):
    return table(spark, d, "documents").selectExpr("concat('Doc_', source, case when doc_id % 2 = 0 then '.CSV' else '.csv' end) as name", "text as content", "'' as kind", "'' as source", "cast(null as int) as page", "lang as note", "doc_id")


@query("manifest_rows", "SELECT 'Doc_' || source || CASE WHEN doc_id % 2 = 0 THEN '.CSV' ELSE '.csv' END AS file, 'csv' AS kind, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, 'bundle' AS source, '' AS page, '2024-01-01' AS created, lang AS note FROM documents")
def manifest_rows(spark, d):
    return sinks.manifest_rows(_entries(spark, d), "2024-01-01", "bundle")


@query("manifest_totals", "SELECT count(*) AS file_count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM documents")
def manifest_totals(spark, d):
    return sinks.manifest_totals(sinks.manifest_rows(_entries(spark, d), "2024-01-01"))


@query(
    "unique_entry_names",
    """SELECT doc_id, CASE WHEN n = 1 THEN base || ext ELSE base || '_' || n || ext END AS entry FROM (SELECT doc_id, 'Doc_' || source AS base, CASE WHEN doc_id % 2 = 0 THEN '.CSV' ELSE '.csv' END AS ext, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""",
)
def unique_entry_names(spark, d):
    return sinks.unique_entry_names(_entries(spark, d), "doc_id").select("doc_id", "entry")


@query("csv_lines", "SELECT c_custkey AS k, '\"' || c_name || '\",\"He said \"\"' || c_mktsegment || '\"\"\",\"\"' AS line FROM customer")
def csv_lines(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), sinks.csv_line([F.col("c_name"), F.concat(F.lit('He said "'), "c_mktsegment", F.lit('"')), F.lit(None)]).alias("line"))


@query(
    "classify_grids",
    """
WITH n AS (SELECT o_custkey AS k, count(*) + 1 AS r FROM orders GROUP BY o_custkey),
s AS (SELECT k, r, 2 * r - 1 AS data, CAST(r AS DOUBLE) / (2 * r - 1) AS numeric, 1.0::DOUBLE AS words FROM n)
SELECT 'c' || k AS table_id, 3 AS column_count, r AS row_count, numeric, true AS is_table FROM s""",
)
def classify_grids(spark, d):
    return grids.classify(statement_cells(spark, d).withColumn("text", F.regexp_replace("text", " ", "")), keys=["table_id"]).select("table_id", "column_count", "row_count", "numeric", "is_table")


@query("header_counts", "SELECT 'c' || o_custkey AS table_id, 1 AS n_headers FROM orders GROUP BY o_custkey")
def header_counts(spark, d):
    """Every statement below a heading of its own."""
    body = statement_cells(spark, d)
    heading = F.explode(F.array(*[F.struct(F.lit(0).alias("row"), F.lit(i).alias("col"), F.lit(t).alias("text")) for i, t in enumerate(("Note", "2011", "Group"))]))
    head = body.select("table_id").distinct().withColumn("x", heading).select("table_id", "x.*")
    return grids.header_counts(head.unionByName(body.withColumn("row", F.col("row") + 1)), keys=["table_id"])
