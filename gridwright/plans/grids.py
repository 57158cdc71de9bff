"""Queries on whole grids: union, joins, duplicates, shapes, headers, edits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.operators import annotate, clean, combine, edits, reshape
from gridwright.operators.result import ROW

from .registry import query, table


def customers(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey - 1 as _row", "cast(c_custkey as string) as code", "c_name as name", "c_mktsegment as segment")


def orders(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as _row", "concat(' ', cast(o_custkey as string)) as CODE", "o_orderstatus as status", "o_orderpriority as segment")


def _merged(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey - 1 as _row", "c_name as `Name`", "c_mktsegment as segment")
    s = table(spark, d, "supplier").selectExpr("s_suppkey - 1 as _row", "s_name as `name `", "cast(s_nationkey as string) as nation")
    return combine.merge({"customer.csv": c, "supplier.csv": s})


@query(
    "merge",
    """
SELECT 'customer.csv' AS source_file, c_custkey - 1 AS _row, c_name AS "Name", c_mktsegment AS segment, '' AS nation FROM customer
UNION ALL SELECT 'supplier.csv', s_suppkey - 1, s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier""",
)
def merge(spark, d):
    return _merged(spark, d).data.drop("_source")


@query(
    "merge_coverage",
    """
SELECT 'customer.csv' AS source, (SELECT count(*) FROM customer) AS n_rows, 'Name,segment' AS present, 'nation' AS missing
UNION ALL SELECT 'supplier.csv', (SELECT count(*) FROM supplier), 'Name,nation', 'segment'""",
)
def merge_coverage(spark, d):
    return _merged(spark, d).audits["coverage"].select("source", "n_rows", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


_JOIN = """
WITH l AS (SELECT c_custkey - 1 AS _l, CAST(c_custkey AS VARCHAR) AS code, c_name AS name, c_mktsegment AS segment FROM customer),
r AS (SELECT o_orderkey AS _r, CAST(o_custkey + {shift} AS VARCHAR) AS k, o_orderstatus AS status, o_orderpriority AS segment_right FROM orders)
"""


def _joined(spark, d, how, shift=0):
    r = table(spark, d, "orders").selectExpr("o_orderkey as _row", f"concat(' ', cast(o_custkey + {shift} as string)) as CODE", "o_orderstatus as status", "o_orderpriority as segment")
    return combine.join(customers(spark, d), r, "code", "CODE", how)


@query("join_inner", _JOIN.format(shift=0) + "SELECT _l, _r, code, name, segment, status, segment_right FROM l JOIN r ON code = k")
def join_inner(spark, d):
    return _joined(spark, d, "inner").data


@query("join_left", _JOIN.format(shift=500) + "SELECT _l, _r, code, name, segment, coalesce(status, '') AS status, coalesce(segment_right, '') AS segment_right FROM l LEFT JOIN r ON code = k")
def join_left(spark, d):
    return _joined(spark, d, "left", 500).data


@query(
    "join_full",
    _JOIN.format(shift=500)
    + "SELECT _l, _r, CASE WHEN _l IS NULL THEN ' ' || k ELSE code END AS code, coalesce(name, '') AS name, coalesce(segment, '') AS segment, coalesce(status, '') AS status, coalesce(segment_right, '') AS segment_right FROM l FULL JOIN r ON code = k",
)
def join_full(spark, d):
    return _joined(spark, d, "full", 500).data


@query(
    "join_stats",
    _JOIN.format(shift=500)
    + """, nr AS (SELECT k, count(*) AS n FROM r GROUP BY k)
SELECT CAST(count(*) FILTER (n IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS left_only, (SELECT count(*) FROM r WHERE k NOT IN (SELECT code FROM l)) AS right_only,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS fanout, (SELECT count(*) FROM nr WHERE n > 1) AS dup_keys_right,
  CAST(coalesce(sum(coalesce(n, 1)), 0) + (SELECT count(*) FROM r WHERE k NOT IN (SELECT code FROM l)) AS BIGINT) AS "out" FROM l LEFT JOIN nr ON code = nr.k""",
)
def join_stats(spark, d):
    return _joined(spark, d, "full", 500).audits["stats"]


@query("join_left_only", _JOIN.format(shift=500) + "SELECT _l + 1 AS row, code AS key FROM l WHERE code NOT IN (SELECT k FROM r)")
def join_left_only(spark, d):
    return _joined(spark, d, "full", 500).audits["left_only"]


@query("join_right_only", _JOIN.format(shift=500) + "SELECT _r + 1 AS row, ' ' || k AS key FROM r WHERE k NOT IN (SELECT code FROM l)")
def join_right_only(spark, d):
    return _joined(spark, d, "full", 500).audits["right_only"]


def events(spark, d):
    return table(spark, d, "events").selectExpr("event_id as _row", "cast(user_id as string) as user", "event_type as type")


_DEDUPE = "WITH e AS (SELECT event_id AS _row, CAST(user_id AS VARCHAR) AS user, event_type AS type, min(event_id) OVER w AS f, max(event_id) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id, event_type)) "


@query("dedupe_first", _DEDUPE + "SELECT _row, user, type FROM e WHERE _row = f")
def dedupe_first(spark, d):
    return clean.dedupe(events(spark, d), "user, type").data


@query("dedupe_last", _DEDUPE + "SELECT _row, user, type FROM e WHERE _row = l")
def dedupe_last(spark, d):
    return clean.dedupe(events(spark, d), "user, type", keep="last").data


@query("dedupe_flag", _DEDUPE + "SELECT _row, user, type, CASE WHEN _row = f THEN '' ELSE CAST(f + 1 AS VARCHAR) END AS duplicate_of_row FROM e")
def dedupe_flag(spark, d):
    return clean.dedupe(events(spark, d), "user, type", mode="flag").data


@query("dedupe_groups", "SELECT count(*) AS duplicate_groups FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1)")
def dedupe_groups(spark, d):
    return clean.dedupe(events(spark, d), "user, type").audits["groups"]


@query("dedupe_removed", _DEDUPE + "SELECT _row + 1 AS row, f + 1 AS kept_row FROM e WHERE _row <> f")
def dedupe_removed(spark, d):
    return clean.dedupe(events(spark, d), "user, type").audits["removed"]


@query(
    "dedupe_documents",
    """
SELECT doc_id AS _row FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""",
)
def dedupe_documents(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id as _row", "text")
    return clean.dedupe(docs, "text", ignore_case=True, ignore_whitespace=True).data.select(ROW)


def wide(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as _row", "cast(o_orderkey as string) as line", "o_orderstatus as status", "case when o_orderkey % 5 = 0 then ' ' else o_orderpriority end as priority")


@query(
    "melt",
    """
SELECT o_orderkey AS _row, 0 AS _col, CAST(o_orderkey AS VARCHAR) AS line, 'status' AS variable, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 1, CAST(o_orderkey AS VARCHAR), 'priority', o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0""",
)
def melt(spark, d):
    return reshape.melt(wide(spark, d)).data


@query("melt_dropped", "SELECT count(*) AS dropped FROM orders WHERE o_orderkey % 5 = 0")
def melt_dropped(spark, d):
    return reshape.melt(wide(spark, d)).audits["dropped"]


def long(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as _row", "cast(o_custkey as string) as customer", "o_orderstatus as variable", "o_orderpriority as value")


def _pivot_sql(agg):
    return f"""
SELECT CAST(o_custkey AS VARCHAR) AS customer, min(o_orderkey) AS _row, {", ".join(f"coalesce({agg.format(s=s)}, '') AS \"{s}\"" for s in ("F", "O", "P"))} FROM orders GROUP BY o_custkey"""


@query("pivot_first", _pivot_sql("arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = '{s}')"))
def pivot_first(spark, d):
    return reshape.pivot(long(spark, d), aggregate="first").data


@query("pivot_last", _pivot_sql("arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = '{s}')"))
def pivot_last(spark, d):
    return reshape.pivot(long(spark, d), aggregate="last").data


@query("pivot_concat", _pivot_sql("string_agg(o_orderpriority, ' | ' ORDER BY o_orderkey) FILTER (o_orderstatus = '{s}')"))
def pivot_concat(spark, d):
    return reshape.pivot(long(spark, d), aggregate="concat").data


@query(
    "pivot_collisions",
    """
SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS variable, kept, o_orderpriority AS discarded FROM
(SELECT *, first_value(o_orderpriority) OVER w AS kept, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)) WHERE n > 1""",
)
def pivot_collisions(spark, d):
    return reshape.pivot(long(spark, d)).audits["collisions"]


def nations(spark, d):
    return table(spark, d, "nation").selectExpr("cast(n_nationkey as long) as _row", "n_name as name", "cast(n_regionkey as string) as region")


_N = range(25)


@query("transpose", "SELECT 0::BIGINT AS _row, " + ", ".join(f"max(n_name) FILTER (n_nationkey = {i}) AS c{i}" for i in _N) + " FROM nation UNION ALL SELECT 1, " + ", ".join(f"max(CAST(n_regionkey AS VARCHAR)) FILTER (n_nationkey = {i})" for i in _N) + " FROM nation")
def transpose(spark, d):
    return reshape.transpose(nations(spark, d))


@query("transpose_header", "SELECT 0::BIGINT AS _row, 'region' AS corner, " + ", ".join(f"max(CAST(r_regionkey AS VARCHAR)) FILTER (r_regionkey = {i}) AS c{i}" for i in range(5)) + " FROM region")
def transpose_header(spark, d):
    grid = table(spark, d, "region").selectExpr("cast(r_regionkey as long) as _row", "concat('c', r_regionkey) as name", "cast(r_regionkey as string) as region")
    return reshape.transpose_with_header(grid, "corner")


@query(
    "trim_grid",
    "SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus || ' x' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 6 <> 0",
)
def trim_grid(spark, d):
    return clean.trim_grid(_untidy(spark, d)).data


def _untidy(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as _row", "case when o_orderkey % 3 = 0 then ' ' else concat(' ', o_orderstatus, '  x ') end as status", "case when o_orderkey % 2 = 0 then '' else o_orderpriority end as priority")


@query("trim_removed_rows", "SELECT o_orderkey + 1 AS row FROM orders WHERE o_orderkey % 6 = 0")
def trim_removed_rows(spark, d):
    return clean.trim_grid(_untidy(spark, d)).audits["removed_rows"]


@query(
    "trim_changes",
    """SELECT o_orderkey + 1 AS row, 'status' AS "column", CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE ' ' || o_orderstatus || '  x ' END AS raw, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus || ' x' END AS clean FROM orders""",
)
def trim_changes(spark, d):
    return clean.trim_grid(_untidy(spark, d)).audits["changes"]


@query("stamp", "SELECT c_custkey - 1 AS _row, 'annual.pdf' AS source, '32' AS page, CAST(c_custkey AS VARCHAR) AS code, c_name AS name, c_mktsegment AS segment FROM customer")
def stamp(spark, d):
    return annotate.stamp(customers(spark, d), {"source": "annual.pdf", "page": "32", "empty": " "}).data


@query("stamp_overwrite", "SELECT c_custkey - 1 AS _row, CAST(c_custkey AS VARCHAR) AS code, c_name AS name, 'all' AS segment, 'v2' AS version FROM customer")
def stamp_overwrite(spark, d):
    return annotate.stamp(customers(spark, d), {"Segment": "all", "version": "v2"}, append=True, overwrite=True).data


@query("map_headers", "SELECT c_custkey - 1 AS _row, CAST(c_custkey AS VARCHAR) AS account_code, '' AS description, c_mktsegment AS segment, c_name AS name FROM customer")
def map_headers(spark, d):
    return annotate.map_headers(customers(spark, d), {"code": "account_code"}, ["account_code", "description", "segment"]).data


@query("map_headers_drop", "SELECT c_custkey - 1 AS _row, CAST(c_custkey AS VARCHAR) AS account_code FROM customer")
def map_headers_drop(spark, d):
    return annotate.map_headers(customers(spark, d), {"code": "account_code"}, drop_unmapped=True).data


_CANONICAL = ("economy brass", "promo steel plated", "small tin", "standard copper")


@query(
    "suggest_mapping",
    f"""
WITH n AS (SELECT unnest(range({len(_CANONICAL)})) AS i, unnest([{", ".join(repr(c) for c in _CANONICAL)}]) AS canonical),
k AS (SELECT DISTINCT p_type AS header, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS a FROM part),
t AS (SELECT header, canonical, i, a, canonical AS b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(canonical, ' ')) AS tb FROM k, n),
s AS (SELECT header, canonical, i, CASE WHEN a = b THEN 1::DOUBLE ELSE least(1::DOUBLE, len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb)))::DOUBLE + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.5 ELSE 0 END) END AS score FROM t)
SELECT header, canonical, score FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, i) AS n FROM s) WHERE n = 1 AND score >= 0.45""",
)
def suggest_mapping(spark, d):
    return annotate.suggest_mapping(table(spark, d, "part").select(F.col("p_type").alias("header")).distinct(), list(_CANONICAL))


# Edits of one table for each nation: its customers by key, name and segment. Row 3 of each is edited.


def customer_cells(spark, d):
    c = table(spark, d, "customer").withColumn("row", (F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int"))
    cells = F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("c_name").alias("text")), F.struct(F.lit(1).alias("col"), F.col("c_mktsegment").alias("text"))))
    return c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("table_id"), "row", cells.alias("c")).select("table_id", "row", "c.*")


_CELLS = """
WITH n AS (SELECT 'n' || c_nationkey AS table_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row, c_name, c_mktsegment FROM customer),
c AS (SELECT table_id, CAST(row AS INTEGER) AS row, 0 AS col, c_name AS text FROM n UNION ALL SELECT table_id, CAST(row AS INTEGER), 1, c_mktsegment FROM n)
"""


def _third(spark, d, *more):
    """A row for each table: its third row, and what more says."""
    return customer_cells(spark, d).select("table_id").distinct().select("table_id", F.lit(3).alias("row"), *more)


@query("edit_set_cells", _CELLS + "SELECT table_id, row, col, CASE WHEN row = 3 AND col = 1 THEN 'x' ELSE text END AS text FROM c")
def edit_set_cells(spark, d):
    """The second edit lies outside the grid."""
    edit = _third(spark, d, F.lit(1).alias("col"), F.lit("x").alias("text"))
    return edits.set_cells(customer_cells(spark, d), edit.unionByName(edit.withColumn("row", F.lit(10**6))))


@query("edit_delete_rows", _CELLS + "SELECT table_id, row - (row > 3)::INT AS row, col, text FROM c WHERE row <> 3")
def edit_delete_rows(spark, d):
    return edits.delete_rows(customer_cells(spark, d), _third(spark, d))


@query("edit_delete_columns", _CELLS + "SELECT table_id, row, 0 AS col, text FROM c WHERE col = 1")
def edit_delete_columns(spark, d):
    return edits.delete_columns(customer_cells(spark, d), _third(spark, d).select("table_id", F.lit(0).alias("col")))


@query("edit_insert_rows", _CELLS + "SELECT table_id, row + (row > 3)::INT AS row, col, text FROM c UNION ALL SELECT table_id, 4, col, '' FROM c WHERE row = 3")
def edit_insert_rows(spark, d):
    return edits.insert_rows_after(customer_cells(spark, d), _third(spark, d))


@query("edit_promote_row", _CELLS + "SELECT table_id, 0 AS row, col, text, true AS header FROM c WHERE row = 3 UNION ALL SELECT table_id, row - (row > 3)::INT, col, text, false FROM c WHERE row <> 3")
def edit_promote_row(spark, d):
    c = customer_cells(spark, d)
    body, head = edits.promote_rows(c, c.limit(0), _third(spark, d))
    return head.withColumn("header", F.lit(True)).unionByName(body.withColumn("header", F.lit(False)))


@query("edit_demote_headers", _CELLS + "SELECT table_id, row, col, text FROM c")
def edit_demote_headers(spark, d):
    """Rows promoted and put back: the first row of each table as its header, and down again."""
    c = customer_cells(spark, d)
    body, head = edits.promote_rows(c, c.limit(0), _third(spark, d).withColumn("row", F.lit(0)))
    return edits.demote_headers(body, head, c.select("table_id").distinct())[0]


def _sessions(spark, d):
    """(tables, pages): a table and a page for each customer, a document for each nation."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    doc = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("doc_id")
    tables = c.select(F.concat(F.lit("t"), key.cast("string")).alias("table_id"), doc, (key % 3 != 0).alias("selected"), F.col("c_mktsegment").alias("title"), F.when(key % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("warnings"))
    return tables, c.select(doc, key.cast("int").alias("page"), (key % 4 == 0).alias("needs_ocr"), (key % 8 == 0).alias("ocr_applied"))


@query(
    "session_stats",
    "SELECT (SELECT count(*) FROM nation) AS files, count(DISTINCT c_nationkey) AS docs, count(*) AS tables, count(*) FILTER (c_custkey % 3 <> 0) AS selected, count(*) AS pages, count(*) FILTER (c_custkey % 8 = 0) AS ocr_pages, count(*) FILTER (c_custkey % 8 = 4) AS needs_ocr, 2 * count(*) FILTER (c_custkey % 5 = 0) AS warnings FROM customer",
)
def session_stats(spark, d):
    tables, pages = _sessions(spark, d)
    return edits.session_stats(table(spark, d, "nation"), pages, tables)


@query(
    "edit_tables",
    """SELECT 't' || c_custkey AS table_id, CASE WHEN c_nationkey % 2 = 0 THEN false WHEN c_custkey % 7 = 0 THEN true ELSE c_custkey % 3 <> 0 END AS selected, CASE WHEN c_custkey % 11 = 0 THEN 'new' ELSE c_mktsegment END AS title,
 CASE WHEN c_custkey % 10 = 0 THEN 'a|b|c' WHEN c_custkey % 5 = 0 THEN 'a|b' WHEN c_custkey % 2 = 0 THEN 'b|c' ELSE '' END AS warnings FROM customer""",
)
def edit_tables(spark, d):
    """Titles patched, tables and then whole documents selected or not, warnings added, each once."""
    tables, _ = _sessions(spark, d)
    key = F.expr("cast(substring(table_id, 2) as bigint)")
    tables = edits.set_meta(tables, tables.where(key % 11 == 0).select("table_id", F.lit("new").alias("title")))
    tables = edits.select_tables(tables, tables.where(key % 7 == 0).select("table_id", F.lit(True).alias("selected")))
    tables = edits.select_documents(tables, tables.select("doc_id").distinct().where("cast(substring(doc_id, 2) as int) % 2 = 0").select("doc_id", F.lit(False).alias("selected")))
    told = tables.where(key % 2 == 0).select("table_id", F.explode(F.array(F.lit("c"), F.lit("b"), F.lit("c"))).alias("warning"))
    return edits.add_warnings(tables, told).select("table_id", "selected", "title", F.array_join("warnings", "|").alias("warnings"))


@query("edit_columns", "SELECT 't' || c_custkey AS table_id, i AS col, CASE WHEN i = 1 AND c_custkey % 2 = 0 THEN 'Year' WHEN i = 1 THEN '2011' ELSE 'item' END AS label FROM customer, (SELECT unnest([0, 1]) AS i)")
def edit_columns(spark, d):
    """Declared names laid over detected ones; blank names change nothing."""
    tables, _ = _sessions(spark, d)
    labels = tables.select("table_id", F.posexplode(F.array(F.lit("item"), F.lit("2011"))).alias("col", "label"))
    even = tables.where("cast(substring(table_id, 2) as bigint) % 2 = 0").select("table_id", F.posexplode(F.array(F.lit(" "), F.lit("Year"))).alias("col", "name"))
    return edits.map_columns(labels, even)


@query("session_grid", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS _row, c_name AS \"Customer name\", c_mktsegment AS column_2 FROM customer WHERE c_nationkey = 7")
def session_grid(spark, d):
    """One nation's table as a tool takes it, under stacked headers."""
    headers = spark.createDataFrame([("n7", 0, 0, "Customer"), ("n7", 1, 0, "name"), ("n7", 2, 0, "Customer"), ("n8", 0, 1, "other")], "table_id string, row int, col int, text string")
    return edits.to_grid(customer_cells(spark, d), headers, "n7")
