"""Queries on links, hosts, robots rules and HTML tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.functions import web
from gridwright.sources import html

from .cells import CENTS
from .registry import query, re2, table


@query(
    "anchors",
    r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>')) AS a FROM pages)
SELECT page_id, regexp_extract(a, '(?is)href\s*=\s*"([^"]*)"', 1) AS href FROM a""",
)
def anchors(spark, d):
    return html.anchors(table(spark, d, "pages")).select("page_id", "href")


# Links of every form, after a page's own: %s is the page's number.
_MADE = (
    '<a href="/reports/annual-%s.pdf">Annual <b>report</b> %s</a>', '<a href="https://files.example.com/x/%s.xlsx#s" title="Sheet %s">figures</a>', '<a href="/investors/">Investor relations</a>', '<a href="/investors/">again</a>', '<a href="mailto:a@b.c">mail</a>',
    '<a href="#top">top</a>', '<a href="JavaScript:void(0)">x</a>', '<a href="../data/%s.csv">data</a>', '<a href="//cdn.example.com/i.png"><img src="i.png"></a>', '<a href="/media/news.html?id=%s">News</a>', '<a href="ftp://example.com/%s.zip">old</a>',
)


def linked_pages(spark, d):
    made = F.lit("")
    for link in _MADE:
        made = F.concat(made, F.replace(F.lit(link), F.lit("%s"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").withColumn("html", F.concat("html", made))


_FILE = "coalesce(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/?(?:[?#].*)?$', 1), ''), 'download')"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(url, {re2(p)}) THEN '{k}'" for p, k in web.EXTENSIONS) + " ELSE 'unknown' END"
_LINKS = rf"""
WITH made AS (SELECT page_id, url, regexp_extract_all(html || replace('{"".join(_MADE)}', '%s', CAST(page_id AS VARCHAR)), '(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>') AS l FROM pages),
a AS (SELECT page_id, url, unnest(range(len(l))) AS pos, unnest(l) AS a FROM made),
h AS (SELECT *, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '^<a[^>]*title="([^"]*)"', 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(a, '^<a[^>]*>|</a>$', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM a),
t AS (SELECT *, regexp_replace(CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '//%' THEN split_part(url, ':', 1) || ':' || href WHEN href LIKE '/%' THEN origin || href WHEN href LIKE '../%' THEN origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || substr(href, 4) END, '#.*$', '') AS target
  FROM h WHERE NOT regexp_matches(lower(href), '^(#|mailto:|tel:|javascript:|ftp:)')),
f AS (SELECT page_id, CAST(min(pos) AS INTEGER) AS pos, arg_min(url, pos) AS page_url, target AS url, arg_min(label, pos) AS label0, arg_min(title, pos) AS title FROM t GROUP BY page_id, target),
c AS (SELECT page_id, pos, page_url, url, CASE WHEN label0 = '' THEN {_FILE} ELSE label0 END AS label, title, {_FILE} AS filename, {_KIND} AS kind, CASE WHEN {_KIND} = 'unknown' THEN 'unknown' ELSE 'extension' END AS basis FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM c WHERE regexp_extract(url, '^(https?://[^/?#]+)', 1) = regexp_extract(page_url, '^(https?://[^/?#]+)', 1) AND url <> regexp_replace(page_url, '#.*$', '') AND kind IN ('unknown', 'html')
  AND (regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), {re2(web.INDEX_WORDS)}) OR regexp_matches(label, {re2(web.INDEX_WORDS)})))
"""


@query("candidate_links", _LINKS + "SELECT * FROM c")
def candidate_links(spark, d):
    return html.candidates(html.anchors(linked_pages(spark, d)))


@query("links_by_kind", _LINKS + "SELECT kind, count(*) AS n, CAST(list_position(['pdf', 'spreadsheet', 'csv', 'document', 'image', 'archive', 'html', 'text', 'unknown'], kind) AS BIGINT) AS rank FROM c GROUP BY kind")
def links_by_kind(spark, d):
    return html.group_by_kind(html.candidates(html.anchors(linked_pages(spark, d))))


@query("links_to_follow", _LINKS + "SELECT * EXCLUDE (n) FROM i WHERE n < 6")
def links_to_follow(spark, d):
    return html.discover(linked_pages(spark, d))["follow"]


@query("documents_found", _LINKS + "SELECT * FROM c WHERE kind IN ('pdf', 'spreadsheet', 'csv', 'document', 'image') AND NOT regexp_matches(page_url, '^https?://[^/?#]*/en/')")
def documents_found(spark, d):
    """Documents that pages link to, but for pages that robots rules close to this reader."""
    pages = linked_pages(spark, d)
    origins = pages.select(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin")).distinct()
    rules = html.parse_robots(origins.withColumn("text", F.lit(ROBOTS)))
    return html.discover(pages, robots=rules, agent="reader")["documents"]


@query(
    "links_with_responses",
    _LINKS
    + """SELECT page_id, url, CASE WHEN pos % 4 = 0 THEN 'pdf' ELSE kind END AS kind, CASE WHEN pos % 4 = 0 THEN 'content-type' ELSE basis END AS basis, CASE WHEN pos % 4 = 3 THEN NULL ELSE 200 END AS status, CASE pos % 4 WHEN 0 THEN page_id + 2 WHEN 1 THEN 5000 + pos END AS bytes,
 CASE pos % 4 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'GET' WHEN 2 THEN 'HEAD' ELSE 'none' END AS method, pos % 4 = 0 AS confirmed FROM c""",
)
def links_with_responses(spark, d):
    """Candidates with what probes told: a HEAD, a ranged GET where HEAD was refused, a HEAD without a length, and nothing."""
    links = html.candidates(html.anchors(linked_pages(spark, d)))
    n = F.col("pos") % 4
    none = F.lit(None)
    answer = lambda method, status, kind, size, span: F.struct(F.lit(method).alias("method"), F.lit(status).alias("status"), F.lit(kind).alias("content_type"), size.cast("string").alias("content_length"), span.cast("string").alias("content_range"))
    refused = F.array(answer("HEAD", 405, "", none, none), answer("GET", 200, "application/octet-stream", F.lit(1), F.concat(F.lit("bytes 0-0/"), (F.col("pos") + 5000).cast("string"))))
    told = F.when(n == 0, F.array(answer("HEAD", 200, "application/pdf; x=1", F.col("page_id") + 2, none))).when(n == 1, refused).when(n == 2, F.array(answer("HEAD", 200, "", none, none))).otherwise(F.array(answer("HEAD", 500, "", none, none)))
    named = links.withColumn("url", F.concat_ws(" ", "page_id", "url"))
    responses = named.select("url", F.explode(told).alias("a")).select("url", "a.*")
    return html.with_responses(named, responses).select("page_id", F.substring_index("url", " ", -1).alias("url"), "kind", "basis", F.col("status").cast("int").alias("status"), "bytes", "method", "confirmed")


_PLAIN = "url_encode(url)"
for _code, _char in (("%21", "!"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    _PLAIN = f"replace({_PLAIN}, '{_code}', '{_char}')"


@query("proxy_urls", f"SELECT page_id, 'https://p.example.com/?k=1&url=' || replace({_PLAIN}, '%27', chr(39)) || '&range=bytes%3D0-0' AS asked FROM pages")
def proxy_urls(spark, d):
    return table(spark, d, "pages").select("page_id", web.proxy_url("https://p.example.com/?k=1", F.col("url"), {"range": "bytes=0-0", "none": ""}).alias("asked"))


_ANSWERS = ((200, None, True, None), (404, 404, True, "TARGET_NOT_FOUND"), (200, 403, True, "TARGET_FORBIDDEN"), (413, None, True, "TOO_LARGE"), (502, 503, True, "TARGET_ERROR"), (429, None, True, "PROXY_ERROR"), (404, None, False, "NOT_A_PROXY"), (302, None, False, "PROXY_ERROR"))


@query("response_errors", f"SELECT page_id, [{', '.join(repr(c) if c else 'NULL' for *_, c in _ANSWERS)}][page_id % {len(_ANSWERS)} + 1] AS code FROM pages")
def response_errors(spark, d):
    told = F.element_at(F.array(*[F.struct(F.lit(i > 0).alias("bad"), F.lit(s).alias("s"), F.lit(t).cast("int").alias("t"), F.lit(p).alias("p")) for i, (s, t, p, _) in enumerate(_ANSWERS)]), (F.col("page_id") % len(_ANSWERS) + 1).cast("int"))
    return table(spark, d, "pages").withColumn("x", told).select("page_id", web.response_error(~F.col("x.bad"), F.col("x.p"), F.col("x.s"), F.col("x.t")).alias("code"))


@query("download_names", rf"SELECT page_id, CASE WHEN regexp_matches(n, '(?i)\.[a-z0-9]{{2,5}}$') THEN n ELSE n || ['.pdf', '.xlsx', '.html', ''][page_id % 4 + 1] END AS name FROM (SELECT page_id, {_FILE} AS n FROM pages)")
def download_names(spark, d):
    mime = F.element_at(F.array(*[F.lit(m) for m in ("application/pdf", "application/vnd.ms-excel", "text/html; charset=utf-8", "application/octet-stream")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", web.download_name(F.col("url"), mime).alias("name"))


_SNIFF = (
    (".pdf", "", "pdf", "extension"), ("", "application/pdf; q=1", "pdf", "content-type"), (".xlsx?x=1", "application/octet-stream", "spreadsheet", "extension"), (".csv", "text/plain", "csv", "extension"),
    ("", "text/plain", "text", "content-type"), ("", "", "unknown", "unknown"), (".html", "image/png", "image", "content-type"), (".docx#p2", "", "document", "extension"),
)


@query("sniff_kind", f"SELECT page_id, [{', '.join(repr(x[2]) for x in _SNIFF)}][page_id % 8 + 1] AS kind, [{', '.join(repr(x[3]) for x in _SNIFF)}][page_id % 8 + 1] AS basis, {_KIND} AS own_kind FROM pages")
def sniff_kind(spark, d):
    """Made addresses of eight forms, and each page's own without a content type."""
    at = (F.col("page_id") % 8 + 1).cast("int")
    url = F.concat(F.lit("https://example.com/x"), F.element_at(F.array(*[F.lit(x[0]) for x in _SNIFF]), at))
    made, own = web.sniff_kind(url, F.element_at(F.array(*[F.lit(x[1]) for x in _SNIFF]), at)), web.sniff_kind(F.col("url"), F.lit(None))
    return table(spark, d, "pages").select("page_id", made.alias("s"), own.alias("o")).select("page_id", "s.kind", "s.basis", F.col("o.kind").alias("own_kind"))


_TARGETS = (
    ("https://example.com/a", None), ("ftp://example.com/a", "BAD_SCHEME"), ("not a url", "BAD_URL"), ("http://u:p@example.com/", "CREDENTIALS_IN_URL"), ("http://example.com:22/", "BLOCKED_PORT"), ("http://127.0.0.1/", "BLOCKED_HOST"),
    ("http://10.1.2.3/x", "BLOCKED_HOST"), ("http://169.254.169.254/latest", "BLOCKED_HOST"), ("http://172.20.0.1/", "BLOCKED_HOST"), ("http://172.32.0.1/", None), ("http://2130706433/", "BLOCKED_HOST"), ("http://db.internal/", "BLOCKED_HOST"),
    ("http://[::1]/", "BLOCKED_HOST"), ("http://100.64.0.1/", "BLOCKED_HOST"), ("http://a.bad.example/", "HOST_BLOCKLISTED"), ("https://example.com:8443/a", None), ("http://localhost:8080/", "BLOCKED_HOST"), ("http://8.8.8.8/", None),
)


@query(
    "validate_target",
    f"SELECT page_id, [{', '.join(repr(c) if c else 'NULL' for _, c in _TARGETS)}][page_id % {len(_TARGETS)} + 1] AS code, [{', '.join(str(c is None).lower() for _, c in _TARGETS)}][page_id % {len(_TARGETS)} + 1] AS ok, CASE WHEN ends_with(regexp_extract(url, '://([^/?#:]*)', 1), '.example.org') THEN 'HOST_BLOCKLISTED' END AS own_code FROM pages",
)
def validate_target(spark, d):
    """Made addresses of all kinds, and each page's own with a site blocked."""
    url = F.element_at(F.array(*[F.lit(u) for u, _ in _TARGETS]), (F.col("page_id") % len(_TARGETS) + 1).cast("int"))
    made, own = web.validate_target(url, block=["bad.example"]), web.validate_target(F.col("url"), block=["example.org"])
    return table(spark, d, "pages").select("page_id", made.alias("v"), own.alias("o")).select("page_id", "v.code", "v.ok", F.col("o.code").alias("own_code"))


ROBOTS = """
# rules
User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Crawl-delay: 2

User-agent: reader
User-agent: other
Disallow: /en/
"""


@query(
    "robots_allowed",
    r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, page_id % 4 AS w FROM pages), q AS (SELECT page_id, CASE w WHEN 0 THEN '/private/x' WHEN 1 THEN '/private/open/y' WHEN 2 THEN path || '.pdf' ELSE path END AS path, w FROM p)
SELECT page_id, w IN (1, 3) AS allowed, CASE w WHEN 0 THEN 'Disallow: /private' WHEN 1 THEN 'Allow: /private/open' WHEN 2 THEN 'Disallow: /*.pdf$' END AS rule, 2::DOUBLE AS crawl_delay, '*' AS matched_agent FROM q""",
)
def robots_allowed(spark, d):
    rules = html.parse_robots(spark.createDataFrame([("o", ROBOTS)], "origin string, text string"))
    path, w = web.url_parts(F.col("url"))["path"], F.col("page_id") % 4
    asked = F.when(w == 0, "/private/x").when(w == 1, "/private/open/y").when(w == 2, F.concat(path, F.lit(".pdf"))).otherwise(path)
    return html.robots_allowed(table(spark, d, "pages").select("page_id", F.lit("o").alias("origin"), asked.alias("path")), rules).drop("origin", "path")


@query("robots_own_agent", r"SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) NOT LIKE '/en/%' AS allowed, 'reader' AS matched_agent FROM pages")
def robots_own_agent(spark, d):
    rules = html.parse_robots(spark.createDataFrame([("o", ROBOTS)], "origin string, text string"))
    return html.robots_allowed(table(spark, d, "pages").select("page_id", F.lit("o").alias("origin"), web.url_parts(F.col("url"))["path"].alias("path")), rules, "Reader").select("page_id", "allowed", "matched_agent")


@query(
    "filenames",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/?(?:[?#].*)?$', 1), ''), 'download') AS name FROM pages""",
)
def filenames(spark, d):
    return table(spark, d, "pages").select("page_id", web.filename_from_url(F.col("url")).alias("name"))


@query("redirects", "SELECT page_id, 'https://example.com/' || (page_id + least(10 - page_id % 10, 6)) AS final, CAST(least(10 - page_id % 10, 6) AS INTEGER) AS n_hops, 10 - page_id % 10 <= 5 AS ok FROM pages WHERE page_id % 10 <> 0")
def redirects(spark, d):
    p = table(spark, d, "pages").select("page_id")
    at = lambda c: F.concat(F.lit("https://example.com/"), c.cast("string"))
    # Page n leads to n + 1, and every tenth is an end.
    hops = p.select(F.explode(F.sequence(F.col("page_id"), F.col("page_id") + 10)).alias("n")).distinct().where("n % 10 != 0").select(at(F.col("n")).alias("url"), at(F.col("n") + 1).alias("location"))
    asked = p.where("page_id % 10 != 0").select("page_id", at(F.col("page_id")).alias("url"))
    return asked.join(html.follow_redirects(asked.select("url"), hops), "url").select("page_id", "final", "n_hops", "ok")


@query(
    "html_table_spans",
    """
WITH o AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT k AS page_id, CAST(r AS INTEGER) AS row, i AS col, CASE i WHEN 0 THEN 'all' WHEN 1 THEN o_orderkey || ' & ' || s ELSE format('{:,}', c) END AS text FROM o, (SELECT unnest([0, 1, 2]) AS i)
UNION ALL SELECT DISTINCT k, 0, i, CASE i WHEN 0 THEN 'Group' ELSE 'Order' END FROM o, (SELECT unnest([0, 1, 2]) AS i)""",
)
def html_table_spans(spark, d):
    return _statements(spark, d).select("page_id", "row", "col", "text")


@query("html_table_headers", "SELECT o_custkey AS page_id, 'Orders of ' || o_custkey AS title, 1 AS n_headers, CASE WHEN count(*) >= 2 THEN 2 ELSE 1 END AS spanned, CASE WHEN count(*) >= 2 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM orders GROUP BY o_custkey")
def html_table_headers(spark, d):
    return _statements(spark, d).select("page_id", "title", "n_headers", "spanned", F.round("confidence", 6).alias("confidence")).distinct()


_NOTE_TABLE = """
WITH o AS (SELECT o_custkey AS k, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
"""


def _note_tables(spark, d):
    """For every customer a table below the heading of a note, without any markup that tells its header."""
    o = table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderkey", f"format_number({CENTS}, 0) as c")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "c"))), lambda x: F.concat(F.lit("<tr><td>Order "), x["o_orderkey"].cast("string"), F.lit("</td><td>"), x["c"], F.lit("</td><td>"), x["c"], F.lit("</td></tr>")))
    made = o.groupBy("k").agg(rows.alias("rows"))
    page = F.concat(F.lit("<h2>Note "), (F.col("k") % 40 + 1).cast("string"), F.lit(": Orders in US$ millions</h2><table><tr><td></td><td>2011</td><td>2010</td></tr>"), F.array_join("rows", ""), F.lit("</table><table><tr><th>only</th></tr></table>"))
    return html.document_tables(made.select(F.col("k").alias("page_id"), page.alias("html")))


@query("document_tables", _NOTE_TABLE + "SELECT k || '-t0' AS table_id, 'Orders in US$ millions' AS title, CAST(k % 40 + 1 AS VARCHAR) AS note_ref, 'notes' AS section, 'US$ millions' AS units, 1 AS n_headers, 3 AS column_count, CAST(count(*) AS BIGINT) AS row_count FROM o GROUP BY k")
def document_tables(spark, d):
    """Years beside an empty corner tell the header; the table without a body is none."""
    return _note_tables(spark, d)["tables"].select("table_id", "title", "note_ref", "section", "units", "n_headers", "column_count", "row_count")


@query("document_cells", _NOTE_TABLE + "SELECT k || '-t0' AS table_id, CAST(r - 1 AS INTEGER) AS row, i AS col, CASE i WHEN 0 THEN 'Order ' || o_orderkey ELSE format('{:,}', c) END AS text FROM o, (SELECT unnest([0, 1, 2]) AS i)")
def document_cells(spark, d):
    return _note_tables(spark, d)["cells"]


def _statements(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey as page_id", "o_orderkey", "o_orderstatus as s", f"format_number({CENTS}, 0) as c")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "s", "c"))), lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.lit("<td rowspan=@>all</td>")).otherwise(F.lit("")), F.lit("<td>"), x["o_orderkey"].cast("string"), F.lit(" &amp; "), x["s"], F.lit("</td><td>"), x["c"], F.lit("</td></tr>")))
    made = o.groupBy("page_id").agg(rows.alias("rows")).select("page_id", F.concat(F.lit("<p>Orders of "), F.col("page_id").cast("string"), F.lit("</p><table><thead><tr><th>Group</th><th colspan=2>Order</th></tr></thead>"), F.replace(F.array_join("rows", ""), F.lit("@"), F.size("rows").cast("string")), F.lit("</table>")).alias("html"))
    return html.html_tables(made)
