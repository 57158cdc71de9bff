"""Readers, discovery, bundles and optical pages, by round trips and plain versions."""

from __future__ import annotations

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright import sinks, storage
from gridwright.functions import text, web
from gridwright.operators import edits, reshape, verify
from gridwright.operators.extract import grids as g
from gridwright.operators.extract import lines as li
from gridwright.operators.extract import pages
from gridwright.operators.result import ROW
from gridwright.sources import grids, html, optical, registry, workbooks
from gridwright.streaming import intake

from .test_operators import statement


def table_of(found, ident):
    cells = {(r.row, r.col): r.text for r in found["cells"].where(F.col("table_id") == ident).collect()}
    return [[cells[r, c] for c in range(max(k[1] for k in cells) + 1)] for r in range(max(k[0] for k in cells) + 1)]


def test_readers_by_kind(spark, tmp_path):
    rows = [["Item", "2011", "2010"], ["Inventories", "1,500", "1,400"], ["Cash", "2,500", "2,600"]]
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook_bytes([("Positions", rows), ("_TM_x", [["Left", "Top"]]), ("Small", [["one"]])]))
    mark = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    (tmp_path / "b.html").write_text(f"<h3>15. Inventories in GH¢ thousands</h3><table>{mark}</table>", encoding="utf-8")
    found = registry.extract(spark, f"file://{tmp_path}/a.xlsx")
    (t,) = found["tables"].collect()
    assert t.confidence >= 0.75 and t.origin == "xlsx" and table_of(found, t.table_id) == rows[1:]
    assert sorted((r.sheet, r.warning) for r in found["skipped"].collect()) == [("Small", "skipped: no region large enough to be a table"), ("_TM_x", "skipped: a sheet of metadata")]
    found = registry.extract(spark, f"file://{tmp_path}/b.html")
    (t,) = found["tables"].collect()
    assert (t.note_ref, t.title, t.section, t.units, t.n_headers) == ("15", "Inventories in GH¢ thousands", "notes", "GH¢ thousands", 1)
    assert table_of(found, t.table_id) == rows[1:]
    with pytest.raises(ValueError, match="no reader"):
        registry.extract(spark, "scan.pdf")


def test_readers_from_outside(spark, tmp_path):
    """A text layer and an optical reader, given as functions: the same statement, the second trusted less."""
    words = statement()
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    plain = registry.pick("x.pdf")
    try:
        registry.use_reader("pdf-text", registry.words_reader(lambda name, content: [(1, *w, None) for w in words]))
        found = registry.extract(spark, f"file://{tmp_path}/x.pdf")
        (t,) = found["tables"].collect()
        assert (t.title, t.note_ref, t.section) == ("Inventories", "15", "notes") and t.confidence > 0.8
        doubtful = [(1, "2O1,455" if w[0] == "201,455" else w[0], *w[1:], 30.0 if w[0] == "84,556" else 95.0) for w in words]
        registry.use_reader("pdf-text", registry.words_reader(lambda name, content: doubtful, "pdf-ocr"))
        found = registry.extract(spark, f"file://{tmp_path}/x.pdf")
        (t,) = found["tables"].collect()
        assert t.origin == "pdf-ocr" and t.confidence <= 0.85 and t.warnings[-1] == pages.VERIFY
        assert '"2O1,455" may read 201,455' in t.warnings and 'low confidence figure "84,556"' in t.warnings
        assert "2O1,455" in {r.text for r in found["cells"].collect()}
        (p,) = found["pages"].collect()
        assert p.ocr_applied and p.mean_confidence > 90 and p.warning is None
    finally:
        registry.register(plain)


def test_word_files(spark, tmp_path):
    import zipfile

    row = lambda cells: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr>"
    rows = [["", "2011", "2010"], ["Cash", "1,200", "1,300"], ["Debt", "2,200", "2,300"]]
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl>' + "".join(map(row, rows)) + "</w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    found = registry.extract(spark, f"file://{tmp_path}/d.docx")
    (t,) = found["tables"].collect()
    assert (t.n_headers, t.column_count, t.row_count) == (1, 3, 2) and table_of(found, t.table_id) == rows[1:]


def test_image_regions_against_plain(spark):
    """Transforms multiplied up by hand: an image under two transforms, one after restore, one too small."""
    ops = [("save", []), ("transform", [2, 0, 0, 3, 10, 20]), ("transform", [50, 0, 0, 40, 1, 2]), ("paintImageXObject", []), ("restore", []), ("transform", [0, 100, -80, 0, 200, 300]), ("paintInlineImageXObject", []), ("transform", [0.1, 0, 0, 0.1, 0, 0]), ("paintImageXObject", [])]
    df = spark.createDataFrame([("d", 1, i, op, [float(a) for a in args], 842.0) for i, (op, args) in enumerate(ops)], "doc_id string, page int, at int, op string, args array<double>, page_height double").repartition(3)
    got = [(r.region, r.x, r.y, r.w, r.h) for r in optical.image_regions(df).orderBy("region").collect()]
    assert got == [(0, 12.0, 842 - 26 - 120, 100.0, 120.0), (1, 200.0, 842 - 300 - 80, 100.0, 80.0)]


def test_textless_regions_and_ocr_pages(spark):
    lines_ = spark.createDataFrame([("d", 1, 100.0, 110.0, 50.0, 300.0, "x" * 50)], "doc_id string, page int, top double, bottom double, x double, x1 double, text string")
    regions = spark.createDataFrame([("d", 1, 0, 40.0, 90.0, 300.0, 80.0), ("d", 1, 1, 40.0, 400.0, 300.0, 80.0), ("d", 1, 2, 40.0, 600.0, 30.0, 80.0), ("d", 2, 0, 0.0, 0.0, 99.0, 99.0)], "doc_id string, page int, region int, x double, y double, w double, h double")
    assert sorted((r.page, r.region) for r in pages.textless_regions(regions, lines_).collect()) == [(1, 1), (2, 0)]
    own = spark.createDataFrame([("d", 1, False, "a"), ("d", 2, True, "b")], "doc_id string, page int, needs_ocr boolean, text string")
    read = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y")], "doc_id string, page int, text string")
    assert sorted((r.page, r.text) for r in pages.merge_ocr(own, read).collect()) == [(1, "a"), (2, "y")]


def plain_lines(centers, tolerance):
    """Lines one word at a time, looked up from the latest."""
    lines_, of = [], []
    for c in centers:
        at = None
        for i in reversed(range(len(lines_))):
            mean = sum(lines_[i]) / len(lines_[i])
            if abs(mean - c) <= tolerance:
                at = i
                break
            if mean < c - 4 * tolerance:
                break
        if at is None:
            at = len(lines_)
            lines_.append([])
        lines_[at].append(c)
        of.append(at)
    means = [sum(x) / len(x) for x in lines_]
    rank = {i: r for r, i in enumerate(sorted(range(len(means)), key=lambda i: means[i]))}
    return [rank[i] for i in of]


def test_lines_against_plain():
    rng = random.Random(5)
    for _ in range(300):
        centers = sorted(rng.choice([10, 14, 28, 30, 33, 41, 42.5, 60]) + rng.choice([0, 0, 0, 0.5, -1, 2]) for _ in range(rng.randrange(1, 40)))
        if rng.random() < 0.5:  # taller words begin higher than their centre tells
            rng.shuffle(centers[: len(centers) // 2])
            i = rng.randrange(len(centers))
            centers[i:] = centers[i:][::-1]
        got, _ = li._line_numbers(np.array(centers, float), 4.5)
        assert got.tolist() == plain_lines(centers, 4.5)


def test_whole_groups_of_batches():
    import pyarrow as pa

    from gridwright.functions.arrow import whole_groups

    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.choice([1, 1, 2, 5, 17]) for _ in range(rng.randrange(1, 12))]
        rows = [(None if g_ % 3 == 0 else "ab"[g_ % 2], g_, i) for g_, n in enumerate(sizes) for i in range(n)]
        at, batches = 0, []
        while at < len(rows):
            n = rng.randrange(0, 6)
            part = rows[at : at + n]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["a", "b", "c"]))
            at += n
        got = [table.slice(lo, hi - lo).to_pylist() for table, bounds in whole_groups(batches, ["a", "b"]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        assert [len(x) for x in got] == sizes and [tuple(r.values()) for x in got for r in x] == rows


def test_lines_of_pages_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = spark.createDataFrame([(f"d{p % 3}" if p % 4 else None, p, i, f"w{i}", float(i % 5 * 30), float(i // 5 * 14), float(i % 5 * 30 + 20), float(i // 5 * 14 + 10)) for p in range(9) for i in range(5 * (p + 1))], "doc_id string, page int, word_idx long, text string, x double, y double, x1 double, y1 double").repartition(4)
        got = li.assign_lines(li.normalise_words(words)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == words.count() and all(r.line == r.word_idx // 5 and r.line_center == r.line * 14 + 5 for r in got)


def columns_of(cells):
    x, x1, figure = (np.array(v) for v in zip(*cells, strict=True))
    found = g.infer_columns(x.astype(float), x1.astype(float), figure, 10, 3)
    return list(zip(found.left.tolist(), found.right.tolist(), strict=True))


def test_two_columns_of_figures_in_one_span():
    """Right edges that gather at two places are two columns, unless a cell lies across or the gap is small."""
    figures = [(300 - 30 * (i % 2), 330, True) for i in range(4)] + [(339.9, 350.5, True) for i in range(4)]
    assert columns_of(figures) == [(270, 330), (339.9, 350.5)]
    assert len(columns_of([*figures, (280, 380, False)])) == 1
    assert len(columns_of([(300, 330, True)] * 4 + [(305, 345, True)] * 4)) == 1
    assert len(columns_of([(300, 330, True)] * 2 + [(305, 390, True)])) == 1
    assert columns_of([(50, 90, False), (60, 130, False), (145, 160, True)]) == [(50, 130), (145, 160)]


def plain_columns(cells, height, space):
    """Columns by a walk over sorted cells and lists of members."""
    gutter = max(height, 3 * space, 2)
    spans = []
    for x, x1, _ in sorted(cells):
        if spans and x - spans[-1][1] < gutter:
            spans[-1][1] = max(spans[-1][1], x1)
        else:
            spans.append([x, x1])
    found = []
    for left, right in spans:
        inside = [c for c in cells if c[0] >= left - 0.5 and c[1] <= right + 0.5]
        edges = sorted(c[1] for c in inside if c[2])
        sets = []
        for e in edges:
            if sets and e - sets[-1][-1] <= 0.6 * height:
                sets[-1].append(e)
            else:
                sets.append([e])
        sets = [s for s in sets if len(s) > 1] if len(edges) >= 4 else []
        start = left
        for a, b in zip(sets, sets[1:], strict=False):
            cut = (a[-1] + b[0]) / 2
            if b[0] - a[-1] >= 2 * height and not any(x < cut - 0.5 and x1 > cut + 0.5 for x, x1, _ in inside):
                found.append([start, cut, start])
                start = cut
        found.append([start, right, start])
    for _ in range(2):
        own = [[] for _ in found]
        for x, x1, f in cells:
            overlap = [min(x1, r) - max(x, left) for left, r, _ in found]
            best = overlap.index(max(overlap))
            if overlap[best] <= 0:
                far = [abs(a - (x1 if f else x)) for *_, a in found]
                best = far.index(min(far))
            own[best].append((x, x1, f))
        for column, members in zip(found, own, strict=True):
            if members:
                right = sum(f for *_, f in members) / len(members) >= 0.5
                column[:] = [min(c[0] for c in members), max(c[1] for c in members), sum(c[1] if right else c[0] for c in members) / len(members)]
    return [(a, b) for a, b, _ in found]


def test_columns_against_plain():
    rng = random.Random(14)
    for _ in range(300):
        edges = sorted(rng.sample(range(100, 600, 10), rng.randrange(1, 6)))
        cells = []
        for _ in range(rng.randrange(1, 30)):
            f = rng.random() < 0.6
            w = rng.randrange(5, 60)
            x1 = rng.choice(edges) + rng.choice([0, 0, 0, 1.5]) if f else rng.randrange(100, 600)
            cells.append((float(x1 - w), float(x1), f))
        assert columns_of(cells) == plain_columns(cells, 10, 3)


def plain_groups(text_):
    """Robots rules by a walk over lines with the state spelled out."""
    agents, running, found = [], False, {}
    for raw in text_.split("\n"):
        line = raw.partition("#")[0]
        if ":" not in line:
            continue
        field, _, value = line.partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            agents = list(dict.fromkeys([*agents, value.lower()])) if running else [value.lower()]
            running = True
            found.setdefault(value.lower(), ([], [], []))
        else:
            running = False
            for a in agents:
                if field in ("allow", "disallow", "crawl-delay"):
                    found[a][("allow", "disallow", "crawl-delay").index(field)].append(value)
    return found


def test_robots_against_plain(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["User-agent: *", "User-Agent: Reader", "user-agent: other # x", "Allow: /a", "Disallow: /b:c", "Disallow:", "Crawl-delay: 2", "Crawl-delay: soon", "Sitemap: https://x/y", "# note", "junk", ""]) for _ in range(rng.randrange(25))) for _ in range(60)]
    got = html.parse_robots(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "origin string, text string").repartition(4)).collect()
    want = {(str(i), a): g_ for i, t in enumerate(texts) for a, g_ in plain_groups(t).items()}
    assert {(r.origin, r.agent) for r in got} == set(want)
    for r in got:
        allow, disallow, delay = want[r.origin, r.agent]
        numbers = [float(x) for x in delay if x.isdigit()]
        assert (r.allow, r.disallow, r.crawl_delay) == (allow, disallow, numbers[-1] if numbers else None)


def test_discover_one_level(spark):
    """A seed's index page is read too; links count once; closed pages are not read unless that is overridden."""
    page = lambda *links: "".join(f'<a href="{u}">{t}</a>' for u, t in links)
    web_ = [
        (1, "https://a.com/", page(("/reports/", "Reports"), ("/x.pdf", "X"), ("https://b.com/reports/", "other site"))),
        (2, "https://a.com/reports/", page(("/x.pdf", "again"), ("../y.xlsx#s", "Y"), ("/reports/deeper/", "Reports"))),
        (3, "https://a.com/reports/deeper/", page(("/z.pdf", "too deep"))),
        (4, "https://a.com/private/", page(("/secret.pdf", "S"))),
    ]
    df = spark.createDataFrame(web_, "page_id long, url string, html string")
    robots = html.parse_robots(spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /private\nCrawl-delay: 3")], "origin string, text string"))
    seeds = spark.createDataFrame([(1,), (4,)], "page_id long")
    found = html.discover(df, seeds=seeds, robots=robots, crawl=True)
    assert sorted((r.page_id, r.url, r.label, r.page_url) for r in found["documents"].collect()) == [(1, "https://a.com/x.pdf", "X", "https://a.com/"), (1, "https://a.com/y.xlsx", "Y", "https://a.com/reports/")]
    assert [(r.page_id, r.rule, r.crawl_delay) for r in found["blocked"].collect()] == [(4, "Disallow: /private", 3.0)]
    assert {r.url for r in html.discover(df, seeds=seeds, robots=robots)["documents"].collect()} == {"https://a.com/x.pdf"}
    assert {r.url for r in html.discover(df, seeds=seeds, robots=robots, override=True)["documents"].collect()} == {"https://a.com/x.pdf", "https://a.com/secret.pdf"}


def test_addresses(spark):
    ask = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert ask(web.proxy_url("https://p.workers.dev", F.lit("https://x.com/a b"))) == "https://p.workers.dev?url=https%3A%2F%2Fx.com%2Fa%20b"
    assert ask(web.proxy_url("https://p.workers.dev/?k=1", F.lit("https://x.com/"), {"range": "bytes=0-0"})) == "https://p.workers.dev/?k=1&url=https%3A%2F%2Fx.com%2F&range=bytes%3D0-0"
    assert ask(web.proxy_url("https://p.dev", F.lit("a!~*'()-_.é"))) == "https://p.dev?url=a!~*'()-_.%C3%A9"
    for base in ("", "not a url"):
        with pytest.raises(ValueError, match="proxy"):
            web.proxy_url(base, F.lit("x"))
    hosts = {"8.8.8.8": False, "10.0.0.1": True, "11.0.0.1": False, "172.31.255.255": True, "172.32.0.1": False, "192.0.2.1": True, "192.169.0.1": False, "198.19.1.1": True, "198.20.1.1": False, "224.0.0.1": True, "999.1.1.1": True, "[fe80::1]": True, "[fec0::1]": False, "[fd12::1]": True, "fd12": True, "[2001:db8::1]": False, "::1": True, "::": True, "0x7f000001": True, "a.local": True, "local.com": False, "localhost.": True, "::ffff:10.0.0.1": True, "[g::1]": True}
    df = spark.createDataFrame(list(hosts.items()), "h string, want boolean")
    assert [(r.h, r.got) for r in df.withColumn("got", web.blocked_host(F.col("h"))).collect()] == list(hosts.items())
    assert ask(web.is_html(F.lit("text/html; charset=x"))) and not ask(web.is_html(F.lit("application/pdf")))


def test_fetched_files(spark):
    r = spark.createDataFrame([("https://x.com/a", "application/pdf; q=1", b"1"), ("https://x.com/b.csv", None, b"2")], "url string, content_type string, content binary")
    assert [(x.name, x.mime) for x in html.fetched_files(r).orderBy("url").collect()] == [("a.pdf", "application/pdf"), ("b.csv", "application/octet-stream")]


def test_bundle(spark, tmp_path):
    """All files of an export, read back: every cell as it was, notes in order, only selected tables."""
    tables = spark.createDataFrame(
        [("t1", "Annual 2011.pdf", 3, "pdf-text", "statements", None, "Position", "GHS", 2, 3, 0.9, ["a"], True), ("t2", "Annual 2011.pdf", 4, "pdf-text", "notes", "10", "Ten", "GHS", 2, 1, 0.9, [], True), ("t3", "Annual 2011.pdf", 4, "pdf-text", "notes", "9", "Nine", "", 2, 1, 0.9, [], None), ("t4", "Annual 2011.pdf", 4, "pdf-text", "notes", "8", "Left out", "", 2, 1, 0.9, [], False), ("t5", "b.pdf", 1, "pdf-text", "other", None, 'Say "x"', "", 2, 1, 0.9, [], True)],
        "table_id string, source_file string, page int, origin string, section string, note_ref string, title string, units string, column_count int, row_count int, confidence double, warnings array<string>, selected boolean",
    )
    data = {"t1": [["Cash", "1,000"], ["Debt, \"net\"", "(2,000)"], ["Total", "-1,000"]], "t2": [["x", "5"]], "t3": [["y", "–"]], "t4": [["z", "7"]], "t5": [["line", "1\n2"]]}
    cells = spark.createDataFrame([(t, r, c, v) for t, rows in data.items() for r, row in enumerate(rows) for c, v in enumerate(row)], "table_id string, row int, col int, text string")
    labels = spark.createDataFrame([(t, c, x) for t in data for c, x in enumerate(("item", "2011"))], "table_id string, col int, label string")
    lines_ = sinks.bundle_lines(tables, cells, labels)
    files = {}
    for r in lines_.orderBy("file", "at").collect():
        files.setdefault(r.file, []).append(r.line)
    read = {n: list(csv.reader(io.StringIO("\r\n".join(x), newline=""))) for n, x in files.items()}
    assert sorted(read) == ["Annual_2011_data.csv", "Annual_2011_index.csv", "Annual_2011_notes.csv", "Annual_2011_p3_t1_review.csv", "Annual_2011_p4_t1_review.csv", "Annual_2011_p4_t2_review.csv", "b_data.csv", "b_index.csv", "b_p1_t1_review.csv"]
    assert read["Annual_2011_data.csv"][0] == sinks.MACHINE and [r[6:9] for r in read["Annual_2011_data.csv"][1:]] == [["Cash", "2011", "1000"], ['Debt, "net"', "2011", "-2000"], ["Total", "2011", "-1000"], ["x", "2011", "5"], ["y", "2011", ""]]
    assert [r[2:4] for r in read["Annual_2011_notes.csv"]] == [["note_ref", "note_title"], ["9", "Nine"], ["10", "Ten"]]
    assert read["Annual_2011_p3_t1_review.csv"] == [["source_file", "page", "item", "2011", "check_total"], ["Annual 2011.pdf", "3", "Cash", "1,000", ""], ["Annual 2011.pdf", "3", 'Debt, "net"', "(2,000)", ""], ["Annual 2011.pdf", "3", "Total", "-1,000", "2011: ok"]]
    assert read["b_p1_t1_review.csv"][1][3] == "1\n2" and read["b_index.csv"][1][6] == 'Say "x"'
    sinks.write_bundle(lines_, f"file://{tmp_path}/out")
    folder = tmp_path / "out" / "file=Annual_2011_data.csv"
    whole = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert list(csv.reader(io.StringIO(whole, newline=""))) == read["Annual_2011_data.csv"]


def test_one_bad_file_leaves_the_others(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(7):
        (tmp_path / "in" / f"f{i}.csv").write_bytes(b"bad" if i == 4 else b"x,y\n1,2\n")

    def handle(df):
        return df.select("name", F.when(F.decode("content", "UTF-8") == "bad", F.raise_error(F.lit("cannot read this"))).otherwise(F.length("content").cast("string")).alias("n"))

    intake.run_available(intake.file_stream(spark, f"{tmp_path}/in"), handle, f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp")
    assert sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [f"f{i}.csv" for i in range(7) if i != 4]
    (r,) = spark.read.parquet(f"{tmp_path}/bad").collect()
    assert r.path.endswith("f4.csv") and "cannot read this" in r.reason


def test_queue(spark):
    queue = spark.createDataFrame([], "path string, name string, length long, kind string, status string, note string")
    files = spark.createDataFrame([("/a.pdf", "a.pdf", 1), ("/b.bin", "b.bin", 2), ("/a.pdf", "a.pdf", 1)], "path string, name string, length long")
    queue = intake.add_files(queue, files)
    queue = intake.add_files(queue, files)
    assert sorted((r.path, r.kind, r.status) for r in queue.collect()) == [("/a.pdf", "pdf", "pending"), ("/b.bin", "unknown", "skipped")]
    queue = intake.update_files(queue, spark.createDataFrame([("/a.pdf", "done", None)], "path string, status string, note string"))
    assert [r.status for r in queue.where("path = '/a.pdf'").collect()] == ["done"] and intake.pending(queue).count() == 0
    assert [r.path for r in intake.remove_files(queue, spark.createDataFrame([("/b.bin",)], "path string")).collect()] == ["/a.pdf"]


def test_csv_large_and_small(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,A,\r\n1,"x\n""y""",3\r\n,,\r\n4,5,6\r\n')
    got = grids.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert got.columns == [ROW, "a", "A_2", "column_3"] and [tuple(r) for r in got.orderBy(ROW).collect()] == [(0, "1", 'x\n"y"', "3"), (1, "4", "5", "6")]
    (tmp_path / "big").mkdir()
    for k in range(3):
        (tmp_path / "big" / f"{k}.csv").write_text("n,v\n" + "\n".join(f"{k},{i}" for i in range(500)))
    got = grids.read_csv(spark, f"file://{tmp_path}/big", multiline=False)
    assert sorted(r[0] for r in got.select(ROW).collect()) == list(range(1500))


def test_scale_helpers(spark):
    """Numbering within hot groups, and limits on what becomes columns."""
    rows = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.col("id"))
    got = storage.numbered(rows, "g", "id", "n").collect()
    want = {}
    for i in range(5000):
        want.setdefault("hot" if i % 10 else f"g{i % 7}", []).append(i)
    assert {(r.g, r.id): r.n for r in got} == {(k, i): n for k, x in want.items() for n, i in enumerate(x, 1)}
    wide = spark.range(5000).select(F.col("id").alias(ROW), F.col("id").cast("string").alias("name"), F.lit("x").alias("v"))
    with pytest.raises(ValueError, match="become columns"):
        reshape.pivot(wide.withColumn("k", F.lit("1")), "k", "name", "v")
    with pytest.raises(ValueError, match="become columns"):
        reshape.transpose_with_header(wide)


def test_schema_in_one_scan(spark):
    rows = [(0, "A", "1"), (1, "a ", "x"), (2, "", ""), (3, "b", "1.5"), (4, "B", "-3"), (5, "c", "(2)")]
    df = spark.createDataFrame(rows, f"{ROW} long, code string, n string")
    got = verify.schema_check(df, verify.parse_rules("code: required, unique, pattern=^[A-Za-z ]+$\nn: integer, min=-2\nnone: text")[0], ordered=True)
    assert [tuple(r) for r in got.data.collect()] == [
        (3, "code", "duplicate value, first seen at row 2", "a "), (3, "n", "expected a integer, got text", "x"), (4, "code", "required value is empty", ""), (5, "n", "expected a whole number", "1.5"), (6, "code", "duplicate value, first seen at row 5", "B"), (6, "n", "below min=-2", "-3"),
    ]
    assert got.warnings == ["missing column none"]
    assert got.audits["stats"].first().asDict() == {"rows_checked": 6, "issue_count": 6, "rows_with_issues": 4, "rules_applied": 2}
    broken = verify.schema_check(df, [verify.Rule("code", pattern="(?<x>a"), verify.Rule("n", pattern=r"\p{L}+")])  # a Java pattern that Python doesn't know is fine
    assert len(broken.warnings) == 1 and sorted(r.message for r in broken.data.where("row > 0").collect())[0] == r"does not match \p{L}+"


def test_skipped_lines_are_listed_apart(spark):
    df = spark.createDataFrame([(0, "1,000"), (1, "-"), (2, "x"), (3, " "), (4, "2")], f"{ROW} long, value string")
    assert verify.foot(df, "value").first().asDict() == {"count": 2, "sum": 1002.0, "n_skipped": 2}
    assert sorted(tuple(r) for r in verify.foot_skipped(df, "value").collect()) == [(1, "-"), (2, "x")]


def test_rectangles(spark):
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 0, 1, "b"), ("t", 1, 0, "c")], "table_id string, row int, col int, text string")
    assert [tuple(r) for r in verify.validate_tables(cells, spark.createDataFrame([("t", 2)], "table_id string, column_count int")).collect()] == [("t", 1, 1, 2)]


def test_defaults_of_tables(spark):
    (r,) = edits.with_defaults(spark.createDataFrame([("t", 1.4, None)], "table_id string, confidence double, title string")).collect()
    assert (r.title, r.section, r.units, r.origin, r.confidence, r.selected) == ("", "other", "", "unknown", 1.0, True)


def test_looks_at_grids(spark):
    grid = spark.range(100).select(F.col("id").alias(ROW), *[F.lit("x").alias(f"c{i}") for i in range(50)]).repartition(5)
    shown, rows, columns = edits.preview(grid)
    assert (rows, columns) == (20, 10) and len(shown.columns) == 41 and [r[0] for r in shown.collect()] == list(range(80))
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 1, 2, "b")], "table_id string, row int, col int, text string")
    none = spark.createDataFrame([], "table_id string, row int, col int, text string")
    got = edits.to_grid(cells, none, "t").orderBy(ROW)
    assert got.columns == [ROW, "row_label", "column_1", "column_2"] and [tuple(r) for r in got.collect()] == [(0, "a", "", ""), (1, "", "", "b")]


def test_labels_and_markup(spark):
    ask = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert ask(text.markup_text(F.lit("<p>a <b>b</b>\n</p>c"))) == "a b c"
    assert ask(text.note_heading(F.lit("Note 7 – Trade and other receivables."))).asDict() == {"number": "7", "title": "Trade and other receivables"}
    assert ask(text.note_heading(F.lit("12. Cash and"))) is None and ask(text.note_heading(F.lit("100. Cash"))) is None and ask(text.note_heading(F.lit("31 December 2011"))).number == "31"
    assert ask(text.detect_currency(F.lit("in ₵ and $"))) == "GHS" and ask(text.detect_currency(F.lit("none"))) is None
    assert ask(text.period_label(F.lit("for the year ended 31 December 2011"))) == "31 December 2011" and ask(text.period_label(F.lit("as at 1 May 2010"))) == "1 May 2010"


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"
        getConf = spark.sparkContext.getConf

    class Session:
        conf = spark.conf
        sparkContext = Cluster()

    conf = {"spark.checkpoint.dir": None}
    monkeypatch.setattr(Session, "conf", type("Conf", (), {"get": staticmethod(lambda k, d=None: conf.get(k, d))})())
    monkeypatch.setattr(Cluster, "getConf", lambda self: Session.conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Cluster.master = "local[2]"
    assert storage.shared_dir(Session()).startswith("file://")
    conf["spark.checkpoint.dir"] = "hdfs://named/folder/"
    Cluster.master = "yarn"
    assert storage.shared_dir(Session()).startswith("hdfs://named/folder/gridwright-")


def test_workbook_sheets_of_many_books(spark):
    cells = spark.createDataFrame([(f"b{b}", "S", 1, r, c, str(1000 * r + c) if r else f"h{c}") for b in range(3) for r in range(4) for c in range(3)], "file string, sheet string, sheet_no int, r int, c int, text string")
    found = workbooks.sheet_tables(cells)
    assert sorted((r.file, r.n_headers, r.row_count) for r in found["tables"].collect()) == [(f"b{b}", 1, 4) for b in range(3)]
