from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridwright import sinks
from gridwright.operators import annotate, clean, combine, edits, headers, registry, reshape, verify
from gridwright.operators.extract import pages
from gridwright.operators.result import ROW
from gridwright.sources import grids, html, optical, workbooks
from gridwright.sources import registry as extractors
from gridwright.streaming import intake


def grid(spark, rows):
    head, *body = rows
    return spark.createDataFrame([(i, *r) for i, r in enumerate(body)], ", ".join([f"{ROW} long", *[f"`{h}` string" for h in head]]))


def rows(df, order=ROW):
    return [list(r)[1:] for r in df.orderBy(order).collect()]


def test_merge(spark):
    got = combine.merge({"a.csv": grid(spark, [["a", "b"], ["1", "2"]]), "b.csv": grid(spark, [["b", "c"], ["3", "4"]])})
    data = got.data.orderBy("_source", ROW).drop("_source", ROW)
    assert data.columns == ["source_file", "a", "b", "c"]
    assert [list(r) for r in data.collect()] == [["a.csv", "1", "2", ""], ["b.csv", "", "3", "4"]]


LEFT, RIGHT = [["code", "name"], ["A", "Alpha"], ["B", "Beta"], ["C", "Gamma"]], [["code", "amount"], ["A", "10"], ["B", "20"], ["D", "40"]]


@pytest.mark.parametrize(("how", "n"), [("left", 3), ("inner", 2), ("full", 4)])
def test_join(spark, how, n):
    got = combine.join(grid(spark, LEFT), grid(spark, RIGHT), "code", "code", how)
    data = [list(r)[2:] for r in combine.ordered(got.data).collect()]
    assert len(data) == n and got.audits["stats"].first()["out"] == n
    if how == "full":
        assert data[-1] == ["D", "", "40"]


def test_join_fanout_and_blank_keys(spark):
    got = combine.join(grid(spark, LEFT), grid(spark, [["code", "amount", "name"], ["A", "10", "x"], [" a", "11", "y"]]), "code", "code", "inner")
    s = got.audits["stats"].first()
    assert (s.fanout, s.dup_keys_right, s.matched) == (1, 1, 1)
    assert got.data.columns[2:] == ["code", "name", "amount", "name_right"]
    assert combine.join(grid(spark, [["k"], [""]]), grid(spark, [["k", "v"], [" ", "1"]]), "k", "k", "inner").data.count() == 1


def test_dedupe(spark):
    g = grid(spark, [["code", "amount"], ["A", "1"], ["a", "1"], ["B", "2"], ["A", "9"]])
    assert len(rows(clean.dedupe(g, ignore_case=True).data)) == 3
    assert rows(clean.dedupe(g, "code", ignore_case=True, keep="last").data) == [["B", "2"], ["A", "9"]]
    assert [r[-1] for r in rows(clean.dedupe(g, "code", loose=True, mode="flag").data)] == ["", "1", "", "1"]


WIDE = [["line", "2011", "2010"], ["Revenue", "100", "90"], ["Cost", "50", "45"]]


def test_reshape(spark):
    g = grid(spark, WIDE)
    long = reshape.melt(g).data
    assert long.count() == 4
    back = reshape.pivot(long.withColumn(ROW, F.col(ROW) * 10 + F.col("_col")).drop("_col"), "line").data
    assert back.columns[1:] == WIDE[0] and rows(back) == WIDE[1:]
    once = reshape.transpose(g)
    assert rows(reshape.transpose(once)) == WIDE[1:]
    turned = reshape.transpose_with_header(g)
    assert turned.columns[1:] == ["line", "Revenue", "Cost"] and rows(turned) == [["2011", "100", "50"], ["2010", "90", "45"]]


def test_pivot_collisions_and_gaps(spark):
    g = grid(spark, [["line", "period", "value"], ["Revenue", "2011", "100"], ["Revenue", "2011", "101"], ["Cost", "2010", "45"]])
    of = lambda how: rows(reshape.pivot(g, "line", "period", "value", how).data)
    assert of("first") == [["Revenue", "100", ""], ["Cost", "", "45"]] and of("last")[0] == ["Revenue", "101", ""] and of("concat")[0] == ["Revenue", "100 | 101", ""]
    (c,) = reshape.pivot(g, "line", "period", "value").audits["collisions"].collect()
    assert (c.kept, c.discarded) == ("100", "101")


def test_trim(spark):
    got = clean.trim_grid(grid(spark, [["a ", "b"], [" 1", "2"], ["", " "]]))
    assert got.data.columns == [ROW, "a", "b"] and rows(got.data) == [["1", "2"]]
    assert got.audits["changes"].count() == 2 and got.audits["removed_rows"].count() == 1
    assert clean.trim_grid(grid(spark, [["a", "column_2"], ["1", ""]]), drop_empty_columns=True).data.columns == [ROW, "a"]


RULES = "code: text, required, unique\namount: number, required, min=0\nperiod: date\nsegment: enum=upstream|downstream"


def test_schema(spark):
    rules, warnings = verify.parse_rules(RULES + "\nbad line\nx: odd")
    assert len(warnings) == 2 and len(rules) == 5
    g = grid(spark, [["code", "amount", "period", "segment"], ["A", "10", "2011-12-31", "upstream"], ["A", "x", "31/13/2011", "Downstream"], ["", "-5", "", "middle"]])
    got = verify.schema_check(g, rules[:4])
    assert got.data.count() == 6 and sorted(r.row for r in got.audits["bad_rows"].collect()) == [3, 4]
    assert rows(got.audits["passing"]) == [["A", "10", "2011-12-31", "upstream"]]
    assert verify.split_options(r"text, pattern=^\d{1,2}$") == ["text", r" pattern=^\d{1,2}$"]
    broken = verify.schema_check(g, [verify.Rule("code", pattern="(")])
    assert [r.row for r in broken.data.collect()] == [0] and broken.audits["bad_rows"].count() == 0


INVENTORY = [["Finished goods", "201,455"], ["Raw materials", "98,663"], ["Goods in transit", "42,000"], ["Total", "342,118"]]


def cells_of(spark, table):
    return spark.createDataFrame([("t", r, c, v) for r, row in enumerate(table) for c, v in enumerate(row)], "table_id string, row int, col int, text string")


@pytest.mark.parametrize(("printed", "said"), [("342,118", "2011: ok"), ("350,000", "2011: calc 342118 vs printed 350000 (diff -7882)")])
def test_check_totals(spark, printed, said):
    table = [*INVENTORY[:3], ["Total", printed]]
    labels = spark.createDataFrame([("t", 1, "2011")], "table_id string, col int, label string")
    (r,) = verify.check_totals(cells_of(spark, table), labels).collect()
    assert (r.row, r.check_total) == (3, said)


def plain_live(table):
    """The rule as one reads it, for a single column of numbers."""
    out, block, pending = [], [], []
    for r, (label, v) in enumerate(table):
        if not label.lower().startswith("total"):
            if v is not None:
                block.append(v)
            continue
        if v is None:
            continue
        if block:
            out.append((r, sum(block)))
            pending.append(v)
        elif pending:
            out.append((r, sum(pending)))
            pending = [v]
        block = []
    return out


def test_live_foot_against_plain(spark):
    import random

    rng = random.Random(1)
    for n in range(12):
        table = [(rng.choice(["Total", "Total", "item"]), rng.choice([None, 1, 2, 5, 9])) for _ in range(14)]
        cells = cells_of(spark, [[a, "" if b is None else str(b)] for a, b in table])
        assert sorted((r.row, r.computed) for r in verify.live_foot(cells).collect()) == plain_live(table), (n, table)


def test_annotate(spark):
    g = grid(spark, [["a"], ["1"]])
    got = annotate.stamp(g, {"source": "x.pdf", "page": "32", "note": ""})
    assert got.data.columns[1:] == ["source", "page", "a"]
    assert annotate.stamp(got.data, {"source": "y"}).warnings
    mapped = annotate.map_headers(grid(spark, [["Amount", "Acct. Code"], ["1", "A"]]), headers.parse_map("acct code = account_code")[0], ["account_code", "description"])
    assert mapped.data.columns[1:] == ["account_code", "description", "Amount"] and rows(mapped.data) == [["A", "", "1"]]


def test_edits(spark):
    c = cells_of(spark, [["a", "b"], ["1", "2"], ["3", "4"]])
    at = spark.createDataFrame([("t", 0)], "table_id string, row int")
    body, head = edits.promote_rows(c, c.limit(0), at)
    back, none = edits.demote_headers(body, head, at)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, c.collect())) and none.count() == 0


def test_headers():
    assert headers.unique_headers(["a", "A", "", "a"]) == ["a", "A_2", "column_3", "a_3"]
    assert headers.flat_headers([["", "2011", "2011"], ["", "2011", "GHS"]], 3) == ["row_label", "2011", "2011 GHS"]
    assert headers.resolve(["x", "2", "y"], "2, 3, y, nope") == ["2", "y"]


def test_tools():
    assert [t.id for t in registry.tools()][:2] == ["number-clean", "trim-whitespace"] and len(registry.tools()) == 12
    with pytest.raises(ValueError):
        registry.register(registry.Tool("number-clean", "clean", 1, None))
    assert extractors.pick("a.PDF").id == "pdf-text" and extractors.pick("x", "image/png").id == "image" and extractors.pick("a.bin") is None
    with pytest.raises(ValueError):
        extractors.extract(None, "a.bin")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("He said \"x\"", "12,442,697", ""), ("two\r\nlines", "", "é")], "a string, b string, c string").coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/x")
    assert sorted(map(tuple, grids.read_csv(spark, f"{tmp_path}/x").drop(ROW).collect())) == sorted(map(tuple, df.collect()))
    text = next((tmp_path / "x").glob("part-*")).read_bytes().decode()
    assert text.startswith('"a","b","c"\r\n"He said ""x""","12,442,697",""\r\n')
    files = spark.createDataFrame([("f", text), ("g", "x\n\n1,2")], "file string, content string")
    assert [(r.file, r.row, list(r.cells)) for r in grids.parse_csv(files).where("file = 'g'").collect()] == [("g", 0, ["x", ""]), ("g", 1, ["1", "2"])]


def test_rows_are_numbered_without_gaps(spark):
    got = grids.with_rows(spark.range(0, 1000, 1, 7).select(F.col("id").alias("v"))).collect()
    assert [r.v for r in sorted(got, key=lambda r: r[ROW])] == list(range(1000)) and [r[ROW] for r in got] == list(range(1000))


def test_html_tables(spark):
    page = '<h2>Note 5</h2><table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><th>2011</th><th>2010</th></tr><tr><td>x</td><td>1&nbsp;000</td><td>2</td></tr></table><table><tr><td><table><tr><td>i</td><td>j</td></tr></table></td></tr></table>'
    got = html.html_tables(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()
    first = {(r.row, r.col): r.text for r in got if r.title == "Note 5"}
    assert [[first[r, c] for c in range(3)] for r in range(3)] == [["A", "B", "B"], ["A", "2011", "2010"], ["x", "1 000", "2"]]
    assert {r.n_headers for r in got if r.title == "Note 5"} == {2} and {r.table_no for r in got} == {0, 1}
    assert html.expand_spans([[("a", 1, 3, False)], [("b", 1, 1, False)]], grow=True)[0] == [["a", ""], ["a", "b"], ["a", ""]]


def test_workbook_round_trip(spark, tmp_path):
    grid_ = [["Nation", "2011"], ["A & B", "1,500"], ["C", "2,500"]]
    (tmp_path / "b.xlsx").write_bytes(sinks.grids_to_workbook({"one.csv": grid_, "one.txt": grid_}))
    cells = workbooks.sheet_cells(spark, f"{tmp_path}/b.xlsx")
    assert {r.sheet for r in cells.collect()} == {"INDEX", "one", "one_2"}
    found = workbooks.sheet_tables(cells.where("sheet = 'one'"))
    assert sorted((r.row, r.col, r.text) for r in found["cells"].collect()) == [(r - 1, c, grid_[r][c]) for r in (1, 2) for c in (0, 1)]
    assert sinks.workbook_to_csvs("b.xlsx", (tmp_path / "b.xlsx").read_bytes())["b_one.csv"] == "\r\n".join('"' + '","'.join(r) + '"' for r in grid_)
    assert sinks.safe_sheet_name("a/b:c" * 20, set())[:6] == "a_b_ca" and len(sinks.safe_sheet_name("x" * 50, set())) == 31


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr>{cell("a", chr(60) + "w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr><w:tr>{cell("b")}{cell("c")}</w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "old.docx").write_bytes(b"\xd0\xcf not a zip")
    assert sorted((r.row, r.col, r.text) for r in workbooks.docx_tables(spark, str(tmp_path)).collect()) == [(0, 0, "a"), (0, 1, "a"), (1, 0, "b"), (1, 1, "c")]


def test_bundle():
    z = zipfile.ZipFile(io.BytesIO(sinks.bundle_bytes({"a.csv": "x"}, [{"file": "a.csv", "kind": "csv", "bytes": 1, "source": "", "page": "", "created": "t", "note": ""}], "t")))
    assert sorted(z.namelist()) == ["MANIFEST.csv", "a.csv", "manifest.json"]


def statement(figures=True):
    """A page laid out like a printed statement: caption, years, section headings, figures right-aligned."""
    out = []

    def put(y, text, x=None, right=None):
        for word in text.split(" ") if right is None else [text]:
            left = x if right is None else right - 5 * len(word)
            out.append((word, float(left), float(y), float(left + 5 * len(word)), float(y + 10)))
            if right is None:
                x = left + 5 * len(word) + 3

    put(60, "Statement of Financial Position", 50)
    put(74, "15. Inventories", 50)
    put(100, "2011", right=470)
    put(100, "2010", right=540)
    lines = [("Current assets", None, None), ("Finished goods", "201,455", "180,220"), ("Raw materials", "98,663", "84,556"), ("Goods in transit", "42,000", "34,000"), ("Total inventories", "342,118", "298,776")]
    for i, (label, a, b) in enumerate(lines * 3):
        put(116 + 14 * i, label, 50)
        if a:
            put(116 + 14 * i, a, right=470)
            put(116 + 14 * i, b, right=540)
    return out


def test_extraction(spark):
    """The stages one by one; the whole pipeline is held against SQL by the queries extracted_tables and extracted_cells."""
    from gridwright.operators.extract import grids as g
    from gridwright.operators.extract import lines as li

    words = spark.createDataFrame([("d", 1, i, *w) for i, w in enumerate(statement())], "doc_id string, page int, word_idx long, text string, x double, y double, x1 double, y1 double")
    raw = li.assign_lines(li.normalise_words(words)).persist()
    rows_, metrics = li.lines(raw).persist(), li.page_metrics(raw).persist()
    assert [r.text for r in rows_.orderBy("line").limit(2).collect()] == ["Statement of Financial Position", "15. Inventories"]
    cells = li.split_cells(raw, metrics).persist()
    grid = g.flagged(g.band_cells(cells, li.bands(rows_, metrics), metrics)).persist()
    good = grid.where("reason is null")
    (v,) = g.classify(good, metrics.select("doc_id", "page", "median_height")).collect()
    assert v.is_table and v.column_count == 3 and v.confidence > 0.8
    assert [r.n_headers for r in g.header_counts(good).collect()] == [1]
    table = {(r.row, r.col): r.text for r in good.collect()}
    assert [table[2, c] for c in range(3)] == ["Finished goods", "201,455", "180,220"] and [table[0, c] for c in range(3)] == ["", "2011", "2010"]
    assert [(r.number, r.title) for r in pages.note_headings(rows_).collect()] == [("15", "Inventories")]
    for df in (raw, rows_, metrics, cells, grid):
        df.unpersist()


def test_optical_words(spark):
    files = spark.createDataFrame([("d", b"x")], "doc_id string, content binary")
    words = optical.read_words(files, lambda d, c: [(1, "a", 10, 20, 30, 40, 90.0), (1, "b", 10, 20, 30, 40, 12.0)])
    placed = optical.to_page_space(words.selectExpr("*", "2.0 as scale", "100.0 as left", "0.0 as top")).collect()
    assert [(r.text, r.x, r.y1) for r in placed] == [("a", 105.0, 20.0)]
    assert optical.working_width(100) == 1600


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "in" / "big.pdf").write_bytes(b"z" * 5000)
    stream = intake.file_stream(spark, f"{tmp_path}/in")
    go = lambda: intake.run_available(intake.file_stream(spark, f"{tmp_path}/in"), lambda df: df.select("name", F.col("type.kind").alias("kind")), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp", 1000)
    assert stream.isStreaming
    go()
    (tmp_path / "in" / "c.xlsx").write_bytes(b"PK")
    go()
    assert sorted((r.name, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a.csv", "csv"), ("c.xlsx", "xlsx")]
    assert [r.length for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [5000]
