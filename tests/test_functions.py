from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwright.functions import numbers, text, web

NUMBERS = [
    ("12,442,697", 12442697.0, "12442697"), ("(1,234)", -1234.0, "-1234"), ("1234-", -1234.0, "-1234"), ("−1234", -1234.0, "-1234"), ("12.3%", 0.123, "0.123"), ("GH¢ 5,000", 5000.0, "5000"), ("GHS 5,000", 5000.0, "5000"),
    ("-", None, ""), ("–", None, ""), ("—", None, ""), ("1,234²", 1234.0, "1234"), ("1,234*", 1234.0, "1234"), ("Cash and cash equivalents", None, ""), ("12 442 697", 12442697.0, "12442697"), ("0", 0.0, "0"),
    ("1.234,56", 1234.56, "1234.56"), ("1.234.567", 1234567.0, "1234567"), ("12,34", 12.34, "12.34"), ("GH¢ (1,234)", None, ""), ("GHS5,000", None, ""), ("(-5)", 5.0, "5"), ("-5-", 5.0, "5"), ("1.234", 1.234, "1.234"),
    ("US$ 12", 12.0, "12"), ("(–)", None, ""), ("1,23,4", 1234.0, "1234"), (None, None, ""), ("  ", None, ""), ("£(5)", None, ""), ("(£5)", -5.0, "-5"), ("+7", 7.0, "7"), (" 1,234 ", 1234.0, "1234"), ("12'000", 12000.0, "12000"),
    ("Note 5", None, ""), (".5", 0.5, "0.5"), ("5.", 5.0, "5"), ("1,234.5.6", None, ""), ("0.1", 0.1, "0.1"),
]


def test_numbers(spark):
    rows = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NUMBERS)], "i int, raw string").select("i", numbers.parse_number(F.col("raw")).alias("p")).orderBy("i").collect()
    for (raw, value, clean), r in zip(NUMBERS, rows, strict=True):
        assert (r.p.value, r.p.clean, r.p.is_numeric) == (value, clean, value is not None), raw


def test_number_details(spark):
    raws = ["1,234²", "(–)", "-", "GHS 5", "12,34", "12.3%", "(abc)"]
    got = {r.raw: r.p for r in spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", numbers.parse_number(F.col("raw")).alias("p")).collect()}
    assert got["1,234²"].footnote == "²" and got["1,234²"].warnings
    assert got["(–)"].is_nil and got["(–)"].had_parens and not got["(–)"].is_negative
    assert got["-"].is_nil and got["GHS 5"].currency == "GHS" and got["12.3%"].is_percent
    assert got["12,34"].warnings == ['"12,34" read as European decimal']
    assert got["(abc)"].had_parens and not got["(abc)"].is_numeric


def test_fast_paths_agree_with_the_long_way(spark):
    """What the shortcuts say is what reading every cell in full says."""
    raws = [n[0] for n in NUMBERS if n[0]] + ["Total", "usd", "a-b", "x + y", "", "1", "1,000", "1.50", "GHC", "word word"]
    df = spark.createDataFrame([(x,) for x in raws], "raw string")
    short = [r.p for r in df.select(numbers.parse_number(F.col("raw")).alias("p")).collect()]
    plain, odd = numbers.PLAIN, numbers.ODD
    try:
        numbers.PLAIN, numbers.ODD = "^$a", "(?s)."
        full = [r.p for r in df.select(numbers._parse(F.col("raw")).alias("p")).collect()]
    finally:
        numbers.PLAIN, numbers.ODD = plain, odd
    assert short == full


@pytest.mark.parametrize(("label", "is_period"), [("2011", True), ("FY2011", True), ("2011/12", True), ("2011-2012", True), ("2010 restated", True), ("1899", False), ("20111", False), ("Note", False), (None, False)])
def test_periods(spark, label, is_period):
    assert spark.range(1).select(numbers.is_period_label(F.lit(label))).first()[0] is is_period


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_texts(spark):
    lit = F.lit
    assert one(spark, text.normalise_key(lit(" Acct. Code ")), text.to_snake(lit("Net profitAfter Tax")), text.clean_cell(lit(" a  b​\t"))) == ["acct code", "net_profit_after_tax", "a b"]
    assert one(spark, text.similarity(lit("Account Code"), lit("account_code")), text.similarity(lit("Amount (GHS)"), lit("amount")), text.similarity(lit(""), lit("x"))) == [1.0, 1.0, 0.0]
    assert one(spark, text.stamp_kind(lit("Page 3 of 4")), text.stamp_kind(lit("2011")), text.stamp_kind(lit("Inventories"))) == ["page-number", "page-number", None]
    assert one(spark, text.section_for(lit("NOTES TO THE ACCOUNTS")), text.section_for(lit("Statement of  cash flows")), text.section_for(lit("Corporate information"))) == ["notes", "statements", "front"]
    assert one(spark, text.detect_units(lit("All in GH¢'000")), text.detect_currency(lit("US$ 5")), text.period_label(lit("For the year ended 31 December 2011"))) == ["GH¢'000", "USD", "31 December 2011"]
    assert one(spark, text.looks_like_date(lit("31/12/2011")), text.looks_like_date(lit("31/13/2011")), text.looks_like_date(lit("5 march 2011")), text.looks_like_date(lit("2011"))) == [True, False, True, False]
    assert one(spark, text.filename_base(lit("My report (1).pdf")), text.filename_base(lit(None)), text.kind_from_name(lit("x_data.CSV"))) == ["My_report_1", "export", "machine csv (tidy/long)"]
    assert [tuple(x) if x else None for x in one(spark, *[text.note_heading(lit(t)) for t in ("15.  Inventories", "NOTE 15 - INVENTORIES", "15 1,234", "15 Revenue of the", "Total 15")])] == [("15", "Inventories"), ("15", "INVENTORIES"), None, None, None]


def test_numbers_shown(spark):
    lit = F.lit
    assert one(spark, numbers.format_bytes(lit(1536)), numbers.format_bytes(lit(20480)), numbers.format_bytes(lit(5)), numbers.format_bytes(lit(None))) == ["1.5 KB", "20 KB", "5 B", ""]
    assert one(spark, numbers.number_text(lit(0.1) + lit(0.2)), numbers.apply_scale(lit(1.234), 1000), numbers.apply_scale(lit(2.0), 1, 2), numbers.raster_scale(lit(300.0))) == ["0.3", "1234", "2.00", 4.0]
    assert one(spark, numbers.unit_scale(lit("US$ m")), numbers.unit_scale(lit("bn")), numbers.unit_scale(lit("x"))) == [1e6, 1e9, 1.0]


@pytest.mark.parametrize(
    ("host", "blocked"),
    [("localhost", True), ("127.0.0.1", True), ("10.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("169.254.169.254", True), ("8.8.8.8", False), ("256.1.1.1", True), ("0x7f000001", True), ("2130706433", True), ("a.internal", True), ("[::1]", True), ("fd00::1", True), ("::ffff:10.0.0.1", True), ("2001:db8::1", False), ("example.com", False), ("", True)],
)
def test_hosts(spark, host, blocked):
    assert one(spark, web.blocked_host(F.lit(host))) == [blocked]


def test_sniffing(spark):
    kind = lambda u, m: tuple(one(spark, web.sniff_kind(F.lit(u), F.lit(m)))[0])[:2]
    assert kind("https://e.org/a", "application/pdf") == ("pdf", "content-type")
    assert kind("https://e.org/a.xlsx", "application/octet-stream") == ("spreadsheet", "extension")
    assert kind("https://e.org/a.csv", "text/plain") == ("csv", "extension")
    assert kind("https://e.org/a", None) == ("unknown", "unknown")
