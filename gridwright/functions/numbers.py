"""Figures as printed in statements, and what they say. Columns in, Columns out; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import WS, let, reusable, text_of, trim_ws

# The characters and tokens that printed figures are read by.
DASHES = "-‐‑‒–—―⁃−﹘﹣－"
CURRENCIES = (
    (r"(?iu)GH[¢C₵]", "GHS"),
    (r"(?i)\bGHS\b", "GHS"),
    (r"(?i)\bUSD\b|\bUS\$", "USD"),
    (r"(?i)\bGBP\b", "GBP"),
    (r"(?i)\bEUR\b", "EUR"),
    (r"(?i)\bNGN\b", "NGN"),
    (r"(?i)\bZAR\b", "ZAR"),
    ("₵", "GHS"),
    ("₦", "NGN"),
    (r"\$", "USD"),
    ("£", "GBP"),
    ("€", "EUR"),
    ("¥", "JPY"),
    ("¢", None),
)
FOOTNOTES = r"[*∗٭†‡§¶#]+\z|[¹²³\x{2070}-\x{2079}\x{1D43}-\x{1D62}]+\z"
SOFT_SEPARATORS = rf"[{WS}\x{{2007}}\x{{2009}}'’ʼ]"
PERIODS = (
    r"(?i)^(FY\s*)?(19|20)\d{2}$",
    r"^(19|20)\d{2}\s*[/-]\s*\d{2,4}$",
    r"(?i)^(19|20)\d{2}\s*(restated|audited|unaudited|actual|budget|proforma)$",
)
SCALES = ((r"billion|bn\b", 1e9), (r"million|'?000'?000|m\b", 1e6), (r"thousand|'?000\b", 1e3))

#: Cells that need no further reading: grouped or plain figures, and words without anything that a figure could hold.
PLAIN = r"^(\d{1,3}(,\d{3})+|\d+|\d+\.\d+)$"
ODD = rf"[{DASHES}\d%(+₵₦$£€¥¢]|(?iu)GHC|\b(GHS|USD|GBP|EUR|NGN|ZAR)\b"
NIL = rf"^[{DASHES}{WS}]+\z"
NUMBER = (
    "struct<raw:string,value:double,clean:string,is_numeric:boolean,is_negative:boolean,is_percent:boolean,"
    "had_parens:boolean,is_nil:boolean,currency:string,footnote:string,warnings:array<string>>"
)


def significant(value: Column, digits: int) -> Column:
    """value rounded to so many significant digits."""
    return F.when(value == 0, F.lit(0.0)).otherwise(F.format_string(f"%.{digits - 1}e", value).cast("double"))


def number_text(value: Column, digits: int = 12) -> Column:
    """Plain decimal text: whole numbers without a point, others to so many significant digits without trailing zeros."""
    whole = value.cast("decimal(38,0)").cast("string")
    exact = F.format_string(f"%.{digits - 1}e", value).cast("decimal(38,18)").cast("string")
    return F.when(value.isNull(), "").when((F.floor(value) == value) & (F.abs(value) < 1e21), whole).otherwise(F.regexp_replace(exact, r"\.?0+$", ""))


def _without_currency(s: Column) -> Column:
    """struct(code, s): tokens are taken out one kind after the other; the first that has a code names it."""
    state = F.struct(F.lit(None).cast("string").alias("code"), s.alias("s"))
    for pattern, code in CURRENCIES:
        state = _token(state, pattern, code)
    return F.when(s.rlike("[A-Za-z¢₵₦$£€¥]"), state).otherwise(F.struct(F.lit(None).cast("string").alias("code"), s.alias("s")))


def _token(state: Column, pattern: str, code: str | None) -> Column:
    named = F.lit(code).cast("string")
    return let(state, lambda x: F.struct(F.coalesce(x["code"], F.when(x["s"].rlike(pattern), named)).alias("code"), F.regexp_replace(x["s"], pattern, "").alias("s")))


def resolve_separators(s: Column) -> Column:
    """struct(s, warning): digits with at most a decimal point. Of comma and point the later one is the decimal mark; a lone comma is one only before one or two last digits."""
    both = s.contains(",") & s.contains(".")
    european = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    no_commas, no_points = F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit("."), F.lit(""))
    comma_once = lambda x: F.regexp_replace(x, "^([^,]*),", "$1.")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pair = lambda value, warning: F.struct(value.alias("s"), (F.lit(None) if warning is None else warning).cast("string").alias("warning"))
    points = F.length(s) - F.length(no_points)
    return (
        F.when(both & european, pair(comma_once(no_points), F.when(~s.rlike(r"^\d{1,3}(\.\d{3})*,\d+$"), say('ambiguous separators in "', s, '"; read as European decimal'))))
        .when(both, pair(no_commas, F.when(~s.rlike(r"^\d{1,3}(,\d{3})*\.\d+$"), say('ambiguous separators in "', s, '"; read as Anglo decimal'))))
        .when(s.rlike(r"^\d{1,3}(,\d{3})+$"), pair(no_commas, None))
        .when(s.rlike(r"^\d+,\d{1,2}$"), pair(comma_once(s), say('"', s, '" read as European decimal')))
        .when(s.contains(","), pair(no_commas, say('irregular comma grouping in "', s, '"; commas dropped')))
        .when(points > 1, pair(no_points, F.when(~s.rlike(r"^\d{1,3}(\.\d{3})+$"), say('irregular dot grouping in "', s, '"; dots dropped'))))
        .otherwise(pair(s, None))
    )


def parse_number(raw: Column) -> Column:
    """What a printed cell says, as a struct (NUMBER). A dash is nil: no value, not zero, not text.

    Parentheses negate and are looked for before currency tokens are; a sign mark toggles, so "(-5)" is 5; "1.234" is a decimal and "12,34" too, with a warning."""
    return _parsed(text_of(raw))


def _parse(original: Column) -> Column:
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    flag = lambda *names: [F.lit(n).alias(k) for k, n in names]

    def empty(nil: bool, parens: Column) -> Column:
        return F.struct(
            original.alias("raw"), F.lit(None).cast("double").alias("value"), F.lit("").alias("clean"), *flag(("is_numeric", False), ("is_negative", False), ("is_percent", False)),
            parens.alias("had_parens"), F.lit(nil).alias("is_nil"), text.alias("currency"), text.alias("footnote"), none.alias("warnings"),
        )

    def read(s: Column, parens: Column) -> Column:
        def priced(c: Column) -> Column:
            def unsigned(p: Column) -> Column:
                """p: struct(s, percent)"""
                foot = F.regexp_extract(p["s"], FOOTNOTES, 0)
                has_foot = (foot != "") & F.substring(p["s"], F.lit(1), F.length(p["s"]) - F.length(foot)).rlike(r"\d")
                body = trim_ws(F.when(has_foot, F.substring(p["s"], F.lit(1), F.length(p["s"]) - F.length(foot))).otherwise(p["s"]))
                note = F.when(has_foot, F.concat(F.lit('footnote marker "'), foot, F.lit('" stripped from "'), trim_ws(original), F.lit('"')))

                def signed(b: Column) -> Column:
                    back = (F.length(b) > 1) & b.rlike(rf"[{DASHES}]\z")
                    b1 = trim_ws(F.when(back, F.substring(b, F.lit(1), F.length(b) - 1)).otherwise(b))

                    def fronted(x: Column) -> Column:
                        front = x.rlike(rf"^[{DASHES}]")
                        b2 = F.when(front | x.startswith("+"), trim_ws(F.substring(x, F.lit(2), F.length(x)))).otherwise(x)
                        negative = parens.cast("int") + back.cast("int") + front.cast("int")
                        digits = F.regexp_replace(b2, SOFT_SEPARATORS, "")

                        def valued(d: Column) -> Column:
                            def done(r: Column) -> Column:
                                numeric = r["s"].rlike(r"^(\d*\.?\d+|\d+\.?\d*)$")
                                v = F.when(numeric, r["s"].try_cast("double"))
                                v = F.when(negative % 2 == 1, -v).otherwise(v)
                                v = F.when(p["percent"], significant(v / 100, 12)).otherwise(v)
                                warnings = F.filter(F.array(note, r["warning"]), lambda w: w.isNotNull())
                                return let(
                                    v,
                                    lambda v: F.struct(
                                        original.alias("raw"), v.alias("value"), number_text(v).alias("clean"), v.isNotNull().alias("is_numeric"), F.coalesce(v < 0, negative % 2 == 1).alias("is_negative"),
                                        p["percent"].alias("is_percent"), parens.alias("had_parens"), F.lit(False).alias("is_nil"), c["code"].alias("currency"), F.when(has_foot, foot).alias("footnote"), warnings.alias("warnings"),
                                    ),
                                )

                            plain = d.rlike(r"^[\d.,]+$") & d.rlike(r"\d")
                            return let(F.when(plain, resolve_separators(d)).otherwise(F.struct(F.lit("").alias("s"), text.alias("warning"))), done)

                        return let(digits, valued)

                    return let(b1, fronted)

                return let(body, signed)

            s1 = trim_ws(c["s"])
            percent = s1.rlike(rf"%[{WS}]*\z")
            return let(F.struct(F.when(percent, trim_ws(F.regexp_replace(s1, rf"%[{WS}]*\z", ""))).otherwise(s1).alias("s"), percent.alias("percent")), unsigned)

        return let(_without_currency(s), priced)

    def start(s: Column) -> Column:
        parens = s.rlike(r"^\([\s\S]*\)\z")
        inner = trim_ws(F.when(parens, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s))
        figure = F.replace(s, F.lit(","), F.lit("")).try_cast("double")
        simple = F.struct(
            original.alias("raw"), figure.alias("value"), number_text(figure).alias("clean"), F.lit(True).alias("is_numeric"), *flag(("is_negative", False), ("is_percent", False), ("had_parens", False), ("is_nil", False)),
            text.alias("currency"), text.alias("footnote"), none.alias("warnings"),
        )
        return (
            F.when(s.rlike(PLAIN), simple)
            .when((s == "") | ~s.rlike(ODD), empty(False, F.lit(False)))
            .when(s.rlike(NIL), empty(True, F.lit(False)))
            .otherwise(let(inner, lambda i: F.when(parens & ((i == "") | i.rlike(NIL)), empty(True, F.lit(True))).otherwise(read(i, parens))))
        )

    return let(trim_ws(original), start)


_parsed = reusable(_parse)


def is_numeric_cell(raw: Column) -> Column:
    return parse_number(raw)["is_numeric"]


def is_nil_cell(raw: Column) -> Column:
    return parse_number(raw)["is_nil"]


def is_figure_cell(raw: Column) -> Column:
    return let(parse_number(raw), lambda p: p["is_numeric"] | p["is_nil"])


def clean_value(raw: Column) -> Column:
    return parse_number(raw)["clean"]


def is_period_label(raw: Column) -> Column:
    s = trim_ws(text_of(raw))
    return s.rlike(PERIODS[0]) | s.rlike(PERIODS[1]) | s.rlike(PERIODS[2])


def unit_scale(label: Column) -> Column:
    s, scale = F.lower(text_of(label)), F.lit(1.0)
    for pattern, factor in reversed(SCALES):
        scale = F.when(s.rlike(pattern), factor).otherwise(scale)
    return scale


def scale_value(value: Column, units: Column) -> Column:
    return value * unit_scale(units)


def apply_scale(value: Column, factor: float, decimals: int | None = None) -> Column:
    """Text of value * factor: 15 significant digits, or a fixed number of decimals; empty for null."""
    scaled = value * F.lit(float(factor))
    return F.when(value.isNull(), "").otherwise(number_text(scaled, 15) if decimals is None else F.format_string(f"%.{decimals}f", scaled))


def round_foot(value: Column) -> Column:
    return significant(value, 15)


def describe(p: Column) -> Column:
    """Notes on a parsed number, joined by "; "."""
    return F.concat_ws(
        "; ",
        F.when(p["had_parens"], "parentheses negative"),
        F.when(p["is_percent"], "percent -> fraction"),
        F.when(p["is_negative"] & ~p["had_parens"], "negative"),
        F.when(F.size(p["warnings"]) > 0, F.array_join(p["warnings"], "; ")),
        F.when(p["value"].isNull() & (trim_ws(p["raw"]) != ""), "not numeric — left as text"),
    )


def coerce_numeric_reading(raw: Column) -> Column:
    """Letters that optical readers put for digits, as digits."""
    return F.translate(text_of(raw), "OolI|SB·•—–", "0011158..--")


def format_bytes(n: Column) -> Column:
    v = n.cast("double")
    kb, mb, gb = v / 1024, v / 1048576, v / 1073741824
    show = lambda size, unit: F.concat(F.when(size < 10, F.format_string("%.1f", size)).otherwise(F.floor(size + 0.5).cast("string")), F.lit(unit))
    return F.when(v.isNull() | (v < 0), "").when(v < 1024, F.concat(number_text(v), F.lit(" B"))).when(kb < 1024, show(kb, " KB")).when(mb < 1024, show(mb, " MB")).otherwise(show(gb, " GB"))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def raster_scale(dpi: Column) -> Column:
    """The scale a page is rendered at for a wanted resolution: dpi / 72, 2.5 at least and 4 at most."""
    return F.least(F.greatest(dpi / 72.0, F.lit(2.5)), F.lit(4.0))
