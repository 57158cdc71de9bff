"""Helpers that every function module builds on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters: Java's \s is ASCII only, so the Unicode blanks and the byte-order mark are spelled out.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reusable(body):
    """body as a function of one Column whose expression is built once in a session: building thousands of nodes through the gateway takes longer than planning them. Falls back to let() where the lambda can't be kept, as on Connect."""
    kept: dict = {}

    def apply(value: Column) -> Column:
        try:
            from pyspark import SparkContext
            from pyspark.sql.classic.column import _to_seq
            from pyspark.sql.functions import builtin

            sc = SparkContext._active_spark_context
            if sc.applicationId not in kept:
                kept[sc.applicationId] = builtin._create_lambda(body)
            made = sc._jvm.PythonSQLUtils.fn("transform", _to_seq(sc, [F.array(value)._jc, kept[sc.applicationId]]))
            return F.element_at(Column(made), 1)
        except (AttributeError, ImportError, TypeError):
            return let(value, body)

    return apply


def text_of(value: Column) -> Column:
    """Cells are strings and never null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def trim_ws(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def collapse_ws(s: Column) -> Column:
    return F.regexp_replace(s, rf"[{WS}]+", " ")


def first_match(s: Column, patterns) -> Column:
    """The name of the first (pattern, name) that s matches, else null."""
    found = F.lit(None).cast("string")
    for pattern, name in reversed(list(patterns)):
        found = F.when(s.rlike(pattern), F.lit(name)).otherwise(found)
    return found
