"""Checking grids: footed totals, declared schemas.

Long form throughout: cells(table_id, row, col, text), so that any number of tables are checked by
the same windows, partitioned by table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions import numbers, text
from gridwright.functions.core import let, text_of, trim_ws
from gridwright.storage import spread

from .headers import index_of, resolve
from .result import ROW, OpResult, columns_of

FOOT_TOLERANCE = 0.5


# Sums


def compare_totals(total: Column, expected: Column, tolerance: float = 0.0) -> Column:
    """struct(difference, status)"""
    d = total - expected
    hint = F.when(F.abs(d) % 9 == 0, "DOES NOT FOOT (difference divisible by 9 — often two transposed digits)").otherwise("DOES NOT FOOT")
    return F.struct(d.alias("difference"), F.when(expected.isNull(), "no expected total given").when(F.abs(d) <= tolerance, "FOOTS").otherwise(hint).alias("status"))


def sum_cells(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, sum, count, nils, skipped: nil cells are counted apart and harm no sum."""
    p = df.select(*keys, numbers.parse_number(F.col(value)).alias("p"))
    total = numbers.significant(F.coalesce(F.sum("p.value"), F.lit(0.0)), 12)
    return p.groupBy(*keys).agg(total.alias("sum"), F.count("p.value").alias("count"), F.count_if(F.col("p.is_nil")).alias("nils"), F.count_if(F.col("p.value").isNull() & ~F.col("p.is_nil") & (trim_ws(F.col("p.raw")) != "")).alias("skipped"))


def foot(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, count, sum, n_skipped: here a nil is skipped like any text. What was skipped is foot_skipped's."""
    p = _footed(df, value, *keys)
    return p.groupBy(*keys).agg(F.count("v").alias("count"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.count_if(F.col("v").isNull()).alias("n_skipped"))


def foot_skipped(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, index (the row's own), raw: filled cells that are no figures."""
    return _footed(df, value, *keys).where("v is null").select(*keys, F.col(ROW).alias("index"), "raw")


def _footed(df: DataFrame, value: str, *keys: str) -> DataFrame:
    raw = trim_ws(text_of(F.col(value)))
    return df.select(*keys, F.col(ROW), raw.alias("raw"), numbers.parse_number(raw)["value"].alias("v")).where("raw != ''")


def foot_lines(lines: DataFrame, expected: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """lines(_row, value) -> metric, value: six rows."""
    want = numbers.parse_number(F.lit(expected))["value"]
    shown = lambda v: F.coalesce(numbers.number_text(v, 15), F.lit(""))
    one = foot(lines, "value").select("count", "n_skipped", "sum", want.alias("expected")).withColumn("c", compare_totals(F.col("sum"), F.col("expected"), tolerance))
    rows = [
        ("values counted", F.col("count").cast("string")), ("values skipped (not numeric)", F.col("n_skipped").cast("string")), ("computed sum", shown(F.col("sum"))),
        ("expected total", shown(F.col("expected"))), ("difference", shown(F.col("c.difference"))), ("status", F.col("c.status")),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in rows])).alias("x")).select("x.*")


def foot_grid(df: DataFrame, columns: str | None = None, expected: str | None = None, tolerance: float = 0.0, total_row: bool = True) -> DataFrame:
    """column, values_counted, computed_sum, expected, difference, status, expected_source. The first row whose label reads like a total is left out of the sums and, with total_row, is what they are held against; later totals are data like any other. Without columns, those with enough figures."""
    names = columns_of(df)
    wanted = resolve(names, columns) if columns else []
    label = names[0]
    at = df.agg(F.min(F.when(text.is_total(F.col(label), text.TOTAL_LABEL), F.col(ROW))).alias("_at"), F.count(F.lit(1)).alias("_n"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), text_of(F.col(c)).alias("raw")) for i, c in enumerate(names) if not wanted or c in wanted]))
    # One row joins every other: the total's place.
    long = df.crossJoin(F.broadcast(at)).select(ROW, "_at", "_n", text_of(F.col(label)).alias("label"), cells.alias("x")).select(ROW, "_at", "_n", "label", "x.*").withColumn("p", numbers.parse_number(F.col("raw")))
    is_at = F.coalesce(F.col(ROW) == F.col("_at"), F.lit(False))
    body = F.when(~is_at, F.col("p.value"))
    typed = numbers.parse_number(F.lit(expected))["value"]
    printed = F.max(F.when(is_at, F.col("p.value")))
    found = F.max("_at").isNotNull()
    agg = long.groupBy("i", "column").agg(
        F.count(body).alias("n"), F.coalesce(F.sum(body), F.lit(0.0)).alias("sum"), F.max("_n").alias("rows"), found.alias("found"),
        (F.when(found, printed).otherwise(typed) if total_row else typed).alias("want"), F.max(F.when(is_at, F.col("label"))).alias("printed_label"),
    )
    if not wanted:
        data_rows = F.col("rows") - F.col("found").cast("int")
        agg = agg.where(F.col("n") >= F.greatest(F.lit(2), F.ceil(data_rows * 0.5)))
    source = F.when(F.lit(total_row) & F.col("found"), F.concat(F.lit('printed row "'), "printed_label", F.lit('"'))).when(typed.isNotNull(), "typed").otherwise("none")
    c = compare_totals(F.col("sum"), F.col("want"), tolerance)
    return agg.select("i", "column", F.col("n").alias("values_counted"), "sum", "want", c.alias("c"), source.alias("expected_source")).select("column", "values_counted", F.col("sum").alias("computed_sum"), F.col("want").alias("expected"), "c.difference", "c.status", "expected_source")


def figures(cells: DataFrame) -> DataFrame:
    """table_id, row, col, v, is_figure, is_big of filled cells beyond the label column. Figures are parsed here, once, by one scan."""
    p = cells.where("col >= 1").select("table_id", "row", "col", trim_ws(text_of(F.col("text"))).alias("t")).where("t != ''").withColumn("p", numbers.parse_number(F.col("t")))
    big = F.col("p.is_numeric") & ((F.abs("p.value") >= 1000) | F.col("t").contains("."))
    return p.select("table_id", "row", "col", F.col("p.value").alias("v"), (F.col("p.is_numeric") | F.col("p.is_nil")).alias("is_figure"), big.alias("is_big"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """table_id, col: beyond the label column, two filled cells or more, half of them figures, and one magnitude: 1000 or more, or with a point."""
    return _numeric(figures(cells))


def _numeric(parsed: DataFrame) -> DataFrame:
    figure, big = F.col("is_figure"), F.col("is_big")
    return parsed.groupBy("table_id", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(figure).alias("f"), F.count_if(big).alias("m")).where("n >= 2 and f * 2 >= n and m >= 1").select("table_id", "col")


def _labelled(cells: DataFrame, kind: str) -> DataFrame:
    """table_id, row, is_total: from the label column."""
    return cells.where("col = 0").select("table_id", "row", text.is_total(F.col("text"), kind).alias("is_total"))


def check_totals(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """table_id, row, check_total for every total row: each numeric column's sum over the rows since the total before, against what is printed. Sums of fewer than two figures say nothing; labels(table_id, col, label)."""
    upto = W.partitionBy("table_id").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    groups = _labelled(cells, text.TOTAL_IN_TABLE).withColumn("grp", F.coalesce(F.sum(F.col("is_total").cast("int")).over(upto), F.lit(0)))
    totals = groups.where("is_total")
    # Sums and what decides whether a column is numeric come from one pass: counts over the column are added up from those over its groups.
    parsed = figures(cells).join(groups, ["table_id", "row"])
    total = numbers.significant(F.coalesce(F.sum(F.when(~F.col("is_total"), F.col("v"))), F.lit(0.0)), 12)
    by = parsed.groupBy("table_id", "col", "grp").agg(
        total.alias("sum"), F.count(F.when(~F.col("is_total"), F.col("v"))).alias("n"), F.max(F.when(F.col("is_total"), F.col("v"))).alias("printed"),
        F.count(F.lit(1)).alias("_n"), F.count_if("is_figure").alias("_f"), F.count_if("is_big").alias("_m"),
    )
    column = W.partitionBy("table_id", "col")
    by = by.withColumns({c: F.sum(c).over(column) for c in ("_n", "_f", "_m")}).where("_n >= 2 and _f * 2 >= _n and _m >= 1")
    said = by.where("printed is not null and n >= 2").join(labels, ["table_id", "col"], "left").withColumn("diff", numbers.significant(F.col("sum") - F.col("printed"), 12))
    label, show = F.coalesce("label", F.concat(F.lit("column_"), F.col("col"))), lambda c: numbers.number_text(F.col(c), 15)
    part = F.when(F.abs("diff") < 0.005, F.concat(label, F.lit(": ok"))).otherwise(F.concat(label, F.lit(": calc "), show("sum"), F.lit(" vs printed "), show("printed"), F.lit(" (diff "), show("diff"), F.lit(")")))
    parts = said.select("table_id", "grp", F.struct("col", part.alias("s")).alias("p")).groupBy("table_id", "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), "; ").alias("check_total"))
    return totals.join(parts, ["table_id", "grp"], "left").select("table_id", "row", F.coalesce("check_total", F.lit("")).alias("check_total"))


def live_foot(cells: DataFrame, tolerance: float = FOOT_TOLERANCE) -> DataFrame:
    """table_id, row, col, printed, computed, delta, ok. A total that follows figures sums them; one that follows a total sums the totals pending since the last such grand total, itself included. Total rows without a figure in a column are passed over there."""
    p = cells.where("col >= 1").join(_labelled(cells, text.TOTAL_LIVE), ["table_id", "row"]).select("table_id", "row", "col", "is_total", numbers.parse_number(F.col("text"))["value"].alias("v")).where("v is not null")
    col = W.partitionBy("table_id", "col").orderBy("row")
    before = col.rowsBetween(W.unboundedPreceding, -1)
    marked = p.withColumns({"block": F.coalesce(F.sum(F.col("is_total").cast("int")).over(before), F.lit(0)), "n": F.count(F.lit(1)).over(W.partitionBy("table_id", "col"))}).where("n >= 2")
    blocks = marked.groupBy("table_id", "col", "block").agg(
        F.sum(F.when(~F.col("is_total"), F.col("v"))).alias("block_sum"), F.max(F.when(F.col("is_total"), F.col("row"))).alias("row"), F.max(F.when(F.col("is_total"), F.col("v"))).alias("printed")
    ).where("row is not null")
    # A total over an empty block is a grand one and starts the next segment of pending totals; it is pending there itself.
    segment = W.partitionBy("table_id", "col").orderBy("block")
    grand = F.col("block_sum").isNull()
    # Before any total is pending there is nothing to sum, and a grand total leaves nothing pending then either.
    opened = F.coalesce(F.max((~grand).cast("int")).over(segment.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    state = blocks.withColumns({"grand": grand, "opened": opened}).where("not grand or opened").withColumn("seg", F.sum(F.col("grand").cast("int")).over(segment.rowsBetween(W.unboundedPreceding, 0)))
    # For a grand total: what is pending is all printed since the last grand total, that one included.
    sums = state.groupBy("table_id", "col", "seg").agg(F.sum("printed").alias("pending"))
    looked = state.join(sums.withColumn("seg", F.col("seg") + 1), ["table_id", "col", "seg"], "left")
    computed = F.when(F.col("grand"), F.col("pending")).otherwise(F.col("block_sum"))
    three = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return looked.withColumn("c", computed).where("c is not null").select("table_id", "row", "col", "printed", three(F.col("c")).alias("computed"), three(F.col("printed") - F.col("c")).alias("delta"), (F.abs(three(F.col("printed") - F.col("c"))) <= tolerance).alias("ok"))


# Declared schemas

TYPES = ("any", "text", "number", "integer", "date", "boolean")


@dataclass
class Rule:
    column: str
    type: str = "any"
    required: bool = False
    unique: bool = False
    min: float | None = None
    max: float | None = None
    maxlen: int | None = None
    pattern: str | None = None
    enum: list[str] | None = None


_TOKENS = re.compile(r"\\.?|[][(){},]|[^][\\(){},]+", re.S)
_OPENS = {"]": "[", ")": "(", "}": "{"}


def split_options(options: str) -> list[str]:
    """Split at commas outside any brackets of a pattern. Tokens are escaped characters, brackets, commas, and what lies between; within a character class other brackets are plain."""
    depth = dict.fromkeys(_OPENS.values(), 0)
    parts = [""]
    for token in _TOKENS.findall(options):
        bracket = _OPENS.get(token, token)
        if bracket in depth and (bracket == "[" or not depth["["]):
            depth[bracket] = max(0, depth[bracket] + (1 if token == bracket else -1))
        if token == "," and not any(depth.values()):
            parts.append("")
        else:
            parts[-1] += token
    return [p for p in parts if p.strip()]


def parse_rules(spec: str) -> tuple[list[Rule], list[str]]:
    """Lines `column: type, required, unique, min=, max=, maxlen=, pattern=, enum=a|b`; # starts a comment. (rules, warnings)"""
    rules, warnings = [], []
    for line in (x.strip() for x in spec.splitlines()):
        if not line or line.startswith("#"):
            continue
        name, colon, rest = line.partition(":")
        if not colon:
            warnings.append(f'Ignored "{line}": a rule looks like column: type, required')
            continue
        rule = Rule(name.strip())
        for option in (o.strip() for o in split_options(rest)):
            key, eq, value = (x.strip() for x in option.partition("="))
            key = key.lower()
            if not eq and key in TYPES:
                rule.type = key
            elif not eq and key in ("required", "optional", "unique"):
                rule.required, rule.unique = (key == "required" if key != "unique" else rule.required), rule.unique or key == "unique"
            elif eq and key in ("min", "max"):
                setattr(rule, key, float(value))
            elif eq and key == "maxlen":
                rule.maxlen = int(float(value))
            elif eq and key == "pattern":
                rule.pattern = value
            elif eq and key == "enum":
                rule.enum = [v.strip() for v in value.split("|")]
            else:
                warnings.append(f'Ignored "{option}" in the rule for {rule.column}')
        rules.append(rule)
    return rules, warnings


def _plain(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


_ISSUE = "struct<column:string,message:string,value:string>"


def valid_pattern(spark, pattern: str) -> bool:
    """Whether the engine that will match the pattern can read it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except AttributeError:  # Connect has no JVM at hand
        try:
            re.compile(pattern)
            return True
        except re.error:
            return False
    except IllegalArgumentException:
        return False


def schema_check(df: DataFrame, rules: list[Rule], ordered: bool = False) -> OpResult:
    """data: issues (row, column, message, value), row 1 being the header; ordered: by row and column. A blank cell can only lack; text in a numeric rule ends that cell's checks. Audits: bad_rows, passing, annotated, stats; missing and extra columns are warnings.

    All rules are checked in one scan. A unique rule joins the first rows of values that repeat, which are found by partial aggregates, so a value that most rows share is no one task's business."""
    names = columns_of(df)
    spark = df.sparkSession
    warnings, bound, invalid, checks = [], [], [], []
    row = (F.col(ROW) + 2).cast("long")
    base = df
    for rule in rules:
        i = index_of(names, rule.column)
        if i < 0:
            warnings.append(f"missing column {rule.column}")
            continue
        if names[i] not in bound:
            bound.append(names[i])
        pattern = rule.pattern
        if pattern and not valid_pattern(spark, pattern):
            warnings.append(f'pattern "{pattern}" is not a valid regular expression')
            invalid.append((0, rule.column, f'pattern "{pattern}" is not a valid regular expression', ""))
            pattern = None
        first = None
        if rule.unique:
            first, base = f"__first{len(checks)}", _with_first_rows(base, names[i], rule, row, f"__first{len(checks)}")
        checks.append(_rule_issues(names[i], rule, pattern, first))
    found = spark.createDataFrame([], "row long, column string, message string, value string")
    if checks:
        # explode_outer, as explode would have the checks computed once more by an inferred filter.
        found = base.select(row.alias("row"), F.explode_outer(F.flatten(F.array(*checks))).alias("x")).where("x is not null").select("row", "x.*")
    if invalid:
        found = found.unionByName(spark.createDataFrame(invalid, "row long, column string, message string, value string"))
    warnings += [f"extra column {c}" for c in names if c not in bound]
    bad = found.where("row > 0").select("row").distinct()
    counts = found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"), F.count_if(F.col("row") > 0).alias("rows_with_issues"))
    # Two single rows.
    stats = df.agg(F.count(F.lit(1)).alias("rows_checked")).crossJoin(F.broadcast(counts)).withColumn("rules_applied", F.lit(len(bound)))
    passing = df.join(bad, F.col(ROW) + 2 == F.col("row"), "left_anti")
    noted = found.where("row > 0").groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "message"))), lambda x: F.concat_ws(": ", x["column"], x["message"])), "; ").alias("issues"))
    annotated = df.join(noted, F.col(ROW) + 2 == F.col("row"), "left").drop("row").withColumn("issues", F.coalesce("issues", F.lit("")))
    return OpResult(found.orderBy("row", "column") if ordered else found, {"bad_rows": bad, "passing": passing, "annotated": annotated, "stats": stats}, warnings)


def _cell(column: str, rule: Rule) -> tuple[Column, Column, Column]:
    """A cell as it is, without blanks around it, and whether a rule's checks go beyond its type."""
    raw = text_of(F.col(f"`{column}`"))
    value = trim_ws(raw)
    filled = value != ""
    return raw, value, filled & numbers.parse_number(raw)["value"].isNotNull() if rule.type in ("number", "integer") else filled


def _with_first_rows(df: DataFrame, column: str, rule: Rule, row: Column, name: str) -> DataFrame:
    """df with the first row that holds a cell's value, null where the value is in one row only."""
    _, value, checked = _cell(column, rule)
    v = F.lower(value)
    key = lambda a, b: [F.when(checked, F.xxhash64(v)).alias(a), F.when(checked, F.xxhash64(F.lit(1), v)).alias(b)]
    firsts = df.select(*key("__a", "__b"), row.alias("__row")).where("__a is not null").groupBy("__a", "__b").agg(F.min("__row").alias(name), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    c, d = key("__c", "__d")
    return df.withColumns({"__c": c, "__d": d}).join(spread(firsts), F.expr("__c = __a and __d = __b"), "left").drop("__a", "__b", "__c", "__d")


def _rule_issues(column: str, rule: Rule, pattern: str | None, first: str | None) -> Column:
    """What a rule finds in its column: an array of structs, null where there is nothing to say."""
    raw, value, _ = _cell(column, rule)
    numeric = rule.type in ("number", "integer")

    def of(cell: Column) -> Column:
        raw, value, p = cell["raw"], cell["value"], cell["p"]
        filled = value != ""
        checked = filled & p.isNotNull() if numeric else filled
        tests: list[tuple[Column, Column | str]] = []
        if numeric:
            tests.append((filled & p.isNull(), f"expected a {rule.type}, got text"))
            if rule.type == "integer":
                tests.append((checked & (p != F.floor(p)), "expected a whole number"))
            if rule.min is not None:
                tests.append((checked & (p < rule.min), f"below min={_plain(rule.min)}"))
            if rule.max is not None:
                tests.append((checked & (p > rule.max), f"above max={_plain(rule.max)}"))
        if rule.type == "date":
            tests.append((filled & ~text.looks_like_date(value), "not a recognisable date"))
        if rule.type == "boolean":
            tests.append((filled & ~value.rlike("(?i)^(true|false|yes|no|y|n|0|1)$"), "not a boolean"))
        if rule.enum:
            tests.append((checked & ~F.lower(value).isin(*[e.lower() for e in rule.enum]), f"not one of: {', '.join(rule.enum)}"))
        if pattern:
            tests.append((checked & ~value.rlike(pattern), f"does not match {rule.pattern}"))
        if rule.maxlen is not None:
            tests.append((checked & (F.length(value) > rule.maxlen), F.concat(F.lit(f"longer than maxlen={rule.maxlen} ("), F.length(value), F.lit(" chars)"))))
        if first:
            here = (F.col(ROW) + 2).cast("long")
            tests.append((checked & (here > F.col(first)), F.concat(F.lit("duplicate value, first seen at row "), F.col(first))))
        if rule.required:
            tests.append((~filled, "required value is empty"))
        said = lambda message: F.struct(F.lit(rule.column).alias("column"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.when(filled, raw).otherwise("").alias("value"))
        return F.array(*[F.when(test, said(message)) for test, message in tests]).cast(f"array<{_ISSUE}>")

    parsed = numbers.parse_number(raw)["value"] if numeric else F.lit(None).cast("double")
    return let(F.struct(raw.alias("raw"), value.alias("value"), parsed.alias("p")), of)


def validate_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, row, n_cells, column_count: rows that break the rectangle."""
    n = cells.groupBy("table_id", "row").agg(F.count(F.lit(1)).alias("n_cells"))
    return n.join(tables.select("table_id", "column_count"), "table_id").where("n_cells != column_count")
