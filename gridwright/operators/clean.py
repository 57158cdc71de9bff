"""Cleaning grids: figures, blanks, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions import numbers, text
from gridwright.functions.core import let, text_of, trim_ws
from gridwright.storage import spread

from .headers import resolve
from .result import ROW, OpResult, columns_of


def changes(df: DataFrame, new: dict[str, Column], **more) -> DataFrame:
    """One row for each cell that new changes: row, column, raw, clean; more: name -> function of the raw cell, computed for changed cells only.

    explode_outer, as explode would have its argument computed once more by an inferred filter."""
    cells = [F.struct(F.lit(c).alias("column"), text_of(F.col(c)).alias("raw"), v.alias("clean")) for c, v in new.items()]
    long = df.select((F.col(ROW) + 1).alias("row"), F.explode_outer(F.array(*cells)).alias("x")).select("row", "x.*").where("raw != clean")
    return long.select("*", *[f(F.col("raw")).alias(n) for n, f in more.items()])


def number_clean(df: DataFrame, columns: str | None = None, factor: float = 1.0, decimals: int | None = None) -> OpResult:
    """Figures as plain text. In columns that were asked for, what isn't a figure is blanked; without any, only figures are rewritten."""
    names = columns_of(df)
    wanted = resolve(names, columns) if columns else []

    def cell(c: str) -> Column:
        raw = text_of(F.col(c))
        return F.when(trim_ws(raw) == "", raw).otherwise(let(numbers.parse_number(raw), lambda p: F.when(p["value"].isNotNull(), numbers.apply_scale(p["value"], factor, decimals)).otherwise(F.lit("") if wanted else raw)))

    new = {c: cell(c) for c in (wanted or names)}
    log = changes(df, new, notes=lambda c: numbers.describe(numbers.parse_number(c)))
    return OpResult(df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns]), {"changes": log})


def number_clean_lines(lines: DataFrame, factor: float = 1.0, decimals: int | None = None) -> DataFrame:
    """lines(_row, value) -> _row, raw, clean, value, notes; blank lines go."""
    raw = trim_ws(text_of(F.col("value")))
    parsed = lines.select(ROW, raw.alias("raw"), numbers.parse_number(raw).alias("p")).where("raw != ''")
    return parsed.select(ROW, "raw", numbers.apply_scale(F.col("p.value"), factor, decimals).alias("clean"), F.coalesce(numbers.number_text(F.col("p.value"), 15), F.lit("")).alias("value"), numbers.describe(F.col("p")).alias("notes"))


def trim_grid(df: DataFrame, trim: bool = True, collapse: bool = True, strip_invisible: bool = True, drop_empty_rows: bool = True, drop_empty_columns: bool = False, header_case: str = "off") -> OpResult:
    """Blanks out of every cell and header, then rows without any text, and on request columns without any, header included."""
    names = columns_of(df)
    new = {c: text.clean_cell(F.col(c), trim, collapse, strip_invisible) for c in names}
    out = df.select(ROW, *[v.alias(c) for c, v in new.items()])
    if drop_empty_rows:
        out = out.where(F.exists(F.array(*[F.col(c) for c in names]), lambda x: trim_ws(x) != ""))
    dropped: list[str] = []
    if drop_empty_columns and (unnamed := [c for c in names if not c.strip() or c.startswith("column_")]):
        seen = out.agg(*[F.max(F.col(c) != "").alias(f"c{i}") for i, c in enumerate(unnamed)]).first()
        dropped = [c for i, c in enumerate(unnamed) if not seen[i]]
        out = out.drop(*dropped)
    case = {"lower": str.lower, "snake": snake, "off": lambda c: c}[header_case]
    out = out.select(*[F.col(c).alias(c if c == ROW else case(" ".join(c.split()))) for c in out.columns])
    removed = df.select((F.col(ROW) + 1).alias("row"), F.exists(F.array(*list(new.values())), lambda x: trim_ws(x) != "").alias("kept")).where("not kept").select("row")
    return OpResult(out, {"changes": changes(df, new), "removed_rows": removed}, [f"dropped empty column {c}" for c in dropped])


def snake(name: str) -> str:
    import re

    s = re.sub("[^A-Za-z0-9]+", "_", re.sub("['\"]", "", name.strip()))
    return re.sub("([a-z0-9])([A-Z])", r"\1_\2", s).strip("_").lower()


def dedupe(df: DataFrame, key: str | list[str] | None = None, ignore_case: bool = False, ignore_whitespace: bool = False, loose: bool = False, keep: str = "first", mode: str = "remove") -> OpResult:
    """Rows with equal keys (all columns by default): removed but for the first or last, or flagged with the 1-based row they repeat.

    Keys are compared by 128 bits. First and last rows of keys that repeat come from partial aggregates and are joined back, so a key that most rows share, such as a blank one, meets in no one task."""
    names = columns_of(df)
    cols = resolve(names, key) if key else names
    text_key = text.row_key([F.col(f"`{c}`") for c in cols], ignore_case, ignore_whitespace, loose)
    hashes = lambda a, b: {a: F.xxhash64(text_key), b: F.xxhash64(F.lit(1), text_key)}
    kept = (F.min if keep == "first" else F.max)(ROW)
    repeated = df.select(ROW, *[v.alias(k) for k, v in hashes("_a", "_b").items()]).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min(ROW).alias("_first"), kept.alias("_kept")).where("_n > 1")
    marked = df.withColumns(hashes("_c", "_d")).join(spread(repeated), F.expr("_c = _a and _d = _b"), "left")
    groups = repeated.agg(F.count(F.lit(1)).alias("duplicate_groups"))
    if mode == "flag":
        repeat = F.when(F.col("_first").isNull() | (F.col(ROW) == F.col("_first")), "").otherwise((F.col("_first") + 1).cast("string"))
        return OpResult(marked.select(*df.columns, repeat.alias("duplicate_of_row")), {"groups": groups})
    goes = F.coalesce(F.col(ROW) != F.col("_kept"), F.lit(False))
    removed = marked.where(goes).select((F.col(ROW) + 1).alias("row"), (F.col("_kept") + 1).alias("kept_row"))
    return OpResult(marked.where(~goes).select(*df.columns), {"groups": groups, "removed": removed})


def rectangular(df: DataFrame, cells: str, width: int) -> DataFrame:
    """A grid from an array column of cells: as many string columns as width, '' where a row is short."""
    cell = lambda i: F.coalesce(F.get(F.col(cells), F.lit(i)), F.lit(""))
    return df.select(ROW, *[cell(i).alias(f"column_{i + 1}") for i in range(width)])


def grid_dims(df: DataFrame, cells: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(F.size(cells)), F.lit(0)).alias("n_columns"))


