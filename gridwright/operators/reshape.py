"""Wide to long, long to wide, and rows to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions.core import text_of, trim_ws

from .headers import resolve, unique_headers
from .result import ROW, OpResult, columns_of


#: What Spark and its readers bear as columns.
MAX_COLUMNS = 4096


def _bounded(df: DataFrame, what: str) -> list[str]:
    """The first column's values, which become columns."""
    found = [r[0] for r in df.limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} {what} would become columns")
    return found


def melt(df: DataFrame, ids: str | None = None, values: str | None = None, variable: str = "variable", value: str = "value", drop_blank: bool = True) -> OpResult:
    """One row for each value cell, in row-major order (_row, _col). Ids default to the first column, values to all others."""
    names = columns_of(df)
    id_cols = resolve(names, ids) if ids else names[:1]
    value_cols = [c for c in (resolve(names, values) if values else names) if c not in id_cols]
    cells = F.array(*[F.struct(F.lit(i).alias("_col"), F.lit(c).alias(variable), text_of(F.col(c)).alias(value)) for i, c in enumerate(value_cols)])
    long = df.select(ROW, *id_cols, F.explode(cells).alias("_x")).select(ROW, "_x._col", *id_cols, f"_x.{variable}", f"_x.{value}")
    blank = trim_ws(F.col(value)) == ""
    dropped = long.agg(F.count_if(blank).alias("dropped"))
    return OpResult(long.where(~blank) if drop_blank else long, {"dropped": dropped})


def pivot(df: DataFrame, ids: str | None = None, variable: str = "variable", value: str = "value", aggregate: str = "first", variables: list[str] | None = None) -> OpResult:
    """One row for each combination of ids, one column for each variable in first-seen order; '' where there is none. Cells that collide: first, last, or all joined by ' | '.

    Without variables, a first pass lists them; they become columns, so more than MAX_COLUMNS are an error. Cells and first rows come from one aggregation, so the table is shuffled once."""
    names = columns_of(df)
    variable, value = resolve(names, [variable])[0], resolve(names, [value])[0]
    id_cols = resolve(names, ids) if ids else [c for c in names if c not in (variable, value)]
    if variables is None:
        variables = _bounded(df.groupBy(text_of(F.col(variable)).alias("v")).agg(F.min(ROW).alias("f")).orderBy("f").select("v"), "variables")
    cell = text_of(F.col(value))

    def of(v: str) -> Column:
        mine = text_of(F.col(variable)) == v
        if aggregate == "concat":
            return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct(ROW, cell.alias("v"))))), lambda x: x["v"]), " | ")
        return (F.min_by if aggregate == "first" else F.max_by)(cell, F.when(mine, F.col(ROW)))

    header = unique_headers(id_cols + variables)[len(id_cols) :]
    wide = df.groupBy(*id_cols).agg(F.min(ROW).alias(ROW), *[of(v).alias(f"__{i}") for i, v in enumerate(variables)])
    out = wide.select(ROW, *id_cols, *[text_of(F.col(f"__{i}")).alias(n) for i, n in enumerate(header)])
    same = W.partitionBy(*id_cols, variable).orderBy(ROW)
    kept = (F.first(cell) if aggregate != "last" else F.last(cell)).over(same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nth = F.row_number().over(W.partitionBy(*id_cols, variable).orderBy(F.col(ROW).desc() if aggregate == "last" else F.col(ROW)))
    collisions = df.select(*id_cols, F.col(variable).alias("variable"), kept.alias("kept"), cell.alias("discarded"), nth.alias("_n")).where("_n > 1").drop("_n")
    return OpResult(out, {"collisions": collisions})


def transpose(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Columns to rows: _row numbers the old columns, c0, c1, ... are the old rows. Rows become columns, so there can't be many; n_rows saves counting them."""
    names = columns_of(df)
    n = df.count() if n_rows is None else n_rows
    if n > MAX_COLUMNS:
        raise ValueError(f"{n} rows would become columns; {MAX_COLUMNS} are the limit")
    cells = F.array(*[F.struct(F.lit(i).alias("c"), text_of(F.col(c)).alias("v")) for i, c in enumerate(names)])
    long = df.select(F.col(ROW).alias("r"), F.explode(cells).alias("x")).select("r", "x.c", "x.v")
    out = long.groupBy(F.col("c").cast("long").alias(ROW)).pivot("r", list(range(n))).agg(F.first("v"))
    return out.select(ROW, *[text_of(F.col(f"`{i}`")).alias(f"c{i}") for i in range(n)])


def transpose_with_header(df: DataFrame, corner: str | None = None) -> DataFrame:
    """The first column's cells become the header, the header the first column."""
    names = columns_of(df)
    labels = _bounded(df.select(text_of(F.col(names[0])).alias("v"), ROW).orderBy(ROW).select("v"), "rows")
    # At most MAX_COLUMNS rows, so numbering them in one task is no matter.
    rest = df.select(F.row_number().over(W.orderBy(ROW)).cast("long").alias("_n"), *names[1:]).withColumn(ROW, F.col("_n") - 1).drop("_n")
    flat = transpose(rest, len(labels))
    header = unique_headers([corner or names[0], *labels])
    named = F.get(F.array(*[F.lit(c) for c in names[1:]]), F.col(ROW).cast("int"))
    return flat.select(ROW, named.alias(header[0]), *[F.col(f"c{i}").alias(h) for i, h in enumerate(header[1:])])
