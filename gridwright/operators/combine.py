"""Putting grids together: union by header, audited joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.core import collapse_ws, text_of, trim_ws
from gridwright.functions.text import normalise_key as key_of
from gridwright.storage import spread

from .headers import normalise_key, resolve, unique_headers
from .result import ROW, OpResult, columns_of


def merge(sources: dict[str, DataFrame], source_column: str | None = "source_file", exact: bool = False) -> OpResult:
    """Union by header. Headers that agree (normalised, or exactly) are one column under the first spelling; of headers that repeat inside a source the first counts; what a source lacks is ''."""
    form = (lambda h: h.strip()) if exact else normalise_key
    labels: dict[str, str] = {}
    for df in sources.values():
        for c in columns_of(df):
            labels.setdefault(form(c), c)
    order = unique_headers(list(labels.values()))
    name_of = dict(zip(labels, order, strict=True))
    parts, report = None, []
    spark = next(iter(sources.values())).sparkSession
    for i, (name, df) in enumerate(sources.items()):
        own: dict[str, str] = {}
        repeated = [c for c in columns_of(df) if own.setdefault(form(c), c) != c]
        cells = [(text_of(F.col(f"`{own[k]}`")) if k in own else F.lit("")).alias(name_of[k]) for k in labels]
        part = df.select(F.lit(i).alias("_source"), F.col(ROW), *([F.lit(name).alias(source_column)] if source_column else []), *cells)
        parts = part if parts is None else parts.unionByName(part)
        report.append((name, i, [name_of[k] for k in labels if k in own], [name_of[k] for k in labels if k not in own], repeated))
    counts = parts.groupBy("_source").agg(F.count(F.lit(1)).alias("n_rows"))
    present = spark.createDataFrame(report, "source string, _source int, present array<string>, missing array<string>, dropped array<string>")
    coverage = present.join(counts, "_source", "left").select("source", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "present", "missing", "dropped")
    return OpResult(parts, {"coverage": coverage})


def join_key(value: Column, loose: bool = False) -> Column:
    """Keys are texts, so blank ones match each other."""
    return key_of(value) if loose else F.lower(trim_ws(collapse_ws(text_of(value))))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", loose: bool = False, suffix: str = "_right") -> OpResult:
    """Equi-join on one normalised key; how: inner, left or full. Right columns that clash get the suffix, the right key goes; right-only rows put their key into the left key's column. Order: _row of the left, then of the right; right-only rows come last, by their key's first row."""
    lk, rk = resolve(columns_of(left), left_key)[0], resolve(columns_of(right), right_key)[0]
    names = columns_of(left)
    taken = {c.strip().lower() for c in names}
    extra = [c for c in columns_of(right) if c != rk]
    renamed = unique_headers(names + [c + suffix if c.strip().lower() in taken else c for c in extra])[len(names) :]
    l = left.select(F.col(ROW).alias("_l"), *names, join_key(F.col(lk), loose).alias("_k"))  # noqa: E741
    r = right.select(F.col(ROW).alias("_r"), F.col(rk).alias("_rk"), *[F.col(c).alias(n) for c, n in zip(extra, renamed, strict=True)], join_key(F.col(rk), loose).alias("_j"))
    both = l.join(r, F.col("_k") == F.col("_j"), {"inner": "inner", "left": "left", "full": "full"}[how])
    cells = [text_of(F.when(F.col("_l").isNull(), F.col("_rk")).otherwise(F.col(c)) if c == lk else F.col(c)).alias(c) for c in names]
    data = both.select("_l", "_r", *cells, *[text_of(F.col(n)).alias(n) for n in renamed])
    by_left, by_right = l.groupBy("_k").agg(F.count(F.lit(1)).alias("nl")), r.groupBy("_j").agg(F.count(F.lit(1)).alias("nr"))
    keys = by_left.join(by_right, F.col("_k") == F.col("_j"), "full").na.fill(0, ["nl", "nr"])
    out = F.col("nl") * F.col("nr")
    alone_l, alone_r = F.when(F.col("nr") == 0, F.col("nl")).otherwise(0), F.when(F.col("nl") == 0, F.col("nr")).otherwise(0)
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    stats = keys.agg(
        total(F.when(F.col("nr") > 0, F.col("nl")).otherwise(0), "matched"), total(alone_l, "left_only"), total(alone_r, "right_only"),
        total(F.when(F.col("nr") > 1, F.col("nl") * (F.col("nr") - 1)).otherwise(0), "fanout"), total(F.when(F.col("nr") > 1, 1).otherwise(0), "dup_keys_right"),
        total(out + (alone_l if how != "inner" else F.lit(0)) + (alone_r if how == "full" else F.lit(0)), "out"),
    )
    left_only = l.join(spread(r.select("_j").distinct()), F.col("_k") == F.col("_j"), "left_anti").select((F.col("_l") + 1).alias("row"), F.col(lk).alias("key"))
    right_only = r.join(spread(l.select("_k").distinct()), F.col("_k") == F.col("_j"), "left_anti").select((F.col("_r") + 1).alias("row"), F.col("_rk").alias("key"))
    return OpResult(data, {"stats": stats, "left_only": left_only, "right_only": right_only})


def ordered(joined: DataFrame) -> DataFrame:
    """A join's rows in their order: left, then right, then what only the right has. It sorts everything, so only for output."""
    return joined.orderBy(F.col("_l").asc_nulls_last(), "_r")

