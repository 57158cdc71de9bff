"""words(doc_id, page, word_idx, text, x, y, x1, y1, w, h, conf) to lines, cells and vertical bands.

Everything is partitioned by (doc_id, page). Lines need a running mean, which no window gives, and so
an Arrow map over sorted pages; the rest are windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.functions.arrow import numbers, whole_groups
from gridwright.functions.core import text_of, trim_ws
from gridwright.functions.numbers import parse_number

PAGE = ["doc_id", "page"]
# Tolerances, in glyph heights, median word spaces or line spacings.
LINE_TOLERANCE = 0.45
CELL_HEIGHTS, CELL_SPACES = 1.1, 4.0
BAND_SPACINGS, BAND_HEIGHTS = 2.0, 2.5
DEFAULT_HEIGHT, SPACE_OF_HEIGHT, SPACING_OF_HEIGHT = 10.0, 0.28, 1.4


def words_from_items(items: DataFrame) -> DataFrame:
    """items(doc_id, page, item_idx, str, x, baseline, width, height, page_height) of a text layer to words: each takes its share of the item's width, y runs from the top."""
    t = text_of(F.col("str"))
    pieces, gaps = F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)), F.split(t, r"\S+", -1)
    per = F.col("width") / F.greatest(F.length(t), F.lit(1))
    top = F.col("page_height") - F.col("baseline") - 0.8 * F.col("height")
    # There is a gap more than words; posexplode_outer, as posexplode would have both lists made once more by an inferred filter.
    cut = items.select(*PAGE, "item_idx", "x", "height", per.alias("per"), top.alias("y"), F.posexplode_outer(F.arrays_zip(gaps.alias("gap"), pieces.alias("text"))).alias("k", "s")).where("s.text is not null")
    size = F.length("s.text")
    # A word begins after all gaps and words before it; the same sort serves to number the page's words.
    item = W.partitionBy(*PAGE, "item_idx").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    at = F.sum(F.length("s.gap") + size).over(item) - size
    placed = cut.withColumns({"size": size, "at": at, "word_idx": F.row_number().over(W.partitionBy(*PAGE).orderBy("item_idx", "k")).cast("long")})
    x = F.col("x") + F.col("at") * F.col("per")
    return placed.select(
        *PAGE, "word_idx", F.col("s.text").alias("text"), x.alias("x"), "y", (x + F.col("size") * F.col("per")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"), (F.col("size") * F.col("per")).alias("w"), F.col("height").alias("h"), F.lit(None).cast("double").alias("conf"),
    )


def normalise_words(words: DataFrame) -> DataFrame:
    """Blank words out, texts trimmed, missing edges derived from the others."""
    c = {n: F.col(n).cast("double") if n in words.columns else F.lit(None).cast("double") for n in ("x", "y", "x1", "y1", "w", "h", "conf")}
    x, y = F.coalesce(c["x"], F.lit(0.0)), F.coalesce(c["y"], F.lit(0.0))
    x1 = F.coalesce(c["x1"], x + F.coalesce(c["w"], F.lit(0.0)))
    y1 = F.coalesce(c["y1"], y + F.coalesce(c["h"], F.lit(DEFAULT_HEIGHT)))
    out = words.select(*PAGE, "word_idx", trim_ws(text_of(F.col("text"))).alias("text"), x.alias("x"), y.alias("y"), x1.alias("x1"), y1.alias("y1"), F.coalesce(c["w"], x1 - x).alias("w"), F.coalesce(c["h"], y1 - y).alias("h"), c["conf"].alias("conf"))
    return out.where("text != ''")


def _line_numbers(centers: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, its mean centre) of words given by their centres in reading order. Neighbours of one centre share a line, so lines are looked up once for each run of them, among the means so far: the latest one near enough, unless a later line lies far above."""
    starts = np.flatnonzero(np.append(True, centers[1:] != centers[:-1]))
    sizes = np.diff(np.append(starts, len(centers)))
    means, weights, line_of = np.empty(len(starts)), np.zeros(len(starts)), np.empty(len(starts), np.int64)
    n = 0
    for run, (center, size) in enumerate(zip(centers[starts], sizes, strict=True)):
        near = np.flatnonzero(np.abs(means[:n] - center) <= tolerance)
        above = np.flatnonzero(means[:n] < center - 4 * tolerance)
        line = near[-1] if len(near) and (not len(above) or above[-1] < near[-1]) else n
        if line == n:
            n += 1
            means[line] = center
        weights[line] += size
        means[line] += (center - means[line]) * size / weights[line]
        line_of[run] = line
    order = np.argsort(means[:n], kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    each = np.repeat(line_of, sizes)
    return rank[each], means[each]


def assign_lines(words: DataFrame) -> DataFrame:
    """words with line, numbered from the top. A word joins the latest line within 0.45 median heights of its running mean centre. Pages are sorted by Spark and read in Arrow batches, many at a time."""
    names = [*PAGE, "word_idx", "text", "x", "y", "x1", "y1", "w", "h", "conf"]
    schema = words.select(*names).schema.add("line", "integer").add("line_center", "double")

    def run(batches):
        for table, bounds in whole_groups(batches, PAGE):
            height, center = numbers(table, "h"), (numbers(table, "y") + numbers(table, "y1")) / 2
            line, mean = np.empty(len(center), np.int32), np.empty(len(center))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                tall = height[lo:hi][height[lo:hi] > 0.5]
                usual = float(np.median(tall)) if len(tall) else DEFAULT_HEIGHT
                line[lo:hi], mean[lo:hi] = _line_numbers(center[lo:hi], max(1.0, usual * LINE_TOLERANCE))
            yield from table.append_column("line", pa.array(line)).append_column("line_center", pa.array(mean)).to_batches()

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.select(*names).repartition(n, *PAGE).sortWithinPartitions(*PAGE, "y", "x", "word_idx").mapInArrow(run, schema)


def lines(words: DataFrame) -> DataFrame:
    """doc_id, page, line, center, top, bottom, x, x1, text of words that have lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "word_idx", "text"))), lambda s: s["text"])
    return words.groupBy(*PAGE, "line").agg(F.max("line_center").alias("center"), F.min("y").alias("top"), F.max("y1").alias("bottom"), F.min("x").alias("x"), F.max("x1").alias("x1"), F.array_join(ordered, " ").alias("text"))


def page_metrics(words: DataFrame) -> DataFrame:
    """Of each page with lines: median glyph height, word space and line spacing, counts and bounds."""
    page = W.partitionBy(*PAGE)
    height = F.coalesce(F.percentile(F.when(F.col("h") > 0.5, F.col("h")), F.lit(0.5)).over(page), F.lit(DEFAULT_HEIGHT))
    w = words.withColumn("mh", height).withColumn("gap", F.col("x") - F.lag("x1").over(W.partitionBy(*PAGE, "line").orderBy("x", "word_idx")))
    usable = F.when((F.col("gap") > -F.col("mh")) & (F.col("gap") < F.col("mh") * 0.9), F.greatest("gap", F.lit(0.0)))
    spaces = w.groupBy(*PAGE).agg(
        F.max("mh").alias("median_height"), F.percentile(usable, F.lit(0.5)).alias("space"), F.countDistinct("line").alias("line_count"), F.count(F.lit(1)).alias("word_count"),
        F.min("x").alias("x_min"), F.max("x1").alias("x_max"), F.min("y").alias("y_min"), F.max("y1").alias("y_max"),
    )
    centers = words.groupBy(*PAGE, "line").agg(F.max("line_center").alias("c"))
    spacing = centers.withColumn("s", F.col("c") - F.lag("c").over(page.orderBy("line"))).groupBy(*PAGE).agg(F.percentile("s", F.lit(0.5)).alias("spacing"))
    or_else = lambda c, factor: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.col("median_height") * factor).otherwise(F.col(c))
    return spaces.join(spacing, PAGE).select(*PAGE, "median_height", or_else("space", SPACE_OF_HEIGHT).alias("median_space"), or_else("spacing", SPACING_OF_HEIGHT).alias("median_line_spacing"), "line_count", "word_count", "x_min", "x_max", "y_min", "y_max")


def split_cells(words: DataFrame, metrics: DataFrame) -> DataFrame:
    """doc_id, page, line, cell, text, x, x1, word_count, is_numeric, is_nil, is_figure, conf: a line breaks where a gap to the right edge so far is wide."""
    line = W.partitionBy(*PAGE, "line").orderBy("x", "word_idx")
    wide = F.greatest(F.col("median_height") * CELL_HEIGHTS, F.col("median_space") * CELL_SPACES, F.lit(2.0))
    w = words.join(metrics.select(*PAGE, "median_height", "median_space"), PAGE)
    # The edge of the cell so far equals that of the line so far wherever a gap is wide: words come by x.
    w = w.withColumn("edge", F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1)))
    w = w.withColumn("new", F.coalesce((F.col("x") - F.col("edge") >= wide).cast("int"), F.lit(0))).withColumn("cell", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "word_idx", "text"))), lambda s: s["text"])
    c = w.groupBy(*PAGE, "line", "cell").agg(F.array_join(ordered, " ").alias("text"), F.min("x").alias("x"), F.max("x1").alias("x1"), F.count(F.lit(1)).cast("int").alias("word_count"), F.min("conf").alias("conf"))
    p = parse_number(F.col("text"))
    return c.withColumn("p", p).select(*PAGE, "line", "cell", "text", "x", "x1", "word_count", F.col("p.is_numeric").alias("is_numeric"), F.col("p.is_nil").alias("is_nil"), (F.col("p.is_numeric") | F.col("p.is_nil")).alias("is_figure"), "conf")


def bands(line_rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """lines with band: a new one begins below an unusually large gap."""
    page = W.partitionBy(*PAGE).orderBy("line")
    limit = F.greatest(F.col("median_line_spacing") * BAND_SPACINGS, F.col("median_height") * BAND_HEIGHTS)
    marked = line_rows.join(metrics.select(*PAGE, "median_line_spacing", "median_height"), PAGE).withColumn("new", F.coalesce((F.col("center") - F.lag("center").over(page) > limit).cast("int"), F.lit(0)))
    return marked.withColumn("band", F.sum("new").over(page.rowsBetween(W.unboundedPreceding, 0)).cast("int")).select(*line_rows.columns, "band")
