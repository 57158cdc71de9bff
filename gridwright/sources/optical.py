"""Where a renderer or an optical reader plugs in. Neither is part of the engine; the words they make are."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CONFIDENCE = 40
GREY, CONTRAST = (0.299, 0.587, 0.114), 1.25
WORDS = "doc_id string, page int, word_idx long, text string, x double, y double, x1 double, y1 double, w double, h double, conf double"


def read_words(files: DataFrame, reader: Callable[[str, bytes], Iterable[tuple]]) -> DataFrame:
    """files(doc_id, content) through reader(doc_id, content) -> (page, text, x, y, x1, y1, conf) tuples."""

    def run(batches):
        for batch in batches:
            out = []
            for d, content in zip(batch["doc_id"], batch["content"], strict=True):
                for i, (page, text, x, y, x1, y1, conf) in enumerate(reader(d, content)):
                    out.append((d, page, i, text, x, y, x1, y1, x1 - x, y1 - y, conf))
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in WORDS.split(", ")])

    return files.select("doc_id", "content").mapInPandas(run, WORDS)


def to_page_space(words: DataFrame, scale: str = "scale", left: str = "left", top: str = "top") -> DataFrame:
    """Words in pixels of a rendered region to points of their page; readings under MIN_CONFIDENCE go."""
    at = lambda c, origin: (F.col(c) / F.col(scale) + F.col(origin)).alias(c)
    kept = words.where(F.col("conf").isNull() | (F.col("conf") >= MIN_CONFIDENCE))
    return kept.select("doc_id", "page", "word_idx", "text", at("x", left), at("y", top), at("x1", left), at("y1", top), ((F.col("x1") - F.col("x")) / F.col(scale)).alias("w"), ((F.col("y1") - F.col("y")) / F.col(scale)).alias("h"), "conf")


def greyscale(rgb):
    """An (h, w, 3) array in grey with more contrast, 0 to 255."""
    import numpy as np

    return np.clip((rgb[..., :3] @ np.array(GREY) - 128) * CONTRAST + 128, 0, 255)


def working_width(width: int) -> int:
    return min(max(width, 1600), 4000)


# Where images stand on a page


MIN_REGION = 20
PAINT = ("paintImageXObject", "paintJpegXObject", "paintInlineImageXObject", "paintImageMaskXObject")


def image_regions(operators: DataFrame) -> DataFrame:
    """operators(doc_id, page, at, op, args array<double>, page_height), the drawing operators of pages in order (save, restore, transform, and those that paint images), to doc_id, page, region, x, y, w, h of images of some size, from the top. Transforms multiply up along the operators, so a page is a group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        now, kept, out = np.eye(3), [], []
        for op, args, height in zip(p.op, p.args, p.page_height, strict=True):
            if op == "save":
                kept.append(now)
            elif op == "restore":
                now = kept.pop() if kept else np.eye(3)
            elif op == "transform":
                a, b, c, d, e, f = args
                now = now @ np.array([[a, c, e], [b, d, f], [0, 0, 1]])
            elif op in PAINT:
                w, h = abs(now[0, 0]) or abs(now[1, 0]), abs(now[1, 1]) or abs(now[0, 1])
                if w > MIN_REGION and h > MIN_REGION:
                    out.append((p.doc_id.iloc[0], p.page.iloc[0], len(out), now[0, 2], height - now[1, 2] - h, w, h))
        return pd.DataFrame(out, columns=["doc_id", "page", "region", "x", "y", "w", "h"])

    kind = dict(operators.dtypes)["doc_id"]
    return operators.groupBy("doc_id", "page").applyInPandas(lambda p: run(p.sort_values("at", kind="stable")), f"doc_id {kind}, page int, region int, x double, y double, w double, h double")
