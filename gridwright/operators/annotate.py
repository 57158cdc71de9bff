"""Annotating grids: provenance columns, canonical headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.text import similarity

from .headers import index_of, normalise_key, unique_headers
from .result import ROW, OpResult, columns_of


def stamp(df: DataFrame, fields: dict[str, str], append: bool = False, overwrite: bool = False) -> OpResult:
    """Constant columns before or after the others. Blank fields are ignored; a column that is there already is left, or overwritten in place."""
    fields = {k.strip(): v for k, v in fields.items() if k.strip() and str(v or "").strip()}
    names = columns_of(df)
    there = {k: names[i] for k in fields if (i := index_of(names, k)) >= 0}
    new = [F.lit(str(v)).alias(k) for k, v in fields.items() if k not in there]
    own = [F.lit(str(fields[k])).alias(c) if overwrite and (k := next((k for k, n in there.items() if n == c), None)) else F.col(c) for c in names]
    warnings = [] if overwrite else [f"column {k} is there already" for k in there]
    return OpResult(df.select(ROW, *(own + new if append else new + own)), {}, warnings)


def map_headers(df: DataFrame, mapping: dict[str, str], canonical: list[str] | None = None, drop_unmapped: bool = False) -> OpResult:
    """Renames by normalised key; with a canonical list, puts its columns in its order, adding those missing as ''. Unmapped columns come after, or go. The audit says what became of each header."""
    names = columns_of(df)
    to = {c: mapping.get(normalise_key(c)) for c in names}
    known = {normalise_key(c): c for c in canonical or []}
    target = {c: to[c] or known.get(normalise_key(c)) for c in names}
    log = [(c, target[c] or c, "mapped" if to[c] else "canonical" if target[c] else "unmapped") for c in names]
    used = {normalise_key(c) for c in names}
    log += [(k, v, "unused rule") for k, v in mapping.items() if k not in used]
    source: dict[str, str] = {}
    for c in names:
        if target[c]:
            source.setdefault(target[c], c)
    rest = [c for c in names if not target[c] or source[target[c]] != c]
    mapped = [(t, c) for t, c in source.items() if t not in (canonical or [])]
    pairs = [(t, source.get(t)) for t in canonical or []]
    if canonical:
        pairs += mapped
    else:
        pairs = [(target[c] or c, c) for c in names if (target[c] and source[target[c]] == c) or not drop_unmapped]
        rest = []
    pairs += [] if drop_unmapped else [(c, c) for c in rest]
    out = unique_headers([n for n, _ in pairs])
    cells = [(F.col(f"`{c}`") if c else F.lit("")).alias(n) for n, (_, c) in zip(out, pairs, strict=True)]
    return OpResult(df.select(ROW, *cells), {"headers": df.sparkSession.createDataFrame(log, "header string, became string, status string")})


def suggest_mapping(headers: DataFrame, canonical: list[str], threshold: float = 0.45) -> DataFrame:
    """headers(header) -> header, canonical, score: the most similar canonical name, of equals the first, if similar enough. The canonical list is configuration and short."""
    scored = F.array(*[F.struct(similarity(F.col("header"), F.lit(c)).alias("score"), F.lit(-i).alias("at"), F.lit(c).alias("canonical")) for i, c in enumerate(canonical)])
    return headers.select("header", F.array_max(scored).alias("x")).where(F.col("x.score") >= threshold).select("header", "x.canonical", "x.score")
