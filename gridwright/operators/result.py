"""What every grid operator returns: lazy data, and lazy audits of what it did."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: The ordinal that every grid carries: 0-based, by which "first", "last" and "above" are meant.
ROW = "_row"


@dataclass
class OpResult:
    data: DataFrame
    audits: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def columns_of(df: DataFrame) -> list[str]:
    """A grid's own columns, without the ordinal."""
    return [c for c in df.columns if c != ROW]
