"""Every registered query and, where SQL can express it, the DuckDB SQL with the same result."""

from . import cells, documents, grids, links, totals  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
