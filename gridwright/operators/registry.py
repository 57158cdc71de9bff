"""The tools by id, in their groups and order."""

from __future__ import annotations

from dataclasses import dataclass

from . import annotate, clean, combine, reshape, verify

GROUPS = ("clean", "combine", "convert", "verify", "annotate")


@dataclass(frozen=True)
class Tool:
    id: str
    group: str
    order: int
    run: object


_tools: dict[str, Tool] = {}


def register(tool: Tool) -> Tool:
    if not tool.id or tool.group not in GROUPS or tool.id in _tools:
        raise ValueError(f"cannot register {tool.id!r} in {tool.group!r}")
    _tools[tool.id] = tool
    return tool


def tools() -> list[Tool]:
    return sorted(_tools.values(), key=lambda t: (GROUPS.index(t.group), t.order, t.id))


def get(id: str) -> Tool | None:
    return _tools.get(id)


def _workbook(grids):
    from gridwright.sinks import grids_to_workbook

    return grids_to_workbook(grids)


for _args in (
    ("number-clean", "clean", 10, clean.number_clean), ("trim-whitespace", "clean", 20, clean.trim_grid), ("dedupe-rows", "clean", 30, clean.dedupe), ("transpose", "clean", 40, reshape.transpose_with_header),
    ("merge-csv", "combine", 10, combine.merge), ("join-csv", "combine", 20, combine.join), ("csv-excel", "convert", 10, _workbook), ("reshape", "convert", 20, reshape.melt),
    ("foot-check", "verify", 10, verify.foot_grid), ("schema-check", "verify", 20, verify.schema_check), ("provenance", "annotate", 10, annotate.stamp), ("header-map", "annotate", 20, annotate.map_headers),
):
    register(Tool(*_args))
