"""Header lookup, on the driver: names are metadata, so none of this touches rows."""

from __future__ import annotations

import re

_NOT_KEY = re.compile("[^a-z0-9]+")


def normalise_key(value: str | None) -> str:
    return _NOT_KEY.sub(" ", str(value or "").lower()).strip()


def unique_headers(names: list[str]) -> list[str]:
    """Blank names become column_N; a name that repeats, case aside, gets _2, _3 and so on."""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = str(name or "").strip() or f"column_{i + 1}"
        wanted, n = base, 2
        while wanted.lower() in taken:
            wanted, n = f"{base}_{n}", n + 1
        taken.add(wanted.lower())
        out.append(wanted)
    return out


def index_of(headers: list[str], wanted: str) -> int:
    """Exact but for blanks around it first, then by normalised key; -1 if absent."""
    for i, h in enumerate(headers):
        if h.strip() == str(wanted).strip():
            return i
    for i, h in enumerate(headers):
        if normalise_key(h) and normalise_key(h) == normalise_key(wanted):
            return i
    return -1


def resolve(headers: list[str], spec: str | list[str] | None) -> list[str]:
    """Columns named in a comma-separated spec, by name first and then by 1-based number; unknown ones are left out, repeats too."""
    parts = spec if isinstance(spec, list) else [p.strip() for p in str(spec or "").split(",")]
    found = []
    for part in parts:
        i = index_of(headers, part) if part else -1
        if i < 0 and str(part).isdigit() and 1 <= int(part) <= len(headers):
            i = int(part) - 1
        if i >= 0 and headers[i] not in found:
            found.append(headers[i])
    return found


def flat_headers(rows: list[list[str]], width: int) -> list[str]:
    """Stacked header cells joined top down, without repeats of the cell above; row_label and column_N (0-based) where all are blank."""
    out = []
    for c in range(width):
        cells: list[str] = []
        for row in rows:
            cell = str(row[c] if c < len(row) else "").strip()
            if cell and (not cells or cells[-1] != cell):
                cells.append(cell)
        out.append(" ".join(cells) or ("row_label" if c == 0 else f"column_{c}"))
    return out


def tool_headers(rows: list[list[str]], width: int) -> list[str]:
    """The other flattening: each distinct cell of the stack once, column_N 1-based, unique."""
    out = []
    for c in range(width):
        cells = list(dict.fromkeys(x for row in rows if (x := str(row[c] if c < len(row) else "").strip())))
        out.append(" ".join(cells) or f"column_{c + 1}")
    return unique_headers(out)


def parse_map(text: str) -> tuple[dict[str, str], list[str]]:
    """Lines `messy = canonical`; # starts a comment. ({normalised messy: canonical}, warnings)"""
    found, warnings = {}, []
    for line in (x.strip() for x in str(text or "").splitlines()):
        if not line or line.startswith("#"):
            continue
        messy, eq, canonical = (x.strip() for x in line.partition("="))
        if not eq:
            warnings.append(f'Ignored "{line}": a mapping line looks like messy header = canonical_name')
        elif not messy or not canonical:
            warnings.append(f'Ignored "{line}": both sides are required')
        else:
            found[normalise_key(messy)] = canonical
    return found, warnings
