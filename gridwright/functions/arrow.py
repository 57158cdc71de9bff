"""Sorted Arrow batches in whole groups, for what needs a page's rows together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _changes(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """The rows whose keys differ from the row's before; nulls are alike."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = pc.fill_null(pc.dictionary_encode(batch.column(k)).indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds) with rows[bounds[i]:bounds[i + 1]] a group, from batches sorted by keys. Groups may span batches; only the last one is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)  # noqa: B023, E731
        cuts = ([0] if held and key(0) != last else []) + _changes(batch, keys)
        last = key(batch.num_rows - 1)
        if cuts:
            before = sum(b.num_rows for b in held)
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]), np.array([0, *(before + c for c in cuts)])
            held, batch = [], batch.slice(cuts[-1])
        held.append(batch)
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0, table.num_rows])


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as floats, null as nan."""
    return pc.fill_null(pc.cast(table.column(name), pa.float64()), np.nan).to_numpy()
