"""Groups of rows inside Arrow streams that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal keys; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        while at < n:
            end = at + 1
            while end < n and rows[end] == rows[at]:
                end += 1
            if current is not None and rows[at] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = rows[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield current, pa.Table.from_batches(held)
