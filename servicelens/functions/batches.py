"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sliced(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes, so that long texts do not add up in a task."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sliced_arrays(array: pa.Array, size: int = 1_000_000) -> Iterator[pa.Array]:
    """The same cells in arrays of about so many bytes: only so much of them becomes Python objects at a
    time, however many rows an Arrow batch has."""
    cells = max(1, int(len(array) * size / max(array.nbytes, 1)))
    for at in range(0, len(array), cells):
        yield array.slice(at, cells)
