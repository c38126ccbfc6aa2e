"""Batches of documents in pieces, so that a task holds a piece's results and not those of all that Spark puts into one batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of contents of a piece, at most; a single larger document is a piece.
ROWS, BYTES = 256, 4 << 20


def pieces(batches: Iterable[pa.RecordBatch], content: str = "content") -> Iterator[dict[str, list]]:
    """Columns by name, a piece at a time."""
    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        while at < n:
            stop = int(np.searchsorted(ends, ends[at] + BYTES, "right")) - 1
            stop = min(max(stop, at + 1), at + ROWS, n)
            yield batch.slice(at, stop - at).to_pydict()
            at = stop


def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """The first column, ``ROWS`` rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.column(0).slice(at, ROWS).to_pylist()


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
