"""Arrow batches cut by what they hold: the memory of a task follows from ``PIECE_TOKENS``, not from rows or partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are worked on at a time; a longer text is a piece of its own
PIECE_TOKENS = 1 << 18


def pieces(batches: Iterator[pa.RecordBatch], tokens: str = "tokens", most: int = PIECE_TOKENS) -> Iterator[pa.RecordBatch]:
    """All rows in their order, in parts of at most ``most`` tokens or one row; no part is empty."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(b.schema.get_field_index(tokens))), 0).to_numpy().astype(np.int64))
        a = 0
        while a < b.num_rows:
            before = int(ends[a - 1]) if a else 0
            z = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(a, z - a)
            a = z
