"""Vectorised byte kernels over Arrow string columns.

A chunk is a run of whole rows of at most ``CHUNK_BYTES`` of text (or one longer
row), so a worker's memory depends on the longest text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


LOWER = _lowered()


def word_table(separators: bytes) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: [^\x20\x09-\x0D]+
NON_SPACE = word_table(SPACES)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case
ALNUM = word_table(bytes(i for i in range(0x80) if not chr(i).isalnum()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets (from 0); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and the row offsets of their texts."""
    for batch in batches:
        raw, offs = utf8(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it."""
    inside = table[raw]
    rows = offs[:-1][offs[1:] > offs[:-1]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if len(rows):
        first[rows] = inside[rows]
        inner = rows[1:] - 1
        last[inner] = inside[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words with one space between two of a row, and where each word starts and ends in it."""
    if not len(starts):
        return np.empty(0, np.uint8), starts, ends
    keep = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    kept = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    later = np.ones(len(starts), dtype=bool)
    heads = of_row[:-1][of_row[1:] > of_row[:-1]]
    later[heads] = False
    gaps = starts[later] - 1
    kept[gaps] = True
    low = LOWER[raw]
    low[gaps] = 0x20
    at = np.cumsum(kept) - 1
    return low[kept], at[starts], at[ends - 1] + 1


class Rolling:
    """Hashes of any substring: bytes become random 64-bit values, and the value of
    a substring is a polynomial in an odd number modulo 2**64, mixed at the end."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(1, 1 << 62)) * 8 + 5) % (1 << 64)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.empty(size, np.uint64)
                p[0], have, step = 1, 1, base
                while have < size:  # doubles what is there
                    m = min(have, size - have)
                    p[have : have + m] = p[:m] * np.uint64(step)
                    have += m
                    step = step * step % (1 << 64)
                setattr(self, name, p)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts])

    def grams(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """The hash of the substring of ``length`` at each position that has one."""
        self._powers(len(prefix))
        n = len(prefix) - length
        return mixed((prefix[length:] - prefix[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h
