"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as one UTF-8 byte buffer per chunk of documents: word edges come from a byte table, and
word and window names are 64-bit polynomial hashes taken from running sums, so the cost is a few array passes
per byte whatever the number of documents. Equal words or windows have equal names in every task of a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. Work arrays are about 60 times as large for an instant; of one text that is
#: longer, what is kept takes about 10 times its bytes, as names are made piece by piece.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: True for bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters, digits and non-ASCII characters.
NON_WORD = np.zeros(256, bool)
NON_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the powers of its inverse."""
    key = (base, inverse)
    if key not in _powers or len(_powers[key]) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        out = np.full(max(n, 1 << 16), step, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them; nulls count as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string()).fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each and a row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_bytes(column)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a chunk of texts: byte starts and ends, row of each word, first word of each row, names."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        data, self.offsets = text_bytes(column)
        self.data = LOWER[data] if lower else data
        self.rows = len(column)
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        #: words before each row, and the count of all at the end
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.name = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):  # pieces of whole words
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + 2 * CHUNK_BYTES, "right")))
            self.name[at:to] = self._names(at, to)
            at = to

    def _names(self, at: int, to: int) -> np.ndarray:
        base, last = self.start[at], self.end[to - 1]
        start, end, n = self.start[at:to] - base, self.end[at:to] - base, int(last - base)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data[base:last]] * powers(_P, n), out=sums[1:])
            return mix((sums[end] - sums[start]) * powers(_P, n + 1, True)[start] + (end - start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Name of the `size` words from each word on, and whether they are all of one row."""
        names = self.name if names is None else names
        n = max(0, len(names) - size + 1)
        return self.spans(np.arange(n), np.arange(size, size + n), names), self.row[:n] == self.row[size - 1 : size - 1 + n]

    def spans(self, first: np.ndarray, end: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
        """Names of the words from each of `first` up to `end`, the last excluded."""
        names = self.name if names is None else names
        with np.errstate(over="ignore"):
            sums = np.zeros(len(names) + 1, np.uint64)
            np.cumsum(names * powers(_Q, len(names)), out=sums[1:])
            return mix((sums[end] - sums[first]) * powers(_Q, len(names) + 1, True)[first] + (end - first).astype(np.uint64))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
