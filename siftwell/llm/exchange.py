"""Columns of numbers dealt to buckets: rows are put together before they are sent, and a bucket's rows go as packed bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import give_back

#: Bytes of text whose rows are sent on together, and rows a bucket should have.
SEND_BYTES, BUCKET = 5 << 20, 1 << 19
SENT = "bucket int, data binary"


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 32- or 64-bit integers, their bytes plane by plane, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.ravel() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def received(table: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    """The columns of a bucket's rows."""
    return [np.concatenate(c) for c in zip(*(unpacked(d, kinds) for d in table["data"].to_pylist()))]


def buckets(docs: DataFrame) -> int:
    """How many buckets the shingles or symbols are dealt to, by the size of the texts: 512 at least from 10 MB on."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(min(512, 16 + size // 20_000), -(-size // (4 * BUCKET)))


def spread(names: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each 64-bit name, in order of name."""
    per = -(-(1 << 32) // n_buckets)
    return ((names >> np.uint64(32)).astype(np.int64) // per).astype(np.int32)


def sent(parts: Iterable[pa.RecordBatch], columns_of: Callable, *merge: np.ufunc) -> Iterator[pa.RecordBatch]:
    """Batches as of SENT: `columns_of` gives a part's bucket of each row and its columns. The last columns, one for each of
    `merge`, are put together by it where all others are equal."""
    held, size = [], 0

    def rows():
        columns = [np.concatenate(c) for c in zip(*held)]
        n = len(columns) - len(merge)
        order = np.lexsort(columns[n - 1 :: -1] if merge else columns[1::-1])
        columns = [c[order] for c in columns]
        if merge and len(order):
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:n]])
            first = np.flatnonzero(new)
            columns = [*(c[first] for c in columns[:n]), *(how.reduceat(c, first, dtype=c.dtype) for how, c in zip(merge, columns[n:]))]
        names, starts = np.unique(columns[0], return_index=True)
        ends = np.append(starts[1:], len(columns[0]))
        data = [packed([c[a:b] for c in columns[1:]]) for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    for part in parts:
        held.append(columns_of(part))
        size += part.nbytes
        if size >= SEND_BYTES:
            yield rows()
            held, size = [], 0
            give_back()
    if held:
        yield rows()
