"""Texts as sequences of distinct units (words with what clings to them), so that each unit is encoded once a task."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftwell.llm.words import ranges

#: Units that a worker remembers, and characters and ids of all of them together; beyond either, it starts anew.
POOL_UNITS, POOL_SIZE = 200_000, 6_000_000


class Pool:
    """Ids of units met so far. `encode` turns new units into one array of ids each, as counts and a flat array."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = POOL_UNITS, size: int = POOL_SIZE):
        self.encode, self.limit, self.most = encode, limit, size
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size = 0
        self.count, self.start, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, units: list[str]) -> np.ndarray:
        """Places of the units, for `gather` until the next call."""
        if len(self.at) > self.limit or self.size > self.most:
            self._clear()
        at = self.at
        places = np.fromiter(map(at.get, units, repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(places < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(units[i] for i in unknown))
            count, ids = self.encode(new)
            base = len(at)
            self.size += sum(map(len, new)) + len(ids)
            at.update(zip(new, range(base, base + len(new))))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            places[unknown] = [at[units[i]] for i in unknown]
        return places

    def gather(self, places: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of places, and how many stand between consecutive edges of it."""
        count = self.count[places]
        sums = np.concatenate([[0], np.cumsum(count)])
        return self.ids[ranges(self.start[places], count)], np.diff(sums[edges])


def pieces(column: pa.Array, separator: str = " ") -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of what stands between separators, the distinct pieces, and the edges of the texts among the codes."""
    parts = pc.split_pattern(column.cast(pa.large_string()).fill_null(""), separator)
    edges = np.asarray(parts.offsets)
    coded = parts.flatten().dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist(), edges - edges[0]
