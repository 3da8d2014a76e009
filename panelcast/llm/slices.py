"""A bounded, vectorised cache from token slices to arrays of integers.

A slice of up to 24 UTF-8 bytes is its own exact key: three 64-bit words and a length.
The cache is direct-mapped: one look-up compares the keys of all slices of a batch with
the table at once.  Missing slices are computed once each; a slice that falls on a used
place takes it over.  Longer slices are rare and computed as they come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WORDS = 3
KEY_BYTES = 8 * WORDS
PLACES_LOG2 = 19
POOL_LIMIT = 8 << 20

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd multipliers


class SliceCache:
    """compute(list of byte slices) -> list of integer sequences, one for each."""

    def __init__(self, compute: Callable, places_log2: int = PLACES_LOG2, pool_limit: int = POOL_LIMIT) -> None:
        self.compute, self.log2, self.pool_limit = compute, places_log2, pool_limit
        self._reset()

    def _reset(self) -> None:
        size = 1 << self.log2
        self.words = [np.zeros(size, np.uint64) for _ in range(WORDS)]
        self.length = np.zeros(size, np.uint8)  # 0: unused
        self.offset = np.zeros(size, np.int64)
        self.count = np.zeros(size, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _append(self, values: list) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.fromiter((x for v in values for x in v), np.int32, int(counts.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        offsets = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        return offsets, counts

    def gather(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all slices of `data` in order, number of values of each slice)."""
        if self.used > self.pool_limit:
            self._reset()
        n = len(starts)
        lengths = ends - starts
        short = lengths <= KEY_BYTES
        padded = np.frombuffer(data + bytes(KEY_BYTES), np.uint8)
        eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
        key = []
        mixed = lengths.astype(np.uint64)
        for w in range(WORDS):
            word = eights[np.minimum(starts + 8 * w, len(eights) - 1)]
            word &= _MASKS[np.clip(lengths - 8 * w, 0, 8)]
            key.append(word)
            mixed = (mixed ^ word) * _MIX[w]
            mixed ^= mixed >> np.uint64(29)
        place = (mixed >> np.uint64(64 - self.log2)).astype(np.int64)
        hit = short & (self.length[place] == lengths)
        for w in range(WORDS):
            hit &= self.words[w][place] == key[w]
        offsets, counts = np.empty(n, np.int64), np.empty(n, np.int64)
        offsets[hit], counts[hit] = self.offset[place[hit]], self.count[place[hit]]
        missing = np.flatnonzero(~hit)
        if len(missing):
            first: dict[bytes, int] = {}
            which = [
                first.setdefault(data[a:b], len(first))
                for a, b in zip(starts[missing].tolist(), ends[missing].tolist())
            ]
            new_offsets, new_counts = self._append(self.compute(list(first)))
            offsets[missing], counts[missing] = new_offsets[which], new_counts[which]
            keep = missing[short[missing]]
            to = place[keep]
            for w in range(WORDS):
                self.words[w][to] = key[w][keep]
            self.length[to], self.offset[to], self.count[to] = lengths[keep], offsets[keep], counts[keep]
        total = np.cumsum(counts)
        at = np.repeat(offsets - (total - counts), counts) + np.arange(int(total[-1]) if n else 0)
        return self.pool[at], counts
