"""Tokenising by parts that recur.

A tokenizer that never joins characters across certain boundaries gives the
same ids for a text as for its parts one after another.  Words recur, so
each worker encodes a part once (bounded table, keyed by a 64-bit hash of
the part's bytes) and the ids of a text are gathered from the table.
"""

from __future__ import annotations

import numpy as np

from lectern.llm.common import run_hashes

MAX_PARTS = 700_000    # parts a worker keeps between batches (about 30 bytes each)
AT_ONCE = 1 << 15      # parts looked up at a time: what a lookup needs besides is a multiple of it


class PartTable:
    """``encode_parts`` maps a list of strings to a list of id lists."""

    def __init__(self, encode_parts, max_parts: int = MAX_PARTS):
        self.encode_parts, self.max_parts = encode_parts, max_parts
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)         # sorted
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        got = self.encode_parts(parts)
        size = np.fromiter(map(len, got), np.int32, len(got))
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(total, self.used), np.int32)])
        self.ids[self.used:self.used + total] = np.fromiter((i for x in got for i in x), np.int32, total)
        first = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.size = np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and the number of ids of each."""
        ids, sizes = [np.zeros(0, np.int32)], np.zeros(len(starts), np.int64)
        for i in range(0, len(starts), AT_ONCE):
            k = slice(i, i + AT_ONCE)
            got, sizes[k] = self._some(data, starts[k], ends[k])
            ids.append(got)
        return np.concatenate(ids), sizes

    def _some(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where, at = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, keys)
        new = (known == len(self.keys)) | (self.keys[np.minimum(known, max(0, len(self.keys) - 1))] != keys if len(self.keys) else True)
        if new.any():
            if len(self.keys) > self.max_parts:
                self.reset()
                new[:] = True
            pick = where[new]
            self._learn(keys[new], [data[s:e].tobytes().decode("utf-8") for s, e in zip(starts[pick].tolist(), ends[pick].tolist())])
            known = np.searchsorted(self.keys, keys)
        slot = known[at]
        n = self.size[slot].astype(np.int64)
        stop = np.cumsum(n)
        return self.ids[np.repeat(self.first[slot] - (stop - n), n) + np.arange(stop[-1])], n


def cuts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, joined=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of every row: runs of ``space`` bytes with what follows them.
    ``joined(data, p)`` marks cuts p that must not be made.  Returns starts,
    ends, and for each row the index of its first part (n + 1 values)."""
    sp = space[data]
    mark = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        mark[1:-1] = sp[1:] & ~sp[:-1]
    if joined is not None:
        p = np.flatnonzero(mark)
        mark[p[joined(data, p)]] = False
    mark[offsets] = True
    mark[-1] = False
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], len(data))[:len(starts)]
    return starts, ends, np.searchsorted(starts, offsets)
