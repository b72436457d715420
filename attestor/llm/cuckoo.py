"""A cuckoo filter over 64-bit hashes with vectorised bulk operations."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """16-bit fingerprints (0 means free) in buckets of four; supports insertion, deletion and lookup.

    A key may be inserted once; deleting one that was never inserted is the caller's error, as with any such filter.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for ``keys`` at a load of at most 70 %."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.7))))))

    @property
    def _mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(h, np.uint64)
        return ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16), h & self._mask

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (((fp.astype(np.uint64) * _MIX) >> np.uint64(20)) & self._mask)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, at = self._places(h)
        return ((self.table[at] == fp[:, None]) | (self.table[self._other(fp, at)] == fp[:, None])).any(axis=1)

    def insert(self, h: np.ndarray, rounds: int = 500) -> bool:
        """Add all keys; False if some found no place, and then a larger filter has to be built."""
        fp, at = self._places(h)
        rng, turn = np.random.default_rng(7), 0
        while len(fp):
            if turn > rounds:
                return False
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            first = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            free = self.table[at] == 0
            nth = np.cumsum(free, axis=1)
            slot = np.argmax(nth > rank[:, None], axis=1)
            fits = nth[:, -1] > rank
            self.table[at[fits], slot[fits]] = fp[fits]
            fp, at, first_left = fp[~fits], at[~fits], np.r_[True, np.diff(at[~fits].astype(np.int64)) != 0][: int((~fits).sum())]
            if turn >= 1 and len(fp):  # both places were full: one key of each bucket swaps with a stored one
                who, victim = np.flatnonzero(first_left), rng.integers(0, SLOTS, int(first_left.sum()))
                stored = self.table[at[who], victim]
                self.table[at[who], victim] = fp[who]
                fp = fp.copy()
                fp[who] = np.where(stored == 0, fp[who], stored)
            at = self._other(fp, at)
            turn += 1
        return True

    def delete(self, h: np.ndarray) -> None:
        """Take one copy of each key out, at its first place or else at its other one."""
        fp, at = self._places(h)
        for _ in range(2):
            order = np.lexsort((fp, at))
            fp, at = fp[order], at[order]
            alike = np.r_[False, (at[1:] == at[:-1]) & (fp[1:] == fp[:-1])] if len(fp) else np.zeros(0, bool)
            n = np.arange(len(fp))
            rank = n - np.maximum.accumulate(np.where(alike, 0, n))  # the how manieth of equal keys
            held = self.table[at] == fp[:, None]
            nth = np.cumsum(held, axis=1)
            found = nth[:, -1] > rank
            self.table[at[found], np.argmax(nth > rank[:, None], axis=1)[found]] = 0
            fp, at = fp[~found], self._other(fp[~found], at[~found])

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out


def build(h: np.ndarray) -> CuckooFilter:
    """A filter that holds all of ``h``, as large as it takes."""
    room = max(len(h), 1)
    while True:
        out = CuckooFilter.sized(room)
        if out.insert(h):
            return out
        room *= 2
