"""Hashes of words that are the same on every worker."""

from __future__ import annotations

import hashlib

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)

#: Words whose hashes a worker keeps; beyond it the memory is filled anew, results do not change.
REMEMBERED = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


class WordHashes:
    """64-bit hashes of words; the empty word, which separates texts, has 0."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.table = np.zeros(1024, np.uint64)

    def _learn(self, flat: list[str]) -> None:
        fresh = [w for w in set(flat) if w not in self.ids]
        if len(self.ids) + len(fresh) > max(REMEMBERED, len(fresh) + 1):
            self.__init__()
            fresh = [w for w in set(flat) if w]
        start = len(self.ids)
        self.ids.update(zip(fresh, range(start, start + len(fresh))))
        while len(self.table) < len(self.ids):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        digests = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in fresh)
        self.table[start : len(self.ids)] = np.frombuffer(digests, ">u8") | np.uint64(1)

    def of(self, flat: list[str]) -> np.ndarray:
        try:
            numbers = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        except KeyError:
            self._learn(flat)
            numbers = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        return self.table[numbers]


word_hashes = WordHashes().of
