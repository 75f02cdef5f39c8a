"""Token ids of chunks, looked up for a whole buffer at once."""

from __future__ import annotations

import numpy as np

from .text import span_hashes


class ChunkCache:
    """Keeps the ids of up to `most` chunks by hash; a subclass encodes those not seen before."""

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each)."""
        raise NotImplementedError

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks data[start:end], offsets of each chunk's); chunks with equal bytes in `hashed` have equal ids."""
        hashes = span_hashes(hashed, starts, ends)
        keys, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids, sizes = self.encode([raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            begin = len(self.flat) + np.cumsum(sizes) - sizes
            self.at, self.size = np.insert(self.at, at[new], begin), np.insert(self.size, at[new], sizes)
            self.keys, self.flat = np.insert(self.keys, at[new], keys[new]), np.concatenate([self.flat, ids])
            at = np.searchsorted(self.keys, keys)
        sizes = self.size[at][place]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.at[at][place] - before, sizes) + np.arange(int(sizes.sum()))], np.concatenate([[0], np.cumsum(sizes)])
