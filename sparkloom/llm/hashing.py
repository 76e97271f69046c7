"""Vectorised hashes of words and byte runs over slices of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 21)
        for i, b in enumerate((_BASE, _INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Slice:
    """Texts first .. first + len(offsets) - 2 of a batch, as bytes end to end. offsets: where each begins, and the end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def lower(self) -> np.ndarray:
        return _LOWER[self.data]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of which run_hash makes the hash of any run of bytes."""
        p = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _grown(len(data))[0][: len(data)], out=p[1:])
        return p

    def run_hash(self, p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((p[stop] - p[start]) * _grown(len(p))[1][start])

    def gram_hash(self, p: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k bytes from each place on; the last places, with fewer bytes left, are left out."""
        n = len(p) - k
        return mix((p[k:] - p[:n]) * _grown(len(p))[1][:n]) if n > 0 else np.zeros(0, np.uint64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, stop and text number (within the slice) of each run of bytes that aren't ASCII white space."""
        inside = ~_SPACE[self.data]
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:n]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return start, stop, np.searchsorted(self.offsets, start, "right") - 1


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[Slice]:
    """The column in runs of whole texts of about `most` bytes; nulls are empty texts. A longer text is a run of its own."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(texts))
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
