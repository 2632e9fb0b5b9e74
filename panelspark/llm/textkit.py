"""Arrow helpers for the operators that work on word hashes: whole batches at a time, no per-word Python.

Texts are processed in chunks of whole documents of about ``CHUNK`` bytes, so memory follows the longest document
and not the batch."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
SHIFT = np.uint64(33)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> SHIFT)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> SHIFT)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> SHIFT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the usual chunk size."""
    size = max(n, CHUNK)
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data, offsets


class Words:
    """The words of some consecutive documents: ``hash``, ``doc`` (index in the batch), byte ``start`` and ``end``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, fold: bool) -> None:
        low = int(offsets[0])
        part = data[low : int(offsets[-1])]
        self.first, self.n_docs, self.bytes = first, len(offsets) - 1, part
        self.offsets = offsets - low
        space = SPACE[part]
        word = ~space
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[self.offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= space[:-1] | edge[1:-1]
        ends[:-1] &= space[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.local = np.searchsorted(self.offsets[1:], self.start, side="right")
        up, down = powers(len(part) + 1)
        folded = FOLD[part] if fold else part
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.count = np.bincount(self.local, minlength=self.n_docs)
        self.upto = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of the k words from each word on; meaningful where those lie in one document."""
        n = len(self.hash)
        out, factor = np.zeros(max(n - k + 1, 0), dtype=np.uint64), np.uint64(1)
        for j in range(k):
            out += self.hash[j : j + len(out)] * factor
            factor = np.uint64((int(factor) * int(STEP)) & 0xFFFFFFFFFFFFFFFF)
        return mix(out + np.uint64(k))


def chunks(column: pa.Array, fold: bool) -> Iterator[Words]:
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Words(data, offsets[first : last + 1], first, fold)
        first = last
