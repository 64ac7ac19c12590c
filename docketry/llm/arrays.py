"""Vectorised word and shingle arrays over Arrow string columns.

Every function works on the UTF-8 buffer of a column, a slice of about
``SLICE`` bytes at a time, so the memory of a task does not depend on how many
rows an Arrow batch holds.  A document longer than a slice is one slice.
A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_GAPS = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII characters that are neither letters nor digits also part words here.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
RAW = np.arange(256, dtype=np.uint8)
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * _GAPS[0]
    x ^= x >> U(27)
    x *= _GAPS[1]
    x ^= x >> U(31)
    return x


_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of rolling hashes, and of its inverse."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``size`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words of some texts: row, byte start and end, hash, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WHITE, fold: np.ndarray = RAW):
        n, rows = len(data), len(offsets) - 1
        inside = ~apart[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            full = offsets[:-1] < offsets[1:]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets[1:], self.start, "right")
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((fold[data].astype(U) + U(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words; a text of fewer words is one run."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at, last = np.arange(n), self.first[self.row + 1]
        hashes = np.zeros(n, U)
        for j in range(k):
            part = np.zeros(n, U)
            part[: n - j] = self.hash[j:]
            part[at + j >= last] = 0
            hashes = hashes * _ODD + part
        keep = (at + k <= last) | ((at == self.first[self.row]) & (at + k > last))
        at = at[keep]
        return at, mix(hashes[keep])


def bags(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, 48 bits of hash) keys in order, and their counts; fewer than 65,536 rows."""
    keys = np.sort((row.astype(U) << U(48)) | (hashes >> U(16)))
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def by_slice(make: Callable, batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """make(rows, bytes, offsets) for each slice of each batch; rows is the batch cut to the slice."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for i, j in cuts(offsets, size):
            for k in range(i, j, 60_000):  # bags() holds the row in 16 bits
                e = min(j, k + 60_000)
                yield make(batch.slice(k, e - k), data[offsets[k] : offsets[e]], offsets[k : e + 1] - offsets[k])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


class Lookup:
    """Finds 64-bit keys in a sorted array of distinct ones.

    Each slot of a table twice as large holds one key, the heaviest of those
    that fall on it, so most searches cost one read; only the others bisect.
    """

    def __init__(self, keys: np.ndarray, weight: np.ndarray | None = None):
        self.keys = keys
        self.shift = U(63 - max(1, int(len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slot_at = np.zeros(size, np.int32)
        self.slot_key = np.zeros(size, U)
        if len(keys):
            order = np.arange(len(keys)) if weight is None else np.argsort(weight, kind="stable")
            self.slot_at[(keys[order] * _ODD) >> self.shift] = order
            self.slot_key = keys[self.slot_at]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether it is there) of each wanted key."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        slot = (wanted * _ODD) >> self.shift
        at = self.slot_at[slot].astype(np.int64)
        hit = self.slot_key[slot] == wanted
        rest = np.flatnonzero(~hit)
        if len(rest):
            near = np.minimum(np.searchsorted(self.keys, wanted[rest]), len(self.keys) - 1)
            at[rest], hit[rest] = near, self.keys[near] == wanted[rest]
        return at, hit
