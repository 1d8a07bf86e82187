"""Vectorised word splitting and hashing over Arrow string arrays.

A word is a maximal run of bytes that are not separators; by default separators are space and U+0009..U+000D.
Word hashes are 64-bit polynomial hashes over random byte codes, computed for a whole buffer at once; sequences of
words get hashes of the same form over word hashes.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)

            def table(b: int) -> np.ndarray:
                out = np.full(size, b, U64)
                out[0] = 1
                return np.cumprod(out, dtype=U64)

            self.up, self.down = table(self.base), table(_inverse(self.base))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Words:
    """Words of consecutive texts: byte ranges, hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> None:
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        self.separators = separators
        solid = ~separators[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, bounds)  # text d has words first[d]:first[d + 1]

    def _coded(self, begin: int, end: int) -> np.ndarray:
        codes = _CODES.copy()
        codes[self.separators] = 0
        return codes[self.data[begin:end]] * _BYTES.get(end - begin)[0]

    def _parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that cover about SLICE_BYTES each, so that arrays of 8 bytes for a byte of text stay small."""
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SLICE_BYTES, "right")))
            yield i, j
            i = j

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        for i, j in self._parts():
            low, high = int(self.starts[i]), int(self.ends[j - 1])
            at = self.starts[i:j] - low
            sums = np.add.reduceat(self._coded(low, high), at)
            out[i:j] = mix(sums * _BYTES.get(high - low)[1][at] + (self.ends[i:j] - self.starts[i:j]).astype(U64))
        return out

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: indexes of the words longer than it, and hashes of their first bytes."""
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.int64), np.zeros(0, U64))] for _ in lengths]
        for i, j in self._parts():
            low, high = int(self.starts[i]), int(self.ends[j - 1])
            total = np.zeros(high - low + 1, U64)
            np.cumsum(self._coded(low, high), out=total[1:])
            down, size = _BYTES.get(high - low)[1], self.ends[i:j] - self.starts[i:j]
            for parts, n in zip(found, lengths, strict=True):
                at = np.flatnonzero(size > n)
                s = self.starts[i:j][at] - low
                parts.append((at + i, mix((total[s + n] - total[s]) * down[s] + U64(n << 32))))
        return [(np.concatenate([a for a, _ in parts]), np.concatenate([h for _, h in parts])) for parts in found]


class Sequences:
    """Hashes of runs of consecutive word hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        up, self.down = _WORDS.get(n + 1)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(hashes * up[:n], out=self.total[1:])

    def at(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the length words from begin on, for arrays of begins."""
        size = np.asarray(length, U64) if np.ndim(length) else U64(length)
        return mix((self.total[begin + length] - self.total[begin]) * self.down[begin] + size)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the len + 1 bounds of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``most`` bytes of text each: (rows, bytes, bounds)."""
    data, bounds = texts_of(batch.column(batch.schema.get_field_index(text)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = int(np.searchsorted(bounds, bounds[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin), data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin]
        begin = end


def give_back() -> None:
    """Return memory that is free to the system, at the end of a task: the worker goes on to other work."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
