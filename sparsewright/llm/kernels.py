"""Vectorised text kernels over Arrow string columns, used inside Arrow functions.

Words are runs of bytes other than ASCII white space.  A word's 64-bit name is a polynomial hash of its
bytes modulo 2^64, taken from prefix sums over the whole buffer, so that no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one call handles at a time; a longer text is handled alone, its bytes in pieces.
SLICE_BYTES = 1 << 20
#: Rows that one call handles at a time.
SLICE_ROWS = 2048
_PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _U(0xD6E8FEB86659FD93)


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside the next ones."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for one piece."""
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_PIECE + 1, b, _U)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of `batch` whose column `name` holds at most `limit` bytes, at most `SLICE_ROWS` rows; longer texts come alone."""
    _, offs = raw(batch.column(name))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n, at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """Words of a run of texts: the row, first byte, end and name of each, and each row's first word."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    first: np.ndarray  # of rows + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    n, rows = len(data), len(offs) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, _U), np.zeros(rows + 1, np.int64))
    inside = ~_SPACE[data]
    opens = np.empty(n, bool)
    opens[0] = True
    np.logical_not(inside[:-1], out=opens[1:])
    opens[offs[:-1][offs[:-1] < n]] = True
    closes = np.empty(n, bool)
    closes[-1] = True
    np.logical_not(inside[1:], out=closes[:-1])
    closes[offs[1:][offs[1:] > 0] - 1] = True
    start, end = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    name = np.empty(len(start), _U)
    table, (up, down) = _BYTE_LOWER if lower else _BYTE, _power_tables()
    at = 0
    while at < len(start):  # as many words as fit in a piece
        last = max(at + 1, int(np.searchsorted(end, start[at] + _PIECE, "right")))
        a, z = int(start[at]), int(end[last - 1])
        if z - a > _PIECE:  # one word longer than a piece: fold its pieces
            h = _U(0)
            with np.errstate(over="ignore"):
                for p in range(a, z, _PIECE):
                    part = table[data[p : min(p + _PIECE, z)]]
                    h = mix(np.array([h * _STEP + np.sum(part * up[: len(part)], dtype=_U)], _U))[0]
            name[at] = h
        else:
            sums = np.zeros(z - a + 1, _U)
            np.cumsum(table[data[a:z]] * up[: z - a], out=sums[1:])
            s = start[at:last] - a
            name[at:last] = (sums[end[at:last] - a] - sums[s]) * down[s]
        at = last
    name = mix(name + (end - start).astype(_U) * _STEP)
    row = np.searchsorted(offs, start, "right") - 1
    return Words(row, start, end, name, np.searchsorted(start, offs))


def grams(name: np.ndarray, k: int) -> np.ndarray:
    """Names of the runs of `k` consecutive names; those that cross rows are for the caller to leave out."""
    n = len(name) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = name[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += name[j : j + n]
    return mix(out)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the position of its smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = best[step:] < best[:-step]
        best, at, size = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step]), size + step
    return at


def pieces(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start:start+length] for all pairs, one after another."""
    total = int(length.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(length)
    index = np.arange(total) + np.repeat(start - (ends - length), length)
    return values[index]


def binary_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose rows hold `lengths` consecutive 8-byte `values` each."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * 8, out=offs[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
