"""Vectorised text kernels over Arrow string buffers.

Everything works on the UTF-8 bytes of a slice of documents at once, so no
Python code runs per word.  Slices are bounded by bytes, not rows; only a
single text longer than the bound makes a slice larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 20
_powers: dict[str, np.ndarray] = {}


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over bytes, true inside any of the inclusive ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that are separated by blanks.
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of digits, small letters and whatever is not ASCII.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Slice:
    """Some rows of a batch: their first row, the bytes, and n+1 offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[Slice]:
    """Cut a string column into slices of at most ``limit`` bytes (one row at least); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield Slice(at, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` bytes within each row, and n+1 run offsets by row."""
    n = len(data)
    inside = table[data]
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    if n:
        first[0], last[-1] = inside[0], inside[-1]
        np.greater(inside[1:], inside[:-1], out=first[1:])
        np.greater(inside[:-1], inside[1:], out=last[:-1])
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power(which: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(which)
    if got is None or len(got) < n:
        size = max(n, _SPAN + 4096)
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, U64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=U64)
        if size <= 2 * _SPAN:
            _powers[which] = got
    return got


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs that do not overlap; memory is bounded by the run length or 1 MiB."""
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power("up", _BASE, hi - lo + 1), _power("down", _INVERSE, hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out)


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole words and of their first n characters, a column each, and which words are that long."""
    head = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at = np.searchsorted(head, starts)
    cuts = [ends] + [head[np.minimum(at + n, len(head) - 1)] for n in lengths]
    there = np.column_stack([np.ones(len(starts), bool)] + [c < ends for c in cuts[1:]])
    out = np.zeros((len(starts), len(cuts)), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power("up", _BASE, hi - lo + 1), _power("down", _INVERSE, hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=total[1:])
        s = starts[i:j] - lo
        for k, cut in enumerate(cuts):
            out[i:j, k] = mix((total[np.minimum(cut[i:j], ends[i:j]) - lo] - total[s]) * inverse[s] + U64(k))
        i = j
    return out, there


def per_row(values: np.ndarray, offsets: np.ndarray, how=np.add, empty=0) -> np.ndarray:
    """``how``.reduceat over the rows given by n+1 offsets; rows without values give ``empty``."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = how.reduceat(values, offsets[:-1][full])
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each value, the row that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def binary_column(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
