"""Whole-batch text primitives on Arrow buffers: words, their hashes, shingles and lines.

Every function works on all bytes of a piece of a batch at once; there is no loop over rows or
characters. A word is a run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text forms a piece of its own and is never cut.
PIECE_BYTES = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Everything between words of normalised text: white space and ASCII punctuation and signs.
BREAK = SPACE.copy()
BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32



def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_ODD = 0x9E3779B97F4A7C15
_POW, _BACK = powers(_ODD, 1 << 16), powers(pow(_ODD, -1, 1 << 64), 1 << 16)
_HIGH, _HIGH_BACK = powers(pow(_ODD, 1 << 16, 1 << 64), 1 << 16), powers(pow(_ODD, -(1 << 16), 1 << 64), 1 << 16)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Piece:
    """Consecutive rows of a batch: `data` holds their bytes, `bounds` where each row starts."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """All words of a piece in order; `row` counts from the first row of the piece."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    per_row: np.ndarray
    first: np.ndarray  # index of each row's first word

    def __len__(self) -> int:
        return len(self.start)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column's UTF-8 bytes, in pieces of whole rows; a null text is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    if not wide and not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        values = values.cast(pa.string())
    if values.null_count:
        values = values.fill_null(b"" if pa.types.is_binary(values.type) else "")
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(values)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Piece(lo, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def folded(piece: Piece) -> np.ndarray:
    """The bytes with A-Z and the Latin-1 capitals (as UTF-8) in lower case; lengths stay."""
    out = LOWER[piece.data]
    if len(out) > 1:
        lead = out[:-1] == 0xC3
        second = out[1:]
        second[lead & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def words(piece: Piece, gap: np.ndarray = SPACE, data: np.ndarray | None = None) -> Words:
    data = piece.data if data is None else data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[piece.bounds] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge) & inside[1:])
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    first = np.searchsorted(start, piece.bounds)
    per_row = np.diff(first)
    return Words(start, end, np.repeat(np.arange(piece.rows), per_row), per_row, first[:-1])


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice `data[start:end]`, from prefix sums modulo 2**64."""
    n = len(data)
    if n <= len(_POW):
        power = _POW[:n]
    else:
        power = np.multiply.outer(_HIGH[: -(-n // len(_POW))], _POW).ravel()[:n]
    ahead = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power, out=ahead[1:])
    back = _BACK[start & (len(_POW) - 1)]
    if n > len(_POW):
        back = back * _HIGH_BACK[start >> 16]
    return mix((ahead[end] - ahead[start]) * back + (end - start).astype(np.uint64))


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` values, in order; one for each start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[k : k + n]
    return mix(out)


def lines(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every \\n-split line, the empty last ones included; at least one per row."""
    brk = np.flatnonzero(piece.data == 10)
    start = np.sort(np.concatenate([piece.bounds[:-1], brk + 1]), kind="stable")
    end = np.sort(np.concatenate([piece.bounds[1:], brk]), kind="stable")
    return start, end
