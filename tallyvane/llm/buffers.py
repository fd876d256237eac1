"""Words of many texts at once, as numpy arrays over Arrow string buffers.

Texts of a batch are cut into pieces of a few MB (a longer text is a piece of its
own), so memory follows the piece and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, UNBASE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z become a-z, every other byte stays.
LOWER = SAME.copy()
LOWER[65:91] += 32


@dataclass
class Piece:
    """Rows ``first`` to ``last`` of a batch; ``start[i]:start[i + 1]`` are text i's bytes in ``data``."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = 2_000_000) -> Iterator[Piece]:
    """UTF-8 bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Piece(first, min(last, n), data[at[first]:at[min(last, n)]], at[first:min(last, n) + 1] - at[first])
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def words(piece: Piece, fold: np.ndarray = SAME, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the piece, and the number of the first word of each text (one more at the end)."""
    data = piece.data if fold is SAME else fold[piece.data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    edge = piece.start[1:-1]  # a text's first byte never continues the last word of the text before
    here, before = inside[1:], inside[:-1]
    begins, ends = here & ~before, before & ~here
    begins[edge] = here[edge]
    ends[edge] = before[edge]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return begin, end, np.searchsorted(begin, piece.start)


_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, kept for the longest piece so far."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, UNBASE)):
            _POWERS[i] = np.full(n + n // 4, base, U)
            _POWERS[i][0] = 1
            np.cumprod(_POWERS[i], out=_POWERS[i])
    return _POWERS


def word_hashes(piece: Piece, begin: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one running polynomial sum."""
    data = (piece.data if fold is SAME else fold[piece.data]).astype(U) + U(1)
    n = len(data)
    power, down = _powers(n + 1)
    total = np.zeros(n + 1, U)
    data *= power[:n]
    np.cumsum(data, out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U))


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (over the whole array; the caller drops those across texts)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for i in range(k):
        out = out * U(0xD6E8FEB86659FD93) + h[i:i + n]
    return mix(out)
