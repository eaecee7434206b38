"""Rolling hashes of bytes and words, as numpy arrays over whole blocks of documents.

The hash of ``t[i:j]`` is ``(S[j] - S[i]) * B**-i`` modulo 2**64, where ``S`` is the
running sum of ``code(t[k]) * B**k``. ``B`` is odd, hence invertible, so one running sum
gives the hash of every substring. Byte codes are random 64-bit numbers, and every result
is mixed before use. All windows hashed here have bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer documents are cut into overlapping pieces.
BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_CODES = _CODES[_LOWER]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (finaliser of splitmix64); changes ``x``."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Sums:
    """Running sums of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        forward, self.inverse = _power(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * forward[:-1], out=self.sums[1:])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the ``n`` codes from every position, in order."""
        count = max(len(self.sums) - n, 0)
        return mix((self.sums[n : n + count] - self.sums[:count]) * self.inverse[:count])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the codes of each span."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(_CODES[data])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_spans(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every document.

    ``offsets`` begin at 0 and are the documents' borders in ``data``. A word is a run of
    bytes that are not marked in ``between`` (space and 0x09 to 0x0D) within one document.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~between[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    first, last = borders[inside[borders + 1]], borders[inside[borders]] - 1
    starts[first] = True
    ends[last] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    """Hash of every word, in pieces of at most ``BLOCK`` bytes (or one longer word)."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(end, start[at] + BLOCK, "right")), at + 1)
        base = start[at]
        sums = Sums(codes[data[base : end[to - 1]]])
        out[at:to] = sums.spans(start[at:to] - base, end[at:to] - base)
        at = to
    return out


def ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number of ``n``, one after the other."""
    starts = np.cumsum(n) - n
    return np.arange(n.sum()) - np.repeat(starts, n)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of all numbers, then the next ones: high bytes are mostly equal."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def numbers(data: bytes, width: int) -> np.ndarray:
    """The numbers that :func:`planes` has written."""
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()
