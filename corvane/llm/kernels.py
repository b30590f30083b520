"""Vectorised text kernels that run inside Arrow tasks.

Everything here works on the UTF-8 bytes of a whole Arrow string array at once: word
boundaries, polynomial (Rabin-Karp) word hashes and window hashes come from a handful of
numpy passes instead of one Python call per word.  The separators of the contracts
(U+0020, U+0009-U+000D) are single bytes in UTF-8, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd bases of the polynomial hashes and the inverse of each modulo 2**64.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD6E8FEB86659FD93


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Powers:
    """base**i and base**-i modulo 2**64 for i below a length that grows on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, _inverse(base)
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, U64(base))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS: dict[int, Powers] = {}


def powers(base: int) -> Powers:
    return _POWERS.setdefault(base, Powers(base))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_IS_WORD = ~_IS_SPACE
#: Letters by byte: ASCII letters and every byte of a multi-byte character.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BYTE = mix(np.arange(256, dtype=U64), 77) | U64(1)
#: The same, with A-Z sent to a-z.
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def string_chunks(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets from 0) of runs of rows with about ``limit`` bytes.

    A null counts as an empty text.  A single text longer than ``limit`` is a run of its own.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    n = len(array)
    if not n:
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true bytes; no run crosses a row."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(_IS_WORD[data], offsets)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number below the second result for each word, equal for equal words (compared as bytes)."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    held = pa.py_buffer(np.ascontiguousarray(data[_IS_WORD[data]]))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), held]).dictionary_encode()
    return coded.indices.to_numpy(), len(coded.dictionary)


def prefix_sums(data: np.ndarray, base: int = BASE_A, fold: bool = False) -> np.ndarray:
    up, _ = powers(base).upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """One hash for the bytes of each span; equal bytes have equal hashes wherever they stand."""
    _, down = powers(base).upto(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, base: int = BASE_B) -> tuple[np.ndarray, np.ndarray]:
    """First words and Rabin-Karp hashes of all windows of ``width`` words inside one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    up, down = powers(base).upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return at, (sums[at + width] - sums[at]) * down[at]


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each row's items in sorted ``rows``."""
    return np.searchsorted(rows, np.arange(n + 1))


def sum_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)
