"""2-bit codes of all windows of many sequences at once, as numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of sequence that one step works on.
STEP = 1 << 20
_DIGITS = np.full(256, 4, dtype=np.uint8)
_DIGITS[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array in a row, and where each value begins (n + 1 offsets)."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32, count=len(values) + 1, offset=4 * values.offset).astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def codes(digits: np.ndarray, k: int) -> np.ndarray:
    """Codes (two bits a base, first base highest; all 64 bits for k = 32) of all windows of k digits, whatever is in them."""
    n = len(digits) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, width, out, done = digits.astype(np.uint64), 1, None, 0
    left = k
    while left:  # windows of 1, 2, 4, ... digits; those of k's binary places are put together
        if left & 1:
            own = part[done : done + n] if out is None else part[done:]
            out = own if out is None else (out[:n] << np.uint64(2 * width)) | own[:n]
            done += width
        left >>= 1
        if left:
            part = (part[:-width] << np.uint64(2 * width)) | part[width:]
            width *= 2
    return out[:n]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values."""
    n, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values[:n] if size == width else np.minimum(values[:n], values[width - size : width - size + n])


def steps(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, digits, codes, clean) of stretches of all sequences laid end to end: clean windows hold ACGT alone and lie
    within one sequence. A stretch's windows begin where those of the one before it end."""
    ends = np.zeros(len(raw) + 1, dtype=bool)
    ends[offsets[1:]] = True
    for a in range(0, max(0, len(raw) - k + 1), STEP):
        digits = _DIGITS[raw[a : a + STEP + k - 1]]
        bad = np.concatenate(([0], np.cumsum(digits == 4)))
        over = np.concatenate(([0], np.cumsum(ends[a + 1 : a + len(digits)])))  # sequences that end inside
        n = len(digits) - k + 1
        clean = (bad[k:] == bad[:n]) & (over[k - 1 :] == over[:n])
        digits[digits == 4] = 0
        yield a, digits, codes(digits, k), clean


def row_ranges(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows (from, to) that hold `most` bytes together, or one row that holds more."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def located(offsets: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence that each place of the laid-out bytes belongs to, and the place in it."""
    row = np.searchsorted(offsets, places, side="right") - 1
    return row, places - offsets[row]


def as_long(x: np.ndarray) -> pa.Array:
    """Codes as signed longs of the same bits."""
    return pa.array(x.astype(np.uint64).view(np.int64))


_PROSE = np.zeros(256, dtype=np.uint8)
for _i in range(26):
    _PROSE[[ord("a") + _i, ord("A") + _i]] = ord("ACGT"[_i % 4])


def of_prose(values: pa.Array) -> pa.Array:
    """As functions.sequences.from_prose, for many texts at once."""
    raw, offsets = flat(pc.utf8_lower(pc.fill_null(values, "")))
    base = _PROSE[raw]
    kept = base != 0
    ends = np.zeros(len(kept) + 1, dtype=np.int32)
    np.cumsum(kept, out=ends[1:])
    ends = ends[offsets]
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(base[kept])])


def of_pam(kind: str, k: int):
    """Of codes of k bases, which end in GG (NGG), or begin with TTT and another base and don't end in GG (TTTV)."""

    def kept(code: np.ndarray) -> np.ndarray:
        ngg = (code & np.uint64(15)) == np.uint64(10)
        if kind == "NGG":
            return ngg
        return ~ngg & (code >> np.uint64(2 * k - 6) == np.uint64(63)) & (code >> np.uint64(2 * k - 8) != np.uint64(255))

    return kept
