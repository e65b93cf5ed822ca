"""Words of texts as flat Arrow and numpy arrays, for functions that run inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20

_libc = None


def lean() -> None:
    """Gives freed memory back to the machine: workers stay beside the executor's heap after their tasks.

    The first call has Arrow use the C library's memory, and large arrays mapped by themselves (1 << 20 bytes on).
    """
    global _libc
    if _libc is None:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except OSError:  # another C library keeps its own ways
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def flat_list(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array and the offsets (n + 1, from 0)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def replaced(lists: pa.Array, where: pa.Array, by: pa.Array) -> pa.Array:
    """lists with the rows of `where` taken from `by`, in order."""
    where = where.to_numpy(zero_copy_only=False)
    take = np.arange(len(lists))
    take[where] = len(lists) + np.arange(len(by))
    return pa.concat_arrays([lists, by]).take(pa.array(take))


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ in order, and where each text's words begin (n + 1 offsets). Null: no words.

    lower: A-Z only.
    """
    texts = pc.fill_null(texts, "")
    parts, offsets = flat_list(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    full = pc.greater(pc.binary_length(parts), 0)
    if pc.all(full).as_py() is not False:
        return parts, offsets
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return parts.filter(full), kept[offsets]


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number in the list of distinct values, and that list."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in all tasks."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in values.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(values))
