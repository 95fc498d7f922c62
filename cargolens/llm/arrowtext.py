"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer with row offsets, so tokenising and
hashing are a few numpy passes over the bytes. Hashes of bytes are polynomials
mod 2**64, finalised by a mixer: quick, but texts can be made that collide, so
they choose anchors and candidates, and whoever cuts or links compares bytes.
Hashes of words are made from distinct words by a hash without such structure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse mod 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _RADIX, np.uint64), np.full(size, _RADIX_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; any slice's hash follows by one subtraction."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end) of what sums was made from."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if off is not None and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes: (first row, end row, bytes, offsets from 0)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words split at ASCII white space: their byte starts, byte ends, and each row's first word (len rows + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rough_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash for each word, after A-Z became a-z: good for counting features, not for equality."""
    return slice_hash(prefix_sums(_LOWER[data]), starts, ends)


def coded_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A code for each word of the rows, each row's first word (len rows + 1), and the distinct words by code.

    Words are compared as bytes, after A-Z became a-z if lower; codes hold for these rows alone.
    """
    texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    whole = pc.greater(pc.binary_length(parts.values), 0)
    known = parts.values.filter(whole).dictionary_encode()
    first = np.r_[0, np.cumsum(whole.to_numpy(zero_copy_only=False))][parts.offsets.to_numpy()]
    return known.indices.to_numpy().astype(np.int64), first, known.dictionary


def hashes_of(known: pa.Array) -> np.ndarray:
    """A hash of each distinct word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, known.cast(pa.large_binary()).to_pylist()), np.uint64, len(known))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and each row's first word."""
    codes, first, known = coded_words(data, offsets, lower)
    return hashes_of(known)[codes], first


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    m, size, n = a, 1, len(a) - w + 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m[:n] if size == w else np.minimum(m[:n], m[w - size : w - size + n])


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Indexes that hold the minimum of some run of w values; U64_MAX is never chosen."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    m = sliding_min(h, w)
    pad = np.zeros(w - 1, np.uint64)
    top = ~sliding_min(~np.concatenate([pad, m, pad]), w)
    return np.flatnonzero((top == h) & (h != U64_MAX))


def per_row(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose i-th row holds the bytes of the next counts[i] values."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.dtype.itemsize, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
