"""Words and word hashes of whole texts, computed with numpy over the bytes of Arrow batches.

A batch is walked in slices of a bounded number of bytes; only a single text can make a slice
larger, and its words are hashed in pieces of that size.  All hashes are 64 bits wide and depend
on the bytes alone, so every task gives equal words equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits (the splitmix64 finalizer)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_class(ranges) -> np.ndarray:
    """256 flags; `ranges` are inclusive pairs of byte values."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: Word bytes: all but ASCII white space; letters, digits and bytes over 127; letters and bytes over 127.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LETTERS = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges whose bytes stay under `most`, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batch_slices(batch, column: str, most: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of the slices of one Arrow batch."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for i, j in slices(offsets, most):
        at = offsets[i:j + 1]
        yield i, j, data[at[0]:at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; a run never crosses from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


_powers = {}


def _power_tables(n: int):
    if _powers.get("n", 0) < n:
        size = max(n, SLICE_BYTES + 64)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[name] = np.cumprod(table)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def _hash_piece(data, starts, ends):
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD1B54A32D192ED03))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 2 * SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each run of bytes; long inputs are hashed piece by piece between runs."""
    if len(data) <= most:
        return _hash_piece(data, starts, ends)
    out, i = np.empty(len(starts), _U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        out[i:j] = _hash_piece(data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True):
    """(hash, text number, start, end) of every word, in order; A-Z counts as a-z with `lower`."""
    data = LOWER[data] if lower else data
    starts, ends = word_bounds(data, offsets, is_word)
    return word_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def hash_of(word: str) -> int:
    """The hash that words_of gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_hash_piece(LOWER[raw], np.array([0]), np.array([len(raw)]))[0])


def first_index(owners: np.ndarray, n: int) -> np.ndarray:
    """n + 1 positions: where the words of each text begin in a list sorted by text."""
    return np.searchsorted(owners, np.arange(n + 1))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<long> rows from one flat array."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
