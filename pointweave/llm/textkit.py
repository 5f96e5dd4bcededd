"""Words, hashes and shingle sets of whole Arrow text columns, without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about max_bytes; a longer text comes alone. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Every word as an Arrow string, and its row. Separators are ASCII, so words are whole UTF-8."""
    starts, ends, rows = word_bounds(data, offsets, separator)
    ends_in_body = np.cumsum(np.append(0, ends - starts))
    body = data[~separator[data]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_in_body), pa.py_buffer(body)), rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row: A-Z lower-cased, a shorter text's words as one shingle."""
    weights = mix(np.arange(1, width + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    for at, end, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        bounds = np.searchsorted(rows, np.arange(end - at + 1))
        counts = np.diff(bounds)
        if len(hashes) >= width:
            grams = hashes[: len(hashes) - width + 1] * weights[0]
            for k in range(1, width):
                grams = grams + hashes[k : len(hashes) - width + 1 + k] * weights[k]
            grams = mix(grams)
        else:
            grams = np.zeros(0, U64)
        for r in range(end - at):
            lo, n = bounds[r], counts[r]
            if n >= width:
                yield at + r, np.unique(grams[lo : lo + n - width + 1])
            elif n:
                short = (hashes[lo : lo + n] * weights[:n]).sum(dtype=U64) + U64(n)
                yield at + r, mix(np.array([short], U64))
            else:
                yield at + r, np.zeros(0, U64)
