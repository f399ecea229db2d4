"""Word shingles of many texts at once, as 64-bit hashes, over the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDTH = 5
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20
PIECE_BYTES = 1 << 17
#: Bytes 9 to 13 and 32 separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each; one pair of tables a worker."""
    if not _POWERS:
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off.astype(np.int64)


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges whose bytes are at most `size` (a longer row comes alone)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def _short_spans(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial of each text[start[i]:stop[i]]: differences of one running sum, shifted to begin at power 0."""
    up, down = _powers(PIECE_BYTES)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    return (sums[stop] - sums[start]) * down[start]


def span_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each text[start[i]:stop[i]] (spans in rising order, none inside another).

    Spans are worked off in pieces of at most PIECE_BYTES of the text, and a longer span in parts of that size, so the
    memory used beside the result doesn't grow with the text."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = int(start[i])
        j = int(np.searchsorted(stop, base + PIECE_BYTES, "right"))
        if j > i:
            out[i:j] = _short_spans(text[base : int(stop[j - 1])], start[i:j] - base, stop[i:j] - base)
            i = j
            continue
        value, factor, step = 0, 1, pow(BASE, PIECE_BYTES, 1 << 64)
        for at in range(base, int(stop[i]), PIECE_BYTES):
            part = text[at : min(at + PIECE_BYTES, int(stop[i]))]
            value += factor * int(_short_spans(part, np.zeros(1, np.int64), np.array([len(part)]))[0])
            factor = factor * step & 0xFFFFFFFFFFFFFFFF
        out[i] = value & 0xFFFFFFFFFFFFFFFF
        i += 1
    return mix(out + (stop - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (ASCII letters in lower case) of the rows, and the rows' offsets (n + 1) into them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = LOWER[data[lo:hi]]
    inside = ~SEPARATOR[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1] - lo
    cut = cut[cut < len(text)]
    begins[cut] = inside[cut]
    stops = inside.copy()
    stops[:-1] &= begins[1:] | ~inside[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return span_hashes(text, start, stop), np.searchsorted(start, offsets - lo)


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """White-space-delimited words of each text."""
    lo = int(offsets[0])
    inside = ~SEPARATOR[data[lo : int(offsets[-1])]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1] - lo
    cut = cut[cut < len(inside)]
    begins[cut] = inside[cut]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:] - lo] - total[offsets[:-1] - lo]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles row by row (repeats kept) and the rows' offsets.

    A row with fewer words has its whole sequence as one shingle; a row without words has none."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out_at[1:])
    long = counts >= width
    rows = np.repeat(np.arange(len(n)), n)
    first = at[:-1][rows] + (np.arange(out_at[-1]) - out_at[:-1][rows])
    length = np.where(long, width, counts)[rows]
    h = length.astype(np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        part = padded[first + k]
        if not long.all():
            part = np.where(length > k, part, np.uint64(0))
        h = h * factor + part
    return mix(h), out_at


def shingle_sets(column, width: int = WIDTH):
    """Yields (first row, sets) in slices: the sorted distinct shingle hashes of each row."""
    data, offsets = string_buffers(column)
    for a, b in slices(offsets):
        h, at = shingle_hashes(data, offsets[a : b + 1], width)
        sets = []
        for i in range(b - a):
            s = np.sort(h[at[i] : at[i + 1]])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            sets.append(s)
        yield a, sets
