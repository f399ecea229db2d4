"""Texts as lossless WebP images, and a decoder of the whole lossless format.

`encode_texts` stores payloads (UTF-8 bytes, zero-padded to rows of 64) as 16 pixels wide, four bytes a pixel; payloads
over 8 KiB become several images one after the other. An image is written in the smallest of these forms: literals of a
fixed prefix code; back-references, colour-cache references and literals of another; or a palette of few colours with
codes of its own. The choice follows from the image alone, so equal texts give equal files, and a batch of documents is
written in a few array operations. Predictor, cross-colour and green transforms don't shorten text, whose bytes aren't
near their neighbours in value: `encode_image` writes them for whoever stores pictures.

`decode_image` reads any lossless WebP: simple and normal prefix codes, back-references, colour cache, several prefix
groups, and the predictor, cross-colour, subtract-green and palette transforms. `decode_many` reads many images in
step, one token of each at a time, with the same code tables, back-references and caches; images with transforms or
several groups go to `decode_image`.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.memory import trimmed
from folioscope.llm.shingles import mix, slices, string_buffers
from folioscope.session import materialize

WIDTH = 16
ROW_BYTES = 4 * WIDTH
MAX_ROWS = 128
SLICE_BYTES = 4 << 20
#: The cache of texts has 2 ** CACHE_BITS colours; repeats of at least MATCH pixels become back-references.
CACHE_BITS = 7
MATCH = 3
#: Images of at most so many colours are tried with a palette where other forms take over four bits a pixel.
COLOURS = 16

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH_MULTIPLIER = 0x1E35A7BD
MAX_LENGTH = 15


def _near_offsets() -> list[tuple[int, int]]:
    """The 120 short distances (columns left, rows up), nearest first; x is -7..8 and y 0..7."""
    all_ = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted((p for p in all_), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


NEAR = _near_offsets()


# ---------------------------------------------------------------- prefix codes


def code_lengths(weights: list[int], limit: int = MAX_LENGTH) -> list[int]:
    """Huffman code lengths of at most `limit` (small weights are raised until the tree is flat enough)."""
    used = [(w, i) for i, w in enumerate(weights) if w > 0]
    if len(used) < 2:
        return [1 if w > 0 else 0 for w in weights]
    floor = 1
    while True:
        heap = [(max(w, floor), i, (i,)) for w, i in used]
        heapq.heapify(heap)
        depth = [0] * len(weights)
        tie = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
            tie += 1
        if max(depth) <= limit:
            return depth
        floor *= 2


def canonical(lengths: list[int]) -> list[int]:
    """Canonical codes, bit-reversed as the stream wants them."""
    count = [0] * (MAX_LENGTH + 2)
    for n in lengths:
        count[n] += 1
    count[0], code, nxt = 0, 0, [0] * (MAX_LENGTH + 2)
    for n in range(1, MAX_LENGTH + 1):
        code = (code + count[n - 1]) << 1
        nxt[n] = code
    out = []
    for n in lengths:
        if n:
            out.append(int(format(nxt[n], f"0{n}b")[::-1], 2))
            nxt[n] += 1
        else:
            out.append(0)
    return out


class PrefixCode:
    """Decoding table of a canonical code: entry = symbol << 4 | length for every `bits` next bits."""

    def __init__(self, lengths: list[int]):
        used = [i for i, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("empty prefix code")
        if len(used) == 1:  # a code of one symbol takes no bits
            self.bits, self.table = 0, np.array([used[0] << 4], np.int32)
            return
        if sum(1 << (MAX_LENGTH - n) for n in lengths if n) != 1 << MAX_LENGTH:
            raise ValueError("prefix code is not complete")
        self.bits = max(lengths)
        self.table = np.zeros(1 << self.bits, np.int32)
        for symbol, (n, code) in enumerate(zip(lengths, canonical(lengths))):
            if n:
                self.table[code :: 1 << n] = symbol << 4 | n


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.value, self.at, self.size = int.from_bytes(data, "little"), at, 8 * len(data)
        self.words = None
        self.data = data

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise ValueError("truncated image")
        return x

    def symbol(self, code: PrefixCode) -> int:
        e = int(code.table[self.peek(code.bits)]) if code.bits else int(code.table[0])
        self.at += e & 15
        if self.at > self.size:
            raise ValueError("truncated image")
        return e >> 4


def _read_code(r: BitReader, symbols: int) -> PrefixCode:
    lengths = [0] * symbols
    if r.read(1):  # simple: one or two symbols
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return PrefixCode(lengths)
    first = [0] * len(CODE_LENGTH_ORDER)
    for i in range(4 + r.read(4)):
        first[CODE_LENGTH_ORDER[i]] = r.read(3)
    code = PrefixCode(first)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else symbols
    at, previous = 0, 8
    while at < symbols and left > 0:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            previous = s or previous
            continue
        value, n = (previous, 3 + r.read(2)) if s == 16 else (0, 3 + r.read(3)) if s == 17 else (0, 11 + r.read(7))
        if at + n > symbols:
            raise ValueError("code lengths overflow")
        lengths[at : at + n] = [value] * n
        at += n
    return PrefixCode(lengths)


def _read_group(r: BitReader, cache_bits: int) -> list[PrefixCode]:
    return [_read_code(r, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


# ---------------------------------------------------------------- decoder of one image


def _prefixed(r: BitReader, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.read(extra) + 1


def _read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    block, groups_of = 0, None
    n_groups = 1
    if main and r.read(1):
        block = 2 + r.read(3)
        across = -(-width >> block)
        meta = _read_pixels(r, across, -(-height >> block), False)
        groups_of = ((meta >> 8) & 0xFFFF).reshape(-1, across)
        n_groups = int(groups_of.max()) + 1
    groups = [_read_group(r, cache_bits) for _ in range(n_groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else None
    out, total = [], width * height
    filled = 0  # pixels already in the cache

    def remember() -> None:
        nonlocal filled
        while filled < len(out):
            cache[((out[filled] * HASH_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[filled]
            filled += 1

    while len(out) < total:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, distance = groups[int(groups_of[y >> block, x >> block]) if groups_of is not None else 0]
        s = r.symbol(green)
        if s < 256:
            a = r.symbol(red) << 16 | s << 8
            a |= r.symbol(blue)
            out.append(a | r.symbol(alpha) << 24)
        elif s < 280:
            n = _prefixed(r, s - 256)
            d = _prefixed(r, r.symbol(distance))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > len(out) or len(out) + n > total:
                raise ValueError("back-reference outside the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            remember()
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, top_right, top_left):
    """Prediction of one pixel from its neighbours (arrays of four channels, A R G B)."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0], np.int64)
    if mode == 11:
        by_left = np.abs(top - top_left).sum()
        by_top = np.abs(left - top_left).sum()
        return left if by_left < by_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mid = _average(left, top)
        return np.clip(mid + np.trunc((mid - top_left) / 2).astype(np.int64), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: _average(_average(left, top_right), top), 6: lambda: _average(left, top_left), 7: lambda: _average(left, top),
        8: lambda: _average(top_left, top), 9: lambda: _average(top, top_right), 10: lambda: _average(_average(left, top_left), _average(top, top_right)),
    }[mode]()


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def words(planes: np.ndarray) -> np.ndarray:
    p = planes.astype(np.uint32) & 255
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def predictor(argb: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (or take away) each pixel's prediction; `argb` is height x width."""
    height, width = argb.shape
    given = channels(argb)
    out = given.copy()
    truth = out if inverse else given
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = truth[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = truth[y - 1, 0]
            else:
                # Right of the last column, the order of pixels leads to this row's first.
                top_right = truth[y - 1, x + 1] if x + 1 < width else truth[y, 0]
                p = _predict(int(modes[y >> bits, x >> bits]), truth[y, x - 1], truth[y - 1, x], top_right, truth[y - 1, x - 1])
            out[y, x] = (given[y, x] + p if inverse else given[y, x] - p) & 255
    return words(out)


def cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (or take away) the multiples of green and red that each block's element names."""
    height, width = argb.shape
    e = channels(elements)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    signed = lambda v: ((v & 255) ^ 128) - 128
    red_to_blue, green_to_blue, green_to_red = (signed(e[..., k]) for k in (1, 2, 3))
    c = channels(argb)
    green, red, blue = signed(c[..., 2]), c[..., 1], c[..., 3]
    sign = 1 if inverse else -1
    new_red = (red + sign * ((green_to_red * green) >> 5)) & 255
    true_red = signed(new_red if inverse else red)
    new_blue = (blue + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * true_red) >> 5))) & 255
    return words(np.stack([c[..., 0], new_red, c[..., 2], new_blue], axis=-1))


def subtract_green(argb: np.ndarray, inverse: bool) -> np.ndarray:
    c = channels(argb)
    sign = 1 if inverse else -1
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return words(c & 255)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Indices (in the green channel, several a pixel for small tables) to colours; outside the table: 0."""
    bits = _bundle_bits(len(table))
    index = (argb >> 8) & 255
    if bits:
        each = 8 >> bits
        x = np.arange(width)
        index = (index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each)) & ((1 << each) - 1)
    full = np.concatenate([table, np.zeros(256, np.uint32)])
    return full[index]


def _frame(webp: bytes) -> bytes:
    if webp[:4] != b"RIFF" or webp[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    n = int.from_bytes(webp[16:20], "little")
    if webp[20:21] != b"\x2f" or len(webp) < 20 + n:
        raise ValueError("bad lossless chunk")
    return webp[20 : 20 + n]


def decode_image(webp: bytes) -> np.ndarray:
    """ARGB words (height x width) of a lossless WebP file."""
    r = BitReader(_frame(webp), 8)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    return decode_stream(r, width, height)


def decode_stream(r: BitReader, width: int, height: int) -> np.ndarray:
    """ARGB words of an image stream from its transforms on (as files and alpha planes hold it)."""
    steps = []
    while r.read(1):
        kind = r.read(2)
        if any(kind == s[0] for s in steps):
            raise ValueError("transform given twice")
        if kind in (0, 1):
            bits = 2 + r.read(3)
            across = -(-width >> bits)
            data = _read_pixels(r, across, -(-height >> bits), False).reshape(-1, across)
            steps.append((kind, bits, data))
        elif kind == 2:
            steps.append((kind,))
        else:
            n = 1 + r.read(8)
            table = words(np.cumsum(channels(_read_pixels(r, n, 1, False)), axis=0) & 255)
            steps.append((kind, table, width))
            width = -(-width >> _bundle_bits(n))
    out = _read_pixels(r, width, height, True).reshape(height, width)
    for step in reversed(steps):
        if step[0] == 0:
            out = predictor(out, (step[2] >> 8) & 255, step[1], True)
        elif step[0] == 1:
            out = cross_colour(out, step[2], step[1], True)
        elif step[0] == 2:
            out = subtract_green(out, True)
        else:
            out = palette(out, step[1], step[2])
    return out


# ---------------------------------------------------------------- encoder


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def write(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def _write_code(w: BitWriter, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(i < 256 for i in used):
        first = used[0] if used else 0
        w.write(1, 1)
        w.write(len(used) == 2, 1)
        w.write(first > 1, 1)
        w.write(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.write(used[1], 8)
        return
    tokens, i, previous = [], 0, 8
    while i < len(lengths):
        v, run = lengths[i], 1
        while i + run < len(lengths) and lengths[i + run] == v:
            run += 1
        i += run
        if v and v != previous:
            tokens.append((v, 0, 0))
            run, previous = run - 1, v
        while run:
            if v == 0 and run >= 11:
                n = min(run, 138)
                tokens.append((18, n - 11, 7))
            elif v == 0 and run >= 3:
                n = min(run, 10)
                tokens.append((17, n - 3, 3))
            elif v and run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = 1
                tokens.append((v, 0, 0))
            run -= n
    counts = [0] * len(CODE_LENGTH_ORDER)
    for t in tokens:
        counts[t[0]] += 1
    if sum(c > 0 for c in counts) < 2:
        counts[0 if counts[0] == 0 else 1] += 1
    first = code_lengths(counts, 7)
    n = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if first[s]))
    w.write(0, 1)
    w.write(n - 4, 4)
    for s in CODE_LENGTH_ORDER[:n]:
        w.write(first[s], 3)
    w.write(0, 1)
    codes = canonical(first)
    for s, extra, bits in tokens:
        w.write(codes[s], first[s])
        w.write(extra, bits)


def _prefix_of(v: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _write_pixels(w: BitWriter, argb: np.ndarray, main: bool, cache_bits: int = 0, back: bool = False) -> None:
    """An entropy-coded image with one prefix group; `back` looks for repeats (latest equal pixel pair)."""
    flat = argb.reshape(-1).tolist()
    width = argb.shape[1]
    w.write(cache_bits > 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    near = {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR)))}
    cache, latest, tokens, i = [0] * (1 << cache_bits), {}, [], 0
    slot = lambda p: ((p * HASH_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(flat):
        n = 0
        if back and i + 1 < len(flat) and (j := latest.get((flat[i], flat[i + 1]))) is not None:
            while i + n < len(flat) and n < 4096 and flat[i + n] == flat[j + n]:
                n += 1
        if n >= 2:
            d = i - j
            tokens.append(("copy", _prefix_of(n), _prefix_of(near.get(d, d + len(NEAR)))))
        else:
            n = 1
            hit = cache_bits and cache[slot(flat[i])] == flat[i]
            tokens.append(("cache", slot(flat[i])) if hit else ("literal", flat[i]))
        for k in range(i, i + n):
            if cache_bits:
                cache[slot(flat[k])] = flat[k]
            if k:
                latest[(flat[k - 1], flat[k])] = k - 1
        i += n
    counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    for t in tokens:
        if t[0] == "literal":
            for c, s in zip(counts, (8, 16, 0, 24)):
                c[(t[1] >> s) & 255] += 1
        elif t[0] == "cache":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + t[1][0]] += 1
            counts[4][t[2][0]] += 1
    lengths = [code_lengths(c) for c in counts]
    for n in lengths:
        _write_code(w, n)
    codes = [canonical(n) for n in lengths]
    single = [sum(x > 0 for x in n) < 2 for n in lengths]

    def put(k: int, s: int) -> None:
        if not single[k]:
            w.write(codes[k][s], lengths[k][s])

    for t in tokens:
        if t[0] == "literal":
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, (t[1] >> s) & 255)
        elif t[0] == "cache":
            put(0, 280 + t[1])
        else:
            put(0, 256 + t[1][0])
            w.write(*t[1][1:])
            put(4, t[2][0])
            w.write(*t[2][1:])


def riff(chunk: bytes) -> bytes:
    body = b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def encode_image(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, back: bool = True) -> bytes:
    """A lossless WebP file of ARGB words; transforms, in order, of ("predictor", bits, modes), ("cross", bits,
    elements), ("green",) and ("palette", colours)."""
    height, width = argb.shape
    w = BitWriter()
    for x, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(x, n)
    for kind, *given in transforms:
        w.write(1, 1)
        w.write(("predictor", "cross", "green", "palette").index(kind), 2)
        if kind in ("predictor", "cross"):
            bits, data = given
            w.write(bits - 2, 3)
            if kind == "predictor":
                argb = predictor(argb, data, bits, False)
                data = np.uint32(0xFF000000) | data.astype(np.uint32) << 8
            else:
                argb = cross_colour(argb, data, bits, False)
            _write_pixels(w, data, False)
        elif kind == "green":
            argb = subtract_green(argb, False)
        else:
            table = np.asarray(given[0], np.uint32)
            w.write(len(table) - 1, 8)
            planes = channels(table)
            planes[1:] -= channels(table)[:-1]
            _write_pixels(w, words(planes & 255)[None, :], False)
            place = {c: i for i, c in enumerate(table.tolist())}
            index = np.vectorize(place.__getitem__, otypes=[np.uint32])(argb)
            bits = _bundle_bits(len(table))
            if bits:
                each, per = 8 >> bits, 1 << bits
                padded = np.zeros((height, -(-width // per) * per), np.uint32)
                padded[:, :width] = index
                index = sum(padded[:, k::per] << (k * each) for k in range(per))
            argb = np.uint32(0xFF000000) | index << 8
    w.write(0, 1)
    _write_pixels(w, argb, True, cache_bits, back)
    return riff(w.bytes())


# ---------------------------------------------------------------- the fixed codes of texts


@dataclass
class TextCode:
    """Code lengths and codes of green (literals, lengths, cache), other channels and distances, and the header's bits
    after the image size, with their number."""

    green: tuple[np.ndarray, np.ndarray]
    other: tuple[np.ndarray, np.ndarray]
    distance: tuple[np.ndarray, np.ndarray]
    header: int
    header_bits: int


@lru_cache(maxsize=2)
def text_code(repeats: bool) -> TextCode:
    """The fixed code of literals alone, or with repeats (back-references and cache).

    Fixed weights by rule: space, small letters by a usual order of frequency, then capitals, digits and punctuation,
    bytes of two-byte characters, and all others alike; of repeats, cached colours make about a seventh of all tokens,
    back-references a tenth, short ones more often, far ones more often."""
    weight = [1] * 256
    weight[32] = 800
    for rank, c in enumerate(b"etaoinshrdlcumwfgypbvkjxqz"):
        weight[c] = 2048 >> (rank // 4 + 1) if rank < 20 else 32
        weight[c - 32] = 16
    for c in range(33, 65):
        weight[c] = 8
    for c in b",.\n":
        weight[c] = 64
    weight[0xC3] = 64
    for c in range(0xA0, 0xC0):
        weight[c] = 8
    total = sum(weight)
    lengths = code_lengths(weight, 14)
    far = [0] * 40
    if repeats:
        runs = [max(1, total // 10 >> 1 + k // 2) for k in range(24)]
        green = code_lengths([*weight, *runs, *[total // 6 >> CACHE_BITS] * (1 << CACHE_BITS)], 14)
        far = code_lengths([1 + k if k < 26 else 0 for k in range(40)], 14)
    else:
        green = lengths + [0] * 24
    w = BitWriter()
    w.write(0, 1)  # no transform
    w.write(int(repeats), 1)
    if repeats:
        w.write(CACHE_BITS, 4)
    w.write(0, 1)  # one prefix group
    for code in (green, lengths, lengths, lengths, far):
        _write_code(w, code)
    table = lambda code: (np.array(code, np.uint64), np.array(canonical(code), np.uint64))
    return TextCode(table(green), table(lengths), table(far), w.value, w.n)


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_prefix_of` over an array: symbols, extra values and extra bits."""
    small = v <= 4
    x = np.where(small, 2, v - 1)
    top = np.frexp(x.astype(np.float64))[1] - 1
    symbol = 2 * top + (x >> (top - 1) & 1)
    return np.where(small, v - 1, symbol), np.where(small, 0, x & ((1 << (top - 1)) - 1)), np.where(small, 0, top - 1)


def _slots(argb: np.ndarray, bits: int) -> np.ndarray:
    return ((argb.astype(np.uint64) * np.uint64(HASH_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)


def _repeats(argb: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references within images, none over another.

    Each pixel looks to the last place in its image with its MATCH next pixels; neighbours that look equally far back
    make one reference, cut where the one before it ends."""
    n = len(argb) - MATCH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    key = mix(image[:n].astype(np.uint64))
    for k in range(MATCH):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + argb[k : n + k])
    order = np.argsort(key, kind="stable")
    back = np.zeros(n, np.int64)
    here, there = order[1:], order[:-1]
    same = (key[here] == key[there]) & (image[here] == image[there]) & (image[here] == image[here + MATCH - 1])
    for k in range(MATCH):
        same &= argb[here + k] == argb[there + k]
    back[here[same]] = (here - there)[same]
    edge = np.concatenate([[True], back[1:] != back[:-1]])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], n) + MATCH - 1
    used = back[begin] > 0
    begin, stop = begin[used], stop[used]
    far = back[begin]
    begin = np.maximum(begin, np.concatenate([[0], stop[:-1]])) if len(begin) else begin
    used = stop - begin >= MATCH
    return begin[used], (stop - begin)[used], far[used]


def _tokens(planes: np.ndarray, image: np.ndarray, repeats: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, their numbers and the image of each token of images of `planes` (pixels x R G B A)."""
    code = text_code(repeats)
    value, size = np.zeros(len(planes), np.uint64), np.zeros(len(planes), np.uint64)
    for k in (1, 0, 2, 3):  # green first, as read
        length, bits = code.green if k == 1 else code.other
        b = planes[:, k]
        value |= bits[b] << size
        size += length[b]
    if not repeats:
        return value, size, image
    wide = planes.astype(np.uint64)
    argb = wide[:, 3] << np.uint64(24) | wide[:, 0] << np.uint64(16) | wide[:, 1] << np.uint64(8) | wide[:, 2]
    slot = _slots(argb, CACHE_BITS)
    order = np.argsort(image << CACHE_BITS | slot, kind="stable")
    here, there = order[1:], order[:-1]
    hit = here[(image[here] == image[there]) & (argb[here] == argb[there])]  # equal colours share a slot
    length, bits = code.green
    value[hit], size[hit] = bits[280 + slot[hit]], length[280 + slot[hit]]
    begin, run, far = _repeats(argb, image)
    near = np.zeros(1 << 8, np.int64)
    for k, (dx, dy) in reversed(list(enumerate(NEAR))):
        near[max(1, dx + dy * WIDTH)] = k + 1
    step = np.where((far < len(near)) & (near[np.minimum(far, len(near) - 1)] > 0), near[np.minimum(far, len(near) - 1)], far + len(NEAR))
    v, n = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for (symbol, extra, more), (length, bits), base in ((_prefixes(run), code.green, 256), (_prefixes(step), code.distance, 0)):
        v |= bits[base + symbol] << n
        n += length[base + symbol]
        v |= extra.astype(np.uint64) << n
        n += more.astype(np.uint64)
    value[begin], size[begin] = v, n
    inside = np.zeros(len(planes) + 1, np.int64)
    np.add.at(inside, begin + 1, 1)
    np.add.at(inside, begin + run, -1)
    kept = np.cumsum(inside)[:-1] == 0
    return value[kept], size[kept], image[kept]


def _files(value: np.ndarray, size: np.ndarray, count: np.ndarray, rows: np.ndarray, code: TextCode) -> list[bytes]:
    """Files of images of `rows` rows from their tokens' bits, `count` of them each, one after the other."""
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    ends = np.cumsum(size.astype(np.int64))
    begins = ends - size.astype(np.int64)
    base = begins[at[:-1]]
    bits = 40 + code.header_bits + ends[at[1:] - 1] - base  # of each file's chunk
    n_words = -(-bits // 64) + 1
    word_at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n_words, out=word_at[1:])
    out = np.zeros(word_at[-1], np.uint64)
    where = begins + np.repeat(64 * word_at[:-1] + 40 + code.header_bits - base, count)
    word, shift = where >> 6, (where & 63).astype(np.uint64)
    firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[firsts]] = np.bitwise_or.reduceat(value << shift, firsts)
    over = np.flatnonzero(shift + size > np.uint64(64))
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    head = np.frombuffer((code.header << 40).to_bytes(-(-(code.header_bits + 40) // 64) * 8, "little"), np.uint64)
    for i, h in enumerate(head):
        out[word_at[:-1] + i] |= h
    out[word_at[:-1]] |= np.uint64(0x2F) | np.uint64(WIDTH - 1) << np.uint64(8) | (rows - 1).astype(np.uint64) << np.uint64(22) | np.uint64(1) << np.uint64(36)
    raw, n_bytes = out.view(np.uint8), -(-bits // 8)
    return [riff(raw[8 * w : 8 * w + n].tobytes()) for w, n in zip(word_at[:-1].tolist(), n_bytes.tolist())]


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One file for each run of whole rows data[offsets[i]:offsets[i + 1]] (multiples of 64 bytes, at most MAX_ROWS)."""
    n = len(offsets) - 1
    rows = np.diff(offsets) // ROW_BYTES
    planes = data.reshape(-1, 4)  # R G B A
    image = np.repeat(np.arange(n), rows * WIDTH)
    forms = [_tokens(planes, image, repeats) for repeats in (False, True)]
    bits = np.array([np.bincount(own, size.astype(np.float64), n) + text_code(k == 1).header_bits for k, (_, size, own) in enumerate(forms)])
    form = bits.argmin(axis=0)
    out: list[bytes] = [b""] * n
    for k, (value, size, own) in enumerate(forms):
        chosen = np.flatnonzero(form == k)
        if len(chosen):
            mine = form[own] == k
            count = np.bincount(own[mine], minlength=n)[chosen]
            for i, f in zip(chosen.tolist(), _files(value[mine], size[mine], count, rows[chosen], text_code(k == 1))):
                out[i] = f
    pixels = planes.copy().view("<u4").reshape(-1).astype(np.int64)
    for i in np.flatnonzero(bits.min(axis=0) > 4 * rows * WIDTH + 1024).tolist():
        own = pixels[offsets[i] // 4 : offsets[i + 1] // 4]
        if len(own) >= 512 and len(np.unique(own[:64])) <= COLOURS and len(np.unique(own)) <= COLOURS:
            argb = words(np.roll(planes[offsets[i] // 4 : offsets[i + 1] // 4].astype(np.int64), 1, axis=1)).reshape(-1, WIDTH)
            f = encode_image(argb, (("palette", np.unique(argb)),))
            out[i] = min(out[i], f, key=len)
    return out


def encode_texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each text: its images one after the other."""
    sizes = np.diff(offsets)
    padded = np.maximum(-(-sizes // ROW_BYTES), 1) * ROW_BYTES
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(padded, out=at[1:])
    payload = np.zeros(at[-1], np.uint8)
    source = data[offsets[0] : offsets[-1]]
    payload[np.arange(len(source)) + np.repeat(at[:-1] - (offsets[:-1] - offsets[0]), sizes)] = source
    most = MAX_ROWS * ROW_BYTES
    pieces = -(-padded // most)
    starts = np.concatenate([np.arange(a, b, most) for a, b in zip(at[:-1].tolist(), at[1:].tolist())] + [at[-1:]])
    files, out, k = encode_payloads(payload, starts), [], 0
    for n in pieces.tolist():
        out.append(b"".join(files[k : k + n]))
        k += n
    return out


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


class _Header:
    """A parsed header of a plain image (no transform or second group), told by its bits."""

    def __init__(self, chunk: bytes):
        r = BitReader(chunk, 40)
        self.plain = r.read(1) == 0
        if self.plain:
            self.cache_bits = r.read(4) if r.read(1) else 0
            self.plain = self.cache_bits <= 11 and r.read(1) == 0
        if self.plain:
            self.group = _read_group(r, self.cache_bits)
        self.bits = r.at
        whole, rest = divmod(self.bits, 8)
        self.bytes, self.mask = chunk[5:whole], (1 << rest) - 1
        self.last = chunk[whole] & self.mask if rest else 0

    def fits(self, chunk: bytes) -> bool:
        n = 5 + len(self.bytes)
        return chunk[5:n] == self.bytes and (not self.mask or (len(chunk) > n and chunk[n] & self.mask == self.last))


_HEADERS: list[_Header] = []


def _header(chunk: bytes) -> _Header:
    for h in _HEADERS:
        if h.fits(chunk):
            return h
    h = _Header(chunk)
    if h.plain:
        _HEADERS.insert(0, h)
        del _HEADERS[8:]
    return h


def _rgba(argb: np.ndarray) -> np.ndarray:
    """Bytes R G B A of ARGB words, in pixel order."""
    return np.stack([(argb >> s) & 255 for s in (16, 8, 0, 24)], axis=-1).astype(np.uint8).reshape(-1)


def _in_step(chunks: list[bytes], widths: np.ndarray, n: np.ndarray, header: _Header) -> list[np.ndarray | None]:
    """Pixel bytes of plain images of `widths` columns and `n` pixels with one header; None where one is damaged."""
    sizes = [-(-len(c) // 4) * 4 for c in chunks]
    starts = np.zeros(len(chunks) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    raw = b"".join(c.ljust(s, b"\0") for c, s in zip(chunks, sizes)) + bytes(16)
    half = np.frombuffer(raw, "<u4").astype(np.uint64)
    pairs = half[:-1] | half[1:] << np.uint64(32)
    last = len(pairs) - 2
    base = np.zeros(len(chunks) + 1, np.int64)
    np.cumsum(n, out=base[1:])
    out = np.zeros(base[-1], np.uint32)
    position = starts[:-1] * 8 + header.bits
    limits = starts[:-1] * 8 + 8 * np.array([len(c) for c in chunks], np.int64)
    filled = np.zeros(len(chunks), np.int64)
    failed = np.zeros(len(chunks), bool)
    tables = [(c.table, np.uint64((1 << c.bits) - 1)) for c in header.group]
    cache = np.zeros((len(chunks), 1 << header.cache_bits), np.uint32) if header.cache_bits else None
    near = np.array(NEAR)

    def window(p: np.ndarray) -> np.ndarray:
        """At least 33 bits from bit p on."""
        return pairs[np.minimum(p >> 5, last)] >> (p & 31).astype(np.uint64)

    def symbol(k: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, mask = tables[k]
        e = table[(bits & mask).astype(np.int64)]
        return e >> 4, (e & 15).astype(np.int64)

    def prefixed(s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of length or distance symbols, and the bit positions after their extra bits."""
        s = s.astype(np.int64)
        extra = np.maximum((s - 2) >> 1, 0)
        more = (window(p) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + more + 1), p + extra

    active = np.flatnonzero(filled < n)
    while len(active):
        p = position[active]
        bits = window(p)
        green, used = symbol(0, bits)
        p = p + used
        literal = np.flatnonzero(green < 256)
        own, q = active[literal], p[literal]
        red, used = symbol(1, bits[literal] >> used[literal].astype(np.uint64))
        q = q + used
        bits = window(q)
        blue, used = symbol(2, bits)
        alpha, more = symbol(3, bits >> used.astype(np.uint64))
        p[literal] = q + used + more
        argb = alpha.astype(np.uint32) << np.uint32(24) | (red << 16 | green[literal] << 8 | blue).astype(np.uint32)
        out[base[own] + filled[own]] = argb
        filled[own] += 1
        if cache is not None:
            cache[own, _slots(argb, header.cache_bits)] = argb
            cached = np.flatnonzero(green >= 280)
            own = active[cached]
            out[base[own] + filled[own]] = cache[own, green[cached] - 280]
            filled[own] += 1
        copies = np.flatnonzero((green >= 256) & (green < 280))
        if len(copies):
            own = active[copies]
            length, q = prefixed(green[copies] - 256, p[copies])
            s, used = symbol(4, window(q))
            far, q = prefixed(s, q + used)
            p[copies] = q
            code = np.minimum(far, len(near)) - 1
            far = np.where(far > len(near), far - len(near), np.maximum(1, near[code, 0] + near[code, 1] * widths[own]))
            wrong = (far > filled[own]) | (filled[own] + length > n[own])
            failed[own[wrong]] = True
            own, length, far = own[~wrong], length[~wrong], far[~wrong]
            k = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            to = np.repeat(base[own] + filled[own], length)
            far = np.repeat(far, length)
            argb = out[to - far + k % far]
            out[to + k] = argb
            if cache is not None:
                cache[np.repeat(own, length), _slots(argb, header.cache_bits)] = argb  # of equal slots the last stays
            filled[own] += length
        position[active] = p
        failed[active] |= p > limits[active]
        active = active[(filled[active] < n[active]) & ~failed[active]]
    done: list[np.ndarray | None] = [None] * len(chunks)
    for i in np.flatnonzero(~failed).tolist():
        done[i] = _rgba(out[base[i] : base[i + 1]])
    return done


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixel bytes (R G B A) of each file."""
    chunks = [_frame(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    groups: dict[int, tuple[_Header, list[int]]] = {}
    for i, c in enumerate(chunks):
        h = _header(c)
        if h.plain:
            groups.setdefault(id(h), (h, []))[1].append(i)
    for h, some in groups.values():
        size = np.array([int.from_bytes(chunks[i][1:5], "little") for i in some], np.int64)
        widths, heights = (size & 0x3FFF) + 1, ((size >> 14) & 0x3FFF) + 1
        for i, x in zip(some, _in_step([chunks[i] for i in some], widths, widths * heights, h)):
            out[i] = x
    return [_rgba(decode_image(f)) if x is None else x for f, x in zip(files, out)]


# ---------------------------------------------------------------- columns


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored media of every row (null text: empty)."""

    def run(batches):
        for b in batches:
            data, offsets = string_buffers(b.column("text"))
            for lo, hi in slices(offsets, SLICE_BYTES):
                media = encode_texts(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, media binary")


def decode_column(media: DataFrame, pixels: bool = True) -> DataFrame:
    """Digests and features of every row of `media` (doc_id, n_bytes, media), from the pixels of its images; with
    `pixels`, these too, as bytes of a (rows, 16, 4) array."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pixels"] * pixels
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pixels binary" * pixels

    def describe(ids, n_bytes, stored):
        files = [split_files(m) for m in stored]
        images, k, rows = decode_many([f for some in files for f in some]), 0, []
        for m, some in zip(stored, files):
            x = images[k] if len(some) == 1 else np.concatenate(images[k : k + len(some)])
            k += len(some)
            mean, high = x.mean(dtype=np.float64), int(np.count_nonzero(x > 127))
            rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{len(x) // ROW_BYTES}x{WIDTH}x4;mean={mean:.4f};max={int(x.max())};high={high}", x.tobytes() if pixels else None))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * pixels
        return pa.RecordBatch.from_arrays([ids, n_bytes, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names=names)

    def run(batches):
        for b in batches:
            stored, lo, size = b.column("media").to_pylist(), 0, 0
            for i, m in enumerate([*stored, b""]):
                if i > lo and (i == len(stored) or size + len(m) > SLICE_BYTES):
                    yield describe(b.column("doc_id").slice(lo, i - lo), b.column("n_bytes").slice(lo, i - lo), stored[lo:i])
                    lo, size = i, 0
                size += len(m)

    return media.mapInArrow(trimmed(run), schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text of `docs` as media in the shared folder, read it back, and give its pixel array and digests.

    Null and empty texts are one row of zero bytes; repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result."""
    return decode_column(materialize(encode_column(docs), "media"))
