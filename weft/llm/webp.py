"""Lossless WebP (VP8L): a decoder of the whole format in Python and numpy, an encoder, media columns."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.session import slices

# Fixed values of the format.
SIGNATURE = 0x2F
EXTRA_BITS = (0,) * 16 + (2, 3, 7)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
TRANSFORMS = ("predictor", "cross-colour", "subtract green", "palette")
CACHE_FACTOR = 0x1E35A7BD
OPAQUE_BLACK = 0xFF000000
MAX_SIDE = 16384

#: Bytes in a row of a stored payload, four to a pixel, and rows of one image: longer payloads are several
#: images, so that memory doesn't grow with the text.
ROW = 576
PAYLOAD_ROWS = 1024
#: What stored images are written with: log2 of a block's side, log2 of the colour cache, longest code.
BLOCK_BITS, CACHE_BITS, CODE_BITS = 8, 6, 10


@cache
def near_offsets() -> list[tuple[int, int]]:
    """The 120 short distances: (dx, dy) by length, then |dx|, the positive one first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# Bits


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)

    def ahead(self, n: int) -> tuple[int, int]:
        """The bits from here on, at most up to ``n`` bytes, and how many they are; they count as read."""
        first = self.at >> 3
        part = self.data[first : first + n]
        have = 8 * len(part) - (self.at & 7)
        value = int.from_bytes(part, "little") >> (self.at & 7)
        self.at += have
        return value, have

    def look(self, at: int, n: int) -> int:
        """The ``n`` bits from ``at``, which count as unread."""
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n) if n else 0
        self.at += n
        if self.at > 8 * (len(self.data) - 8):
            raise EOFError("the bit stream ends too early")
        return value


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0
        self.done: list[bytes] = []

    def write_many(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Each value in its number of bits, 64 at most, in order; both are unsigned 64-bit numbers."""
        ends = widths.cumsum()
        starts = ends - widths
        word, at = (starts >> np.uint64(6)).view(np.int64), starts & np.uint64(63)
        out = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, "<u8")
        # Of the values that start in a word only the last can reach into the next one.
        cut = (word[1:] != word[:-1]).nonzero()[0]
        first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(word) - 1]])
        out[word.take(first)] = np.bitwise_or.reduceat(values << at, first)
        out[word.take(last) + 1] |= values.take(last) >> np.uint64(1) >> (np.uint64(63) - at.take(last))
        self.write(int.from_bytes(out.tobytes(), "little"), int(ends[-1]))

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 4096:
            whole = self.n // 8
            self.done.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")

    @property
    def length(self) -> int:
        return 8 * sum(map(len, self.done)) + self.n


@cache
def reversed_bits(n: int) -> np.ndarray:
    """The numbers of ``n`` bits, each with its bits in reverse."""
    v, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
    for i in range(n):
        out |= (v >> i & 1) << (n - 1 - i)
    return out


# Prefix codes

class PrefixCode:
    """A canonical code from its lengths.  ``flat`` is the length that all symbols share (0 for a single
    symbol), or None.  ``entries`` has symbol * 16 + length for every value of the next ``longest`` bits, and
    ``table`` the same as a list."""

    def __init__(self, lengths: bytes):
        n = np.frombuffer(lengths, np.uint8)
        used = np.flatnonzero(n)
        if len(used) < 2:
            self.symbols = used.tolist() or [0]
            self.flat, self.longest, self.mask, self.entries = 0, 0, 0, np.array([self.symbols[0] << 4], np.int64)
            return
        order = used.take(n.take(used).argsort(kind="stable"))
        n = n.take(order).astype(np.int64)
        self.longest = int(n[-1])
        share = 1 << (self.longest - n)
        if self.longest > 15 or share.sum() != 1 << self.longest:
            raise ValueError("a prefix code isn't complete")
        self.symbols = order.tolist()
        self.mask = (1 << self.longest) - 1
        self.flat = self.longest if n[0] == n[-1] else None
        self.entries = (order << 4 | n).repeat(share).take(reversed_bits(self.longest))

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, bits: BitReader) -> int:
        entry = self.table[bits.peek(self.longest)]
        bits.read(entry & 15)
        return entry >> 4


@lru_cache(maxsize=512)
def prefix_code(lengths: bytes) -> PrefixCode:
    """Files of one writer share most of their codes."""
    return PrefixCode(lengths)


@lru_cache(maxsize=4096)
def short_code(alphabet: int, first: int, second: int) -> PrefixCode:
    lengths = bytearray(alphabet)
    lengths[first] = lengths[second] = 1
    return PrefixCode(bytes(lengths))


@lru_cache(maxsize=512)
def length_reader(widths: int) -> PrefixCode:
    """The code of code lengths, from its lengths of three bits each."""
    lengths = bytearray(19)
    for i, k in enumerate(LENGTH_ORDER):
        lengths[k] = widths >> 3 * i & 7
    return PrefixCode(bytes(lengths))


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.peek(1):
        v = bits.peek(19)
        first, n = (v >> 3 & 255, 11) if v & 4 else (v >> 3 & 1, 4)
        second = v >> n & 255 if v & 2 else first
        bits.at += n + (8 if v & 2 else 0)
        bits.read(0)
        return short_code(alphabet, first, second)
    bits.read(1)
    n = 4 + bits.read(4)
    code = length_reader(bits.look(bits.at, 3 * n))
    bits.at += 3 * n
    bits.read(0)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths = bytearray(alphabet)
    table, mask = code.table, code.mask
    i, previous, window, have = 0, 8, 0, 0
    while i < alphabet and left > 0:
        left -= 1
        if have < 14:
            bits.at -= have
            window, have = bits.ahead(16)
        e = table[window & mask]
        n = e & 15
        window >>= n
        have -= n
        if e < 256:
            if e >= 16:
                lengths[i] = previous = e >> 4
            i += 1
            continue
        extra, least, value = ((2, 3, previous), (3, 3, 0), (7, 11, 0))[(e >> 4) - 16]
        n = least + (window & ((1 << extra) - 1))
        window >>= extra
        have -= extra
        if i + n > alphabet:
            raise ValueError("code lengths run over the alphabet")
        if value:
            lengths[i : i + n] = bytes((value,)) * n
        i += n
    bits.at -= have
    bits.read(0)
    return prefix_code(bytes(lengths))


def read_codes(bits: BitReader, alphabets: Sequence[int]) -> list[PrefixCode]:
    """The codes of a group.  A description that repeats the one before bit by bit is the same code."""
    codes: list[PrefixCode] = []
    start = n = before = 0
    for k, alphabet in enumerate(alphabets):
        if k and alphabet == alphabets[k - 1] and bits.look(bits.at, n) == before:
            bits.read(0)
            bits.at += n
            codes.append(codes[-1])
            continue
        start = bits.at
        codes.append(read_code(bits, alphabet))
        n = bits.at - start
        before = bits.look(start, n)
    bits.read(0)
    return codes


# Decoding


def read_extra(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def flat_pixels(bits: BitReader, codes: list[PrefixCode], n: int) -> np.ndarray | None:
    """All pixels at once, where each channel's code has one length and only literals."""
    widths = [c.flat for c in codes[:4]]
    if None in widths or codes[0].symbols[-1] > 255:
        return None
    per = sum(widths)
    out = np.zeros(n, np.uint32)
    raw = None
    if per:
        end = bits.at + per * n
        if end > 8 * (len(bits.data) - 8):
            raise EOFError("the bit stream ends too early")
        view = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 : (end + 7) >> 3]
        raw = np.unpackbits(view, bitorder="little")[bits.at & 7 : (bits.at & 7) + per * n].reshape(n, per)
        bits.at = end
    at = 0
    for code, w, shift in zip(codes, widths, (8, 16, 0, 24), strict=False):
        if w:
            rank = np.packbits(raw[:, at : at + w], axis=1)
            rank = rank[:, 0] >> (8 - w) if w <= 8 else (rank[:, 0].astype(np.uint16) << 8 | rank[:, 1]) >> (16 - w)
            out |= np.array(code.symbols, np.uint32)[rank] << np.uint32(shift)
            at += w
        else:
            out |= np.uint32(code.symbols[0] << shift)
    return out


def back_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = near_offsets()[code - 1]
    return max(1, dx + dy * width)


def _before(keys: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key, or -1."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys.take(order)
    same = (sorted_keys[1:] == sorted_keys[:-1]).nonzero()[0]
    out = np.full(len(keys), -1)
    out[order.take(same + 1)] = order.take(same)
    return out


#: Bits that are looked at together, and how much further a token may reach that starts among them.
STRETCH, BEYOND = 1 << 15, 128


class Stretch:
    """A stretch of the stream, looked up as if a token began at every bit of it.

    ``step`` says where the next token begins; it is -1 for a back-reference and beyond ``end``."""

    def __init__(self, raw: np.ndarray, tables: list[np.ndarray], end: int):
        self.tables = tables
        self.windows = ((raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16)[:, None] >> np.arange(8)).ravel()
        self.windows &= len(tables[0]) - 1
        here = np.arange(len(self.windows))
        green = tables[0].take(self.windows)
        self.other = (green >= 256 << 4).nonzero()[0]
        kind = green.take(self.other) < 280 << 4
        green &= 15
        green += here
        # Where a symbol of each code ends that begins at a bit.
        seen: dict[int, np.ndarray] = {}
        for t in tables[1:]:
            if id(t) not in seen:
                seen[id(t)] = ends = (t & 15).take(self.windows)
                ends += here
        self.green, (self.red, self.blue, alpha) = green, (seen[id(t)] for t in tables[1:])
        step = alpha.take(self.blue, mode="clip").take(self.red, mode="clip").take(green, mode="clip")
        step[self.other] = np.where(kind, -1, green.take(self.other))
        step[end + 1 :] = -1
        self.step = memoryview(step)

    def values(self, places: list[int]) -> np.ndarray:
        """Of the tokens that begin at ``places``: the pixel, or -1 - place for one from the colour cache."""
        at = np.array(places, np.int64)
        symbol = self.tables[0].take(self.windows.take(at)) >> 4
        value = symbol << 8
        for t, before, shift in zip(self.tables[1:], (self.green, self.red, self.blue), (16, 0, 24), strict=True):
            at = before.take(at, mode="clip")
            value |= t.take(self.windows.take(at, mode="clip")) >> 4 << shift
        return np.where(symbol < 256, value, 279 - symbol) if len(self.other) else value


def aligned(codes: list[PrefixCode]) -> list[np.ndarray]:
    """The entries of the codes, all for the same number of bits; a code that stands twice gives one table."""
    longest = max(c.longest for c in codes)
    seen = {id(c): c.entries if c.longest == longest else np.tile(c.entries, 1 << (longest - c.longest)) for c in codes}
    return [seen[id(c)] for c in codes]


def one_group(bits: BitReader, codes: list[PrefixCode], width: int, total: int, cache_bits: int, tally: Counter | None) -> np.ndarray:
    """Pixels of an image with one group of codes.

    In stretches of the stream, what a token would be is looked up at every bit at once; then a walk from token
    to token picks the places where tokens start.  Back-references are read one by one.  Values come last: a
    pixel is its own literal or the pixel it refers to, which for a cache code is the last one before it with
    that place in the cache."""
    values: list[np.ndarray] = []
    copies: list[tuple[int, int, int]] = []
    tables = aligned(codes[:4])
    i = 0
    while i < total:
        first = bits.at >> 3
        raw = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - first, (STRETCH + BEYOND) // 8), first).astype(np.int64)
        last = first + len(raw) == len(bits.data)
        here, end = bits.at & 7, 8 * (len(raw) - 8) if last else STRETCH
        stretch = Stretch(raw, tables, end)
        step = stretch.step
        places: list[int] = []
        walk = places.append
        while i < total:
            before = len(places)
            for _ in repeat(None, total - i):
                n = step[here]
                if n < 0:
                    break
                walk(here)
                here = n
            i += len(places) - before
            if i >= total or here > end:
                break
            bits.at = first * 8 + here
            n = read_extra(bits, codes[0].read(bits) - 256)
            d = back_distance(read_extra(bits, codes[4].read(bits)), width)
            if d > i or i + n > total:
                raise ValueError("a back-reference leaves the image")
            copies.append((i, n, d))
            i += n
            here = bits.at - first * 8
        values.append(stretch.values(places))
        bits.at = first * 8 + here
        bits.read(0)
    refers, literal = np.arange(total), np.ones(total, bool)
    for i, n, d in copies:
        literal[i : i + n] = False
        refers[i : i + n] = i - d + np.arange(n) % d
    own = np.zeros(total, np.int64)
    own[literal] = np.concatenate(values)
    hits = own < 0
    if cache_bits and hits.any():
        slots = ((own.astype(np.uint32) * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        slots[hits] = -1 - own[hits]
        for i, n, _ in copies:
            slots[i : i + n] = slots[refers[i : i + n]]
        before = _before(slots.astype(np.uint16))
        known = hits & (before >= 0)
        refers[known] = before[known]
        own[hits] = 0
    if tally is not None:
        tally["back-references"] += len(copies)
        tally["colour cache"] += int(hits.sum())
    while copies or hits.any():
        further = refers.take(refers)
        if (further == refers).all():
            break
        refers = further
    return own.take(refers).astype(np.uint32)


def read_image(bits: BitReader, width: int, height: int, main: bool, tally: Counter | None = None) -> np.ndarray:
    """An entropy-coded image as ARGB values in scan order; ``main`` may have an image of code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups_of, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        gw, gh = -(-width >> group_bits), -(-height >> group_bits)
        groups_of = ((read_image(bits, gw, gh, False) >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(gh, gw).tolist()
        n_groups = max(map(max, groups_of)) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [read_codes(bits, sizes) for _ in range(n_groups)]
    total = width * height
    if tally is not None and main:
        tally["unequal code lengths"] += any(c.flat is None for g in groups for c in g)
    if n_groups == 1:
        if not cache_bits and (done := flat_pixels(bits, groups[0], total)) is not None:
            return done
        return one_group(bits, groups[0], width, total, cache_bits, tally)
    out: list[int] = []
    seen = [0] * (1 << cache_bits) if cache_bits else None
    drop = 32 - cache_bits
    window = have = copies = hits = i = 0
    while i < total:
        y, x = divmod(i, width)
        codes = groups[groups_of[y >> group_bits][x >> group_bits]]
        until = min(total, i + min(width - x, (1 << group_bits) - (x & (1 << group_bits) - 1)))
        (green, gm), (red, rm), (blue, bm), (alpha, am) = ((c.table, c.mask) for c in codes[:4])
        while i < until:
            if have < 60:  # the most that a pixel takes
                bits.at -= have
                window, have = bits.ahead(64)
            e = green[window & gm]
            n = e & 15
            s = e >> 4
            window >>= n
            if s < 256:
                r = red[window & rm]
                k = r & 15
                window >>= k
                n += k
                b = blue[window & bm]
                k = b & 15
                window >>= k
                a = alpha[window & am]
                window >>= a & 15
                have -= n + k + (a & 15)
                p = a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4
                out.append(p)
                if seen is not None:
                    seen[(CACHE_FACTOR * p & 0xFFFFFFFF) >> drop] = p
                i += 1
                continue
            have -= n
            if s >= 280:
                p = seen[s - 280]
                out.append(p)
                hits += 1
                i += 1
                continue
            bits.at -= have
            n = read_extra(bits, s - 256)
            d = back_distance(read_extra(bits, codes[4].read(bits)), width)
            window, have = bits.ahead(64)
            if d > i or i + n > total:
                raise ValueError("a back-reference leaves the image")
            copied = out[i - d : i - d + n] if d >= n else (out[i - d :] * -(-n // d))[:n]
            out += copied
            if seen is not None:
                for p in copied:
                    seen[(CACHE_FACTOR * p & 0xFFFFFFFF) >> drop] = p
            copies += 1
            i += n
    bits.at -= have
    bits.read(0)
    if tally is not None:
        tally["back-references"] += copies
        tally["colour cache"] += hits
    return np.array(out, np.uint32)


def _bytes(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _argb(c: Sequence[int]) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _average(a, b):
    """Of each channel, rounded down; for numbers and arrays."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else min(v, 255)


def predict(mode: int, left, top, top_right, top_left):
    """The prediction of one of the 14 modes; of arrays for those that only move or average."""
    if mode == 0 or mode > 13:
        return OPAQUE_BLACK
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 10:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    le, to, tl = _bytes(left), _bytes(top), _bytes(top_left)
    if mode == 11:
        gradient = [a + b - c for a, b, c in zip(le, to, tl, strict=True)]
        by_left = sum(abs(p - a) for p, a in zip(gradient, le, strict=True))
        by_top = sum(abs(p - b) for p, b in zip(gradient, to, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return _argb([_clamp(a + b - c) for a, b, c in zip(le, to, tl, strict=True)])
    half = _bytes(_average(left, top))
    return _argb([_clamp(a + int((a - c) / 2)) for a, c in zip(half, tl, strict=True)])


def mode_runs(modes: np.ndarray, width: int, height: int, bits: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, from, to, mode) of stretches of one mode, without the first row and column, which have theirs."""
    across = -(-width >> bits)
    grid = (modes >> np.uint32(8) & np.uint32(255)).reshape(-1, across).tolist()
    for y in range(1, height):
        row, k = grid[y >> bits], 0
        while k < across:
            j = k
            while j < across and row[j] == row[k]:
                j += 1
            yield y, max(1, k << bits), min(width, j << bits), row[k]
            k = j


def _sum_bytes(a: np.ndarray, b) -> np.ndarray:
    """a + b in every channel."""
    b = b if isinstance(b, np.ndarray) else np.full(len(a), b, np.uint32)
    return (a.view(np.uint8) + np.ascontiguousarray(b).view(np.uint8)).view(np.uint32)


def _running(first: int, rest: np.ndarray) -> np.ndarray:
    """``first`` plus the running sums of ``rest``, in every channel."""
    rows = np.concatenate([np.array([first], np.uint32), rest]).view(np.uint8).reshape(-1, 4)
    return np.cumsum(rows, axis=0, dtype=np.uint8).view(np.uint32).ravel()[1:]


def add_argb(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


#: Modes that don't need the pixel to the left, or only that.
QUICK_MODES = (0, 1, 2, 3, 4, 8, 9)
#: Those that a stored image may have.
TRIED_MODES = (0, 1, 2, 8)


def invert_predictor(p: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from residuals: stretches of a quick mode as arrays, the others pixel by pixel."""
    height = len(p) // width
    out = np.empty(len(p), np.uint32)
    out[:width] = _running(OPAQUE_BLACK, p[:width])
    if height > 1:
        out[::width] = _running(int(out[0]), p[width::width]) if height == 1 else np.concatenate([out[:1], _running(int(out[0]), p[width::width])])
    for y, x0, x1, mode in mode_runs(modes, width, height, bits):
        if x0 >= x1:
            continue
        i, j, up = y * width + x0, y * width + x1, y * width + x0 - width
        n = x1 - x0
        if mode == 1:
            out[i:j] = _running(int(out[i - 1]), p[i:j])
        elif mode in QUICK_MODES or mode > 13:
            out[i:j] = _sum_bytes(p[i:j], predict(mode, None, out[up : up + n], out[up + 1 : up + n + 1], out[up - 1 : up + n - 1]))
        else:
            above = out[up - 1 : up + n + 1].tolist()
            left, done = int(out[i - 1]), []
            for k, rest in enumerate(p[i:j].tolist()):
                left = add_argb(rest, predict(mode, left, above[k + 1], above[k + 2], above[k]))
                done.append(left)
            out[i:j] = done
    return out


def residuals(p: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """What is left of pixels after their predictions."""
    height = len(p) // width
    expected = np.empty(len(p), np.uint32)
    expected[0] = OPAQUE_BLACK
    expected[1:width] = p[: width - 1]
    expected[width::width] = p[:-width:width]
    for y, x0, x1, mode in mode_runs(modes, width, height, bits):
        i, j, up = y * width + x0, y * width + x1, y * width + x0 - width
        n = x1 - x0
        if n <= 0:
            continue
        around = p[i - 1 : j - 1], p[up : up + n], p[up + 1 : up + n + 1], p[up - 1 : up + n - 1]
        expected[i:j] = predict(mode, *around) if mode < 11 or mode > 13 else [predict(mode, *x) for x in zip(*(c.tolist() for c in around), strict=True)]
    return (p.view(np.uint8) - expected.view(np.uint8)).view(np.uint32)


def _by_block(x: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Sums of a value per pixel over blocks."""
    height = len(x) // width
    if max(width, height) <= 1 << bits:
        return x.sum(keepdims=True, dtype=np.int64)
    rows = np.add.reduceat(x.reshape(height, width), np.arange(0, height, 1 << bits), axis=0)
    return np.add.reduceat(rows, np.arange(0, width, 1 << bits), axis=1).ravel()


def fit_modes(p: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The mode image: of TRIED_MODES, the one of least residuals for each block."""
    across, down = -(-width >> bits), -(-(len(p) // width) >> bits)
    costs = []
    for m in TRIED_MODES:
        r = residuals(p, width, np.full(across * down, m << 8, np.uint32), bits).view(np.uint8)
        r = np.minimum(r, -r)
        costs.append(r.sum(keepdims=True, dtype=np.int64) if across * down == 1 else _by_block(r.reshape(-1, 4).sum(axis=1, dtype=np.int64), width, bits))
    best = np.array(TRIED_MODES, np.uint32)[np.argmin(costs, axis=0)]
    return np.uint32(OPAQUE_BLACK) | best << np.uint32(8)


def fit_factors(p: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The cross-colour image: per block the slopes of red on green, of blue on green, and of what is left of
    blue on red."""
    green, red, blue = (_signed(p >> np.uint32(s) & np.uint32(255)) for s in (8, 16, 0))
    sums = lambda a, b: _by_block(a * b, width, bits).astype(np.int64)
    slope = lambda top, bottom: np.clip(np.rint(32 * top / np.maximum(bottom, 1)), -128, 127).astype(np.int64)
    gg = sums(green, green)
    on_red, on_blue = slope(sums(red, green), gg), slope(sums(blue, green), gg)
    left = sums(blue, red) - on_blue * sums(green, red) // 32
    by_red = slope(left, sums(red, red))
    return (OPAQUE_BLACK | (by_red & 255) << 16 | (on_blue & 255) << 8 | (on_red & 255)).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def cross_color(p: np.ndarray, width: int, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Red and blue with the shares of green (and blue with that of red) added, or taken off (sign -1)."""
    height = len(p) // width
    f = factors
    if len(f) > 1:
        f = factors.reshape(-(-height >> bits), -(-width >> bits))
        f = np.repeat(np.repeat(f, 1 << bits, axis=0)[:height], 1 << bits, axis=1)[:, :width].ravel()
    green, red, blue = (p >> np.uint32(s) & np.uint32(255) for s in (8, 16, 0))
    delta = lambda t, c: (_signed(t & np.uint32(255)) * _signed(c)) >> 5
    new_red = (red.astype(np.int32) + sign * delta(f, green)) & 255
    source = new_red.astype(np.uint32) if sign > 0 else red
    new_blue = (blue.astype(np.int32) + sign * (delta(f >> np.uint32(8), green) + delta(f >> np.uint32(16), source))) & 255
    return p & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def shift_green(p: np.ndarray, sign: int) -> np.ndarray:
    green = (p >> np.uint32(8) & np.uint32(255)).astype(np.int32)
    red = ((p >> np.uint32(16) & np.uint32(255)).astype(np.int32) + sign * green & 255).astype(np.uint32)
    blue = ((p & np.uint32(255)).astype(np.int32) + sign * green & 255).astype(np.uint32)
    return p & np.uint32(0xFF00FF00) | red << np.uint32(16) | blue


def bundle_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def invert_palette(p: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    """Colours for indices; small palettes have several indices in a pixel, lowest bits first."""
    b = bundle_bits(len(palette))
    index = (p >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    if b:
        each = 8 >> b
        index = (index[:, :, None] >> (np.arange(1 << b, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index.ravel()]


def undo_differences(p: np.ndarray) -> np.ndarray:
    channels = np.cumsum(p.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint32).astype(np.uint8)
    return np.ascontiguousarray(channels).view(np.uint32).ravel()


def decode(data: bytes, tally: Counter | None = None) -> np.ndarray:
    """The pixels of a lossless WebP file, (height, width) ARGB values.  ``tally`` counts what the file uses."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = BitReader(data[at + 8 : at + 8 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if tally is not None:
            tally[TRANSFORMS[kind]] += 1
        if kind in (PREDICTOR, CROSS_COLOR):
            b = bits.read(3) + 2
            undo.append((kind, inner, read_image(bits, -(-inner >> b), -(-height >> b), False), b))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, inner, None, 0))
        else:
            n = bits.read(8) + 1
            undo.append((kind, inner, undo_differences(read_image(bits, n, 1, False)), 0))
            inner = -(-inner >> bundle_bits(n))
    p = read_image(bits, inner, height, True, tally)
    for kind, w, extra, b in reversed(undo):
        if kind == PREDICTOR:
            p = invert_predictor(p, w, extra, b)
        elif kind == CROSS_COLOR:
            p = cross_color(p, w, extra, b, 1)
        elif kind == SUBTRACT_GREEN:
            p = shift_green(p, 1)
        else:
            p = invert_palette(p, w, height, extra)
    return p.reshape(height, width)


# Encoding


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; rare symbols count more while it is exceeded."""
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = np.argsort(counts[used], kind="stable")
    of, n = counts[used][order].tolist(), len(used)
    never = sum(of) * n + limit
    floor = 1
    while True:
        # Leaves and joined nodes both come in ascending order: the two least are at the head of either.
        weight = [*(of if floor == 1 else [max(c, floor) for c in of]), never * floor]
        joined, up = [never * floor] * n, [0] * (2 * n - 2)
        leaf = node = 0
        for k in range(n - 1):
            if (x := weight[leaf]) <= (y := joined[node]):
                up[leaf] = k
                leaf += 1
                total = x
            else:
                up[n + node] = k
                node += 1
                total = y
            if (x := weight[leaf]) <= (y := joined[node]):
                up[leaf] = k
                leaf += 1
                total += x
            else:
                up[n + node] = k
                node += 1
                total += y
            joined[k] = total
        inner = [0] * (n - 1)
        for k in range(n - 3, -1, -1):
            inner[k] = inner[up[n + k]] + 1
        if inner[up[0]] < limit:
            lengths[used[order]] = [inner[k] + 1 for k in up[:n]]
            return lengths
        floor *= 2


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits as written, number of bits) by symbol; nothing is written for a single one, and for the symbol after
    the last."""
    code, width = np.zeros(len(lengths) + 1, np.uint64), np.zeros(len(lengths) + 1, np.uint64)
    used = lengths.nonzero()[0]
    if len(used) > 1:
        n = lengths.take(used).astype(np.uint8)  # small numbers are sorted by their digits
        order = used.take(n.argsort(kind="stable"))
        n = lengths.take(order)
        share = 1 << (15 - n)
        code[order], width[order] = reversed_bits(15).take(share.cumsum() - share), n
    return code, width


def describe_code(lengths: np.ndarray) -> tuple[int, int]:
    """A code's description: its bits and their number."""
    small = lengths.astype(np.uint8)
    raw = small.tobytes()
    if len(raw) - raw.count(0) <= 2:
        used = lengths.nonzero()[0].tolist()
        if all(s < 256 for s in used):
            first = used[0] if used else 0
            value, at = 1 | (len(used) == 2) << 1 | (first > 1) << 2 | first << 3, 11 if first > 1 else 4
            return (value | used[1] << at, at + 8) if len(used) == 2 else (value, at)
    long = int(lengths.max()) > 10
    edges = ((small[1:] != small[:-1]).nonzero()[0] + 1).tolist()
    runs = [described_run(raw[i:j], long) for i, j in zip([0, *edges], [*edges, len(raw)], strict=True)]
    runs.reverse()
    text = "".join(runs)
    value, at, _, _ = length_code(long)
    return value | int(text, 2) << at, at + len(text)


@cache
def described_run(run: bytes, long: bool) -> str:
    """The digits, last bit first, that stand for equal lengths in a row, after others."""
    n, left = run[0], len(run)
    symbols: list[tuple[int, int]] = []  # with what follows a symbol, in EXTRA_BITS bits
    if n:
        symbols.append((n, 0))
        left -= 1
        while left >= 3:
            k = min(left, 6)
            symbols.append((16, k - 3))
            left -= k
    else:
        while left >= 11:
            k = min(left, 138)
            symbols.append((18, k - 11))
            left -= k
        if left >= 3:
            symbols.append((17, left - 3))
            left = 0
    symbols += [(n, 0)] * left
    value, at, (_, _, code, width) = 0, 0, length_code(long)
    for s, v in symbols:
        value |= (code[s] | v << width[s]) << at
        at += width[s] + EXTRA_BITS[s]
    return f"{value:0{at}b}"


@cache
def length_code(long: bool) -> tuple[int, int, list[int], list[int]]:
    """The code that lengths are written in, one for lengths up to 10 bits and one for all: (the bits that
    describe it and start a code's description, their number, bits and width of each symbol)."""
    lengths = np.full(19, 4, np.int64)
    lengths[11:16] = 5 if long else 0
    if long:
        lengths[1] = 5
    else:
        lengths[[0, 17]] = 3
    order = lengths[list(LENGTH_ORDER)].tolist()
    n = max(4, max(i for i, x in enumerate(order) if x) + 1)
    value, at = n - 4 << 1, 5
    for x in order[:n]:
        value |= x << at
        at += 3
    code, width = canonical(lengths)
    return value, at + 1, code.tolist(), width.tolist()


@lru_cache(maxsize=4096)
def lone_code(alphabet: int, symbol: int) -> tuple[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The description and table of a code of one symbol, or of none (-1)."""
    lengths = np.zeros(alphabet, np.int64)
    if symbol >= 0:
        lengths[symbol] = 1
    return describe_code(lengths), canonical(lengths)


def to_prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra, its bits) of a length or distance of at least 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << top - 1) - 1), top - 1


@lru_cache(maxsize=64)
def short_distances(width: int) -> dict[int, int]:
    """The code of each distance that has a short one."""
    return {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(near_offsets())))}


def find_copies(p: np.ndarray, longest: int = 4096) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references of three pixels or more, greedily from the left; each goes
    to the last place with the same three pixels."""
    if len(p) < 4:
        return []
    x = p.astype(np.uint64)
    keys = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    last = _before(keys)
    found, free = [], 0
    for i in np.flatnonzero(last >= 0).tolist():
        if i < free:
            continue
        j = int(last[i])
        differ = p[i : i + longest] != p[j : j + min(longest, len(p) - i)]
        n = int(differ.argmax()) if differ.any() else len(differ)
        if n >= 3:
            found.append((i, n, i - j))
            free = i + n
    return found


def write_image(w: BitWriter, p: np.ndarray, width: int, main: bool, cache_bits: int = 0, lz: bool = False, longest: int = 15, shared: bool = False) -> None:
    """An entropy-coded image with Huffman codes of its own, with back-references (``lz``) and a cache; with
    ``shared`` red, blue and alpha have the same code."""
    p = np.ascontiguousarray(p, np.uint32)
    if not main and not cache_bits and (len(p) == 1 or (p == p[0]).all()):
        w.write(0, 1)
        a, r, g, b = _bytes(int(p[0]))
        for alphabet, symbol in ((280, g), (256, r), (256, b), (256, a), (40, -1)):
            w.write(*lone_code(alphabet, symbol)[0])
        return
    copies = find_copies(p) if lz else []
    literal = np.ones(len(p), bool)
    for i, n, _ in copies:
        literal[i + 1 : i + n] = False
    # A token: its green symbol, then red, blue and alpha, or the extra bits and distance of a copy, or nothing.
    at = literal.nonzero()[0]
    channels = p.take(at).view(np.uint8).reshape(-1, 4).T  # blue, green, red, alpha
    green, rest = channels[1].astype(np.int64), channels.take((2, 0, 3), axis=0).astype(np.int64)
    backs = np.zeros(0, np.int64)
    if copies:
        placed = np.searchsorted(at, [c[0] for c in copies])
        short = short_distances(width)
        sizes, spare, spare_bits = np.array([to_prefix(n) for _, n, _ in copies]).T
        backs, far, far_bits = np.array([to_prefix(short.get(d, d + 120)) for _, _, d in copies]).T
        green[placed] = 256 + sizes
        rest[:, placed] = 256
    if cache_bits:
        slots = (p * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        before = _before(slots.astype(np.uint16))
        hit = (((before >= 0) & (p.take(before) == p)).take(at) & (green < 256)).nonzero()[0]
        green[hit] = 280 + slots.take(at.take(hit))
        rest[:, hit] = 256
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    of_rest = [np.bincount(rest.ravel(), minlength=257)[:256]] * 3 if shared else [np.bincount(c, minlength=257)[:256] for c in rest]
    counts = [np.bincount(green, minlength=280 + (1 << cache_bits if cache_bits else 0)), *of_rest, np.bincount(backs, minlength=40)]
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    for k, c in enumerate(counts):
        if k not in (2, 3) or not shared:
            used = np.flatnonzero(c)
            if len(used) < 2:
                described, table = lone_code(len(c), int(used[0]) if len(used) else -1)
            else:
                lengths = code_lengths(c, longest)
                described, table = describe_code(lengths), canonical(lengths)
        w.write(*described)
        tables.append(table)
    tokens, bits = (t.take(green) for t in tables[0])
    for symbols, (code, n) in zip(rest, tables[1:4], strict=True):
        tokens |= code.take(symbols) << bits
        bits += n.take(symbols)
    if copies:
        for value, n in ((spare, spare_bits), (t.take(backs) for t in tables[4]), (far, far_bits)):
            tokens[placed] |= value.astype(np.uint64) << bits[placed]
            bits[placed] += n.astype(np.uint64)
    w.write_many(tokens, bits)


def wrap(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(
    pixels: np.ndarray,
    transforms: Sequence[int] = (),
    cache_bits: int = 0,
    lz: bool = False,
    modes: Sequence[int] | None = (11,),
    factors: int | None = 0x00102030,
    block_bits: int = 3,
    longest: int = 15,
    shared: bool = False,
) -> bytes:
    """A lossless WebP file of (height, width) ARGB values, with any of the format's means.

    ``transforms`` are applied in the order given.  The predictor takes ``modes`` in turn over its blocks,
    cross-colour uses ``factors`` everywhere; None fits them to each block.  Colour indexing needs at most 256
    colours.  Codes have ``longest`` bits at most; ``shared`` is for channels of the same kind of values.
    """
    height, width = pixels.shape
    p, inner = np.ascontiguousarray(pixels, np.uint32).ravel(), width
    w = BitWriter()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(value, n)
    for kind in transforms:
        w.write(1 | kind << 1, 3)
        across = -(-inner >> block_bits)
        blocks = across * -(-height >> block_bits)
        if kind == PREDICTOR:
            w.write(block_bits - 2, 3)
            chosen = fit_modes(p, inner, block_bits) if modes is None else np.uint32(OPAQUE_BLACK) | np.resize(np.array(modes, np.uint32), blocks) << np.uint32(8)
            write_image(w, chosen, across, False)
            p = residuals(p, inner, chosen, block_bits)
        elif kind == CROSS_COLOR:
            w.write(block_bits - 2, 3)
            f = fit_factors(p, inner, block_bits) if factors is None else np.full(blocks, OPAQUE_BLACK | factors, np.uint32)
            write_image(w, f, across, False)
            p = cross_color(p, inner, f, block_bits, -1)
        elif kind == SUBTRACT_GREEN:
            p = shift_green(p, -1)
        else:
            palette, index = np.unique(p, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            w.write(len(palette) - 1, 8)
            bytes_ = palette.view(np.uint8).reshape(-1, 4)
            write_image(w, np.concatenate([bytes_[:1], bytes_[1:] - bytes_[:-1]]).view(np.uint32).ravel(), len(palette), False, longest=longest, shared=shared)
            b = bundle_bits(len(palette))
            rows = index.reshape(height, inner).astype(np.uint32)
            inner = -(-inner >> b)
            rows = np.pad(rows, ((0, 0), (0, (inner << b) - rows.shape[1]))).reshape(height, inner, 1 << b)
            p = (rows << (np.arange(1 << b, dtype=np.uint32) * np.uint32(8 >> b))).sum(axis=2, dtype=np.uint32).ravel() << np.uint32(8) | np.uint32(OPAQUE_BLACK)
    w.write(0, 1)
    write_image(w, p, inner, True, cache_bits, lz, longest, shared)
    return wrap(w.bytes())


#: Chains of transforms for payloads that a palette doesn't suit; the payload's checksum deals them out, so that
#: every inverse transform has its share of stored rows.
CHAINS = ((SUBTRACT_GREEN,), (PREDICTOR,), (PREDICTOR, CROSS_COLOR), (CROSS_COLOR, SUBTRACT_GREEN))


def encode_payload(rows: np.ndarray) -> bytes:
    """(height, ROW) bytes as an image of four bytes to a pixel: with a palette if there are at most 256
    colours and twice as many pixels, else with one of CHAINS and a colour cache; always with back-references and Huffman codes."""
    pixels = np.ascontiguousarray(rows).view("<u4").astype(np.uint32)
    order = np.sort(pixels, axis=None)
    colors = 1 + int((order[1:] != order[:-1]).sum())
    if colors <= min(256, pixels.size // 2):
        return encode(pixels, (COLOR_INDEXING,), lz=True, longest=CODE_BITS, shared=True)
    chain = CHAINS[zlib.crc32(rows) % len(CHAINS)]
    return encode(pixels, chain, CACHE_BITS, True, None, None, BLOCK_BITS, CODE_BITS, True)


# Media columns


def to_payload(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of ROW."""
    return data + b"\xff" * (-len(data) % ROW if data else ROW)


#: Payloads up to this many bytes are remembered, the last KEPT of a worker: copies are encoded and read once.
SMALL, KEPT = 16 << 10, 256


def store(payload: bytes) -> bytes:
    """A payload as one image, or several after each other where one has no room."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(encode_payload(rows[i : i + PAYLOAD_ROWS]) for i in range(0, len(rows), PAYLOAD_ROWS))


def load(media: bytes, tally: Counter | None = None) -> np.ndarray:
    """The bytes of stored media, (rows, ROW)."""
    parts, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        parts.append(decode(media[at:end], tally).astype("<u4").view(np.uint8))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of the bytes and which of 64 equal stretches are above the whole's mean."""
    total = samples.size
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    whole = int(parts.sum())
    mean = whole / total
    square = np.square(samples, dtype=np.uint16).sum(dtype=np.int64) / total
    bright = parts * 64 > whole
    return f"{mean:.4f}:{max(0.0, square - mean * mean) ** 0.5:.4f}:{np.packbits(bright).tobytes().hex()}"


@lru_cache(maxsize=KEPT)
def _store_small(payload: bytes) -> bytes:
    return store(payload)


def _read(media: bytes) -> tuple:
    samples = load(media)
    payload = samples.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)


@lru_cache(maxsize=KEPT)
def _read_small(media: bytes) -> tuple:
    return _read(media)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text in UTF-8 as lossless WebP.  Null counts as empty: a payload
    of ROW padding bytes.  Equal texts give equal media; rows keep their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [(t.as_py() or "").encode("utf-8") for t in b.column(1)]
            media = [(_store_small if len(d) <= SMALL else store)(to_payload(d)) for d in data]
            yield pa.record_batch([b.column(0), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the
    media column of store_texts, all but n_bytes from the stored bytes.  Rows keep their number, repeated ones
    too; an empty table gives none.  Media that aren't lossless WebP raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in slices(batches):
            out = [(_read_small if len(m) <= SMALL else _read)(m) for m in b.column(2).to_pylist()]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([b.column(0), b.column(1), *cols], names=[id_col, "n_bytes", *names])

    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
