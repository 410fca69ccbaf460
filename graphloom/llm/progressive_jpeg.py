"""Media columns: payloads kept losslessly in progressive JPEG files, read back as coefficients and RGB tensors.

A payload byte b is the quantised coefficient b - 128 (all quantiser steps are 1), 64 to a block in zigzag order, six
blocks (four of luma, one for each chroma) to a 16 x 16 pixel unit; a comment segment holds the payload's length. Scans
select bands of coefficients and approximate them in two steps; restart markers cut each scan every RESTART units.

Whole slices of texts are coded at once: the writer lays out the symbols of all blocks in arrays and packs their bits;
the reader decodes all restart intervals of a scan in step, one symbol of each at a time, accumulates the scans into
coefficient arrays, inverse-transforms them with exact integer arithmetic (so equal payloads give equal pixels whatever
is decoded beside them), repeats chroma to full resolution and converts to RGB.

A text of more than SLICE bytes is a picture of several units' width; it is coded and decoded in bands of BAND rows of
units, of which the restart markers are counted through, so the file is the one that coding it whole would give. Its
payload, file and tensor are held, and the work of one band.

Media and tensors are tables of the shared folder. The query makes them in WAVES groups of the input's files, one after
another, each read back and removed before the next, so that they take that share of their whole size at a time.

A null text is an empty payload; every payload is padded with bytes 255 to a positive multiple of PAD bytes. Repeated rows
give equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import cut, drop, is_long, slices, utf8_bytes

PAD, UNIT, RESTART = 576, 384, 8
SLICE = 3 << 19
#: Units of 16 pixels that fit one column of an image of the format's largest height, and of a band; a band's intervals are a multiple of the eight restart markers.
MOST_ROWS, BAND = 4000, 8 * RESTART
#: Groups of input files whose media and tensors stand on disk one after another.
WAVES = 6


def zigzag() -> np.ndarray:
    """Natural place of each coefficient of the zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
#: components, first and last coefficient, high and low bit of each scan; component 0 is luma.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0,), 1, 5, 1, 0), ((0, 1, 2), 0, 0, 1, 0))


def code_lengths(weights: dict[int, float], most: int = 16) -> tuple[list[int], list[int]]:
    """Symbols by code length (1 to 16), and the symbols in that order; no code is all ones."""
    items = sorted((w, (s,)) for s, w in [*weights.items(), (256, 0.0)])
    depth: dict[int, int] = defaultdict(int)
    # Package-merge gives the best lengths up to `most`.
    level: list[tuple[float, tuple[int, ...]]] = []
    for _ in range(most):
        paired = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
        level = sorted(items + paired)
    for _, symbols in level[: 2 * len(items) - 2]:
        for s in symbols:
            depth[s] += 1
    order = sorted(depth, key=lambda s: (depth[s], s))
    order.remove(256)
    depth[256] = max(depth.values())
    return [sum(depth[s] == n for s in order) for n in range(1, 17)], order


def table_codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of every symbol (canonical)."""
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code, at = 0, 0
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            codes[s], lengths[s] = code, n
            code += 1
        at += count
        code <<= 1
    return codes, lengths


@lru_cache(8)
def decoder(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits, the length of the code they begin with times 256, plus its symbol."""
    out = np.zeros(1 << 16, np.int64)
    codes, lengths = table_codes(list(counts), list(symbols))
    for s in symbols:
        n = int(lengths[s])
        out[int(codes[s]) << (16 - n) : (int(codes[s]) + 1) << (16 - n)] = n << 8 | s
    return out


@lru_cache(1)
def tables() -> dict[tuple[int, int], tuple[list[int], list[int]]]:
    """Fixed Huffman tables, by rule: sizes of letters come first, long runs of zeros last."""
    dc = code_lengths({s: 2.0 ** -abs(s - 4) for s in range(12)})
    ac = {r << 4 | s: (2.0 if 3 <= s <= 7 else 0.5) * 0.02**min(r, 3) * 0.9**r for r in range(16) for s in range(1, 9)}
    ac |= {r << 4: 0.01 * 0.5**r for r in range(15)} | {0xF0: 1e-6}
    return {(0, 0): dc, (1, 0): code_lengths(ac)}


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def columns_of(units: int) -> tuple[int, int]:
    """Width and height in units."""
    w = -(-units // MOST_ROWS)
    return w, -(-units // w)


@lru_cache(1)
def file_head() -> bytes:
    out = b"\xff\xd8" + segment(0xDB, b"\x00" + b"\x01" * 64)
    for (kind, number), (counts, symbols) in tables().items():
        out += segment(0xC4, bytes([kind << 4 | number, *counts, *symbols]))
    return out + segment(0xDD, struct.pack(">H", RESTART))


def scan_head(scan: tuple) -> bytes:
    parts, first, last, high, low = scan
    return segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c + 1, 0)), first, last, high << 4 | low]))


def bit_size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def magnitude_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


@dataclass
class Items:
    """Bits to write, in order, and the restart interval of each."""

    code: np.ndarray
    length: np.ndarray
    interval: np.ndarray


def dc_items(dc: np.ndarray, interval: np.ndarray, part: np.ndarray) -> Items:
    """First scan of DC values (already shifted), differences to the last of the same component in the interval."""
    before = np.zeros_like(dc)
    for c in range(3):
        at = np.flatnonzero(part == c)
        same = interval[at[1:]] == interval[at[:-1]]
        before[at[1:]] = np.where(same, dc[at[:-1]], 0)
    diff = dc - before
    size = bit_size(diff)
    codes, lengths = table_codes(*tables()[0, 0])
    return Items(codes[size] << size.astype(np.uint64) | magnitude_bits(diff, size), lengths[size] + size, interval)


def ac_items(band: np.ndarray, interval: np.ndarray) -> Items:
    """First scan of a band (blocks x coefficients, already shifted)."""
    n, width = band.shape
    on = band != 0
    place = np.where(on, np.arange(width), -1)
    last = np.maximum.accumulate(place, axis=1)
    before = np.concatenate((np.full((n, 1), -1), last[:, :-1]), axis=1)
    run = np.arange(width) - before - 1
    count = np.zeros((n, width + 1), np.int64)
    count[:, :-1] = np.where(on, 1 + (run >> 4), 0)
    count[:, -1] = last[:, -1] != width - 1
    flat = count.ravel()
    cell = np.repeat(np.arange(len(flat)), flat)
    final = np.ones(len(cell), dtype=bool)
    final[:-1] = cell[1:] != cell[:-1]
    row, k = cell // (width + 1), cell % (width + 1)
    end = k == width
    k = np.minimum(k, width - 1)
    value = band[row, k]
    size = bit_size(value)
    symbol = (run[row, k] & 15) << 4 | size
    codes, lengths = table_codes(*tables()[1, 0])
    code = codes[symbol] << size.astype(np.uint64) | magnitude_bits(value, size)
    length = lengths[symbol] + size
    for mask, s in ((~final, 0xF0), (end, 0x00)):
        if mask.any():
            code[mask], length[mask] = codes[s], lengths[s]
    return Items(code, length, interval[row])


def refine_items(band: np.ndarray, interval: np.ndarray) -> Items:
    """Second scan of a band that was shifted by one bit; bands are shorter than 16, so runs need no extension."""
    n, width = band.shape
    size = np.abs(band)
    new, old = size == 1, size > 1
    hist = np.cumsum(old, axis=1) - old
    group = np.cumsum(new, axis=1) - new
    zeros = np.cumsum(~new & ~old, axis=1)
    last_new = np.maximum.accumulate(np.where(new, np.arange(width), -1), axis=1)
    before = np.concatenate((np.full((n, 1), -1), last_new[:, :-1]), axis=1)
    at = np.maximum(before, 0)
    took = before >= 0
    rows = np.arange(n)[:, None]
    zeros_before, hist_before = np.where(took, zeros[rows, at], 0), np.where(took, hist[rows, at], 0)
    codes, lengths = table_codes(*tables()[1, 0])
    code, length = np.zeros((n, 2 * width + 1), np.uint64), np.zeros((n, 2 * width + 1), np.int64)
    r, k = np.nonzero(new)
    symbol = (zeros[r, k] - zeros_before[r, k]) << 4 | 1
    slot = group[r, k] + hist_before[r, k]
    code[r, slot] = codes[symbol] << np.uint64(1) | (band[r, k] > 0).astype(np.uint64)
    length[r, slot] = lengths[symbol] + 1
    r, k = np.nonzero(old)
    slot = group[r, k] + 1 + hist[r, k]
    code[r, slot], length[r, slot] = (size[r, k] & 1).astype(np.uint64), 1
    ended = np.flatnonzero(last_new[:, -1] != width - 1)
    final = last_new[ended, -1]
    slot = new[ended].sum(axis=1) + np.where(final >= 0, hist[ended, np.maximum(final, 0)], 0)
    code[ended, slot], length[ended, slot] = codes[0], lengths[0]
    used = length.ravel() > 0
    return Items(code.ravel()[used], length.ravel()[used], np.repeat(interval, 2 * width + 1)[used])


def pack(items: Items, intervals: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all intervals, stuffed and followed by restart markers except where `ends` says that a scan is over; and their bounds."""
    bits = np.bincount(items.interval, items.length, intervals).astype(np.int64)
    size = (bits + 7) // 8
    start = np.cumsum(size) - size
    upto = np.cumsum(items.length) - items.length
    first = np.searchsorted(items.interval, np.arange(intervals))
    base = np.where(first < len(upto), upto[np.minimum(first, max(len(upto) - 1, 0))], 0) if len(upto) else np.zeros(intervals, np.int64)
    at = upto - base[items.interval] + 8 * start[items.interval]
    total = int(size.sum())
    words = total // 4 + 3
    value = items.code << (64 - items.length - (at & 31)).astype(np.uint64)
    word = at >> 5
    sums = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    raw = sums.astype(np.uint64).astype(">u4").view(np.uint8)[:total].copy()
    raw[(start + size - 1)[bits % 8 > 0]] |= ((1 << (8 - bits % 8)) - 1)[bits % 8 > 0].astype(np.uint8)
    stuffed = np.ones(total, np.int64) + (raw == 255)
    extra = np.where(ends, 0, 2)
    tail = start + size - 1
    room = stuffed.copy()
    np.add.at(room, tail, extra)
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[place] = raw
    marks = np.flatnonzero(~ends)
    where = place[tail[marks]] + stuffed[tail[marks]]
    scan = np.cumsum(np.concatenate(([0], ends[:-1])))
    number = np.arange(intervals) - np.searchsorted(scan, scan)
    out[where], out[where + 1] = 255, 0xD0 + (number[marks] & 7)
    bound = np.concatenate((place[start], [len(out)]))
    return out, bound


def intervals_of(counts: np.ndarray, closed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For files with so many units: the interval of each unit, which intervals end a file's scan (none if it goes on), and intervals of each file."""
    per = -(-counts // RESTART)
    first = np.cumsum(per) - per
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.zeros(int(per.sum()), dtype=bool)
    ends[first + per - 1] = closed
    return np.repeat(first, counts) + inside // RESTART, ends, per


def luma_order(w: int, h: int) -> np.ndarray:
    """Luma blocks of an image in raster order, as numbers in unit order (4 x unit + place)."""
    r, c = np.divmod(np.arange(4 * w * h), 2 * w)
    return 4 * (r // 2 * w + c // 2) + 2 * (r % 2) + c % 2


def coded(raw: np.ndarray, sizes: np.ndarray, shapes: list[tuple[int, int]], closed: bool = True) -> list[tuple[bytes, list[int]]]:
    """For each scan, the data of payloads that stand one after another in `raw` as pictures of these units, and their bounds; those that are not closed go on with another band."""
    units = np.array([w * h for w, h in shapes], np.int64)
    coefficients = np.zeros((int(units.sum()), UNIT), np.int16)
    to = np.repeat((np.cumsum(units) - units) * UNIT - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(raw))
    coefficients.ravel()[to] = raw.astype(np.int16) - 128
    blocks = coefficients.reshape(-1, 6, 64)
    first_unit = np.cumsum(units) - units
    luma = np.arange(4 * len(blocks))
    for i, (w, h) in enumerate(shapes):
        if w > 1:
            luma[4 * first_unit[i] : 4 * (first_unit[i] + units[i])] = 4 * first_unit[i] + luma_order(w, h)
    y = blocks[:, :4].reshape(-1, 64)
    y = y if (luma == np.arange(len(luma))).all() else y[luma]
    unit_interval, unit_ends, unit_per = intervals_of(units, closed)
    y_interval, y_ends, y_per = intervals_of(4 * units, closed)
    planes = {0: (y, y_interval, y_ends, y_per), 1: (blocks[:, 4], unit_interval, unit_ends, unit_per), 2: (blocks[:, 5], unit_interval, unit_ends, unit_per)}
    scans = []
    for parts, first, last, high, low in SCRIPT:
        if first == 0:
            dc, six = blocks[:, :, 0].reshape(-1).astype(np.int64), np.repeat(unit_interval, 6)
            part = np.tile(np.array([0, 0, 0, 0, 1, 2]), len(blocks))
            items = Items((dc & 1).astype(np.uint64), np.ones(len(dc), np.int64), six) if high else dc_items(dc >> low, six, part)
            ends, per = unit_ends, unit_per
        else:
            plane, interval, ends, per = planes[parts[0]]
            band = plane[:, first : last + 1].astype(np.int64)
            items = refine_items(band, interval) if high else ac_items(np.sign(band) * (np.abs(band) >> low), interval)
        data, bound = pack(items, len(ends), ends)
        scans.append((data.tobytes(), bound[np.concatenate(([0], np.cumsum(per)))].tolist()))
    return scans


def assembled(size: int, shape: tuple[int, int], scans: list[list[bytes]]) -> bytes:
    """The file of a payload of `size` bytes, from the parts of each scan."""
    w, h = shape
    frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join([file_head(), segment(0xFE, b"payload %d" % size), segment(0xC2, frame), *(x for scan, data in zip(SCRIPT, scans, strict=True) for x in (scan_head(scan), *data)), b"\xff\xd9"])


def encode(payloads: list[bytes] | None = None, raw: np.ndarray | None = None, sizes: np.ndarray | None = None) -> list[bytes]:
    """JPEG files of payloads, given as bytes, or one after another in `raw`; sizes are positive."""
    if payloads is not None:
        raw, sizes = np.frombuffer(b"".join(payloads), np.uint8), np.array([len(p) for p in payloads], np.int64)
    if not len(sizes):
        return []
    shapes = [columns_of(int(u)) for u in -(-sizes // UNIT)]
    scans = coded(raw, sizes, shapes)
    return [assembled(int(size), shape, [[data[edge[i] : edge[i + 1]]] for data, edge in scans]) for i, (size, shape) in enumerate(zip(sizes, shapes, strict=True))]


def encode_long(raw: np.ndarray) -> bytes:
    """The same file of one payload, band by band."""
    w, h = columns_of(-(-len(raw) // UNIT))
    scans: list[list[bytes]] = [[] for _ in SCRIPT]
    for top in range(0, h, BAND):
        rows = min(BAND, h - top)
        own = raw[top * w * UNIT : (top + rows) * w * UNIT]
        for parts, (data, _) in zip(scans, coded(own, np.array([len(own)]), [(w, rows)], top + rows == h), strict=True):
            parts.append(data)
    return assembled(len(raw), (w, h), scans)


@dataclass
class File:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    payload: int = 0
    restart: int = 0
    tables: tuple = ()
    quantiser: bytes = b""
    scans: tuple = ()
    data: tuple = ()


def parse(buffer: bytes, start: int, stop: int, marks: np.ndarray) -> File:
    """Reads the markers of the file in buffer[start:stop]; `marks` are places in the buffer where a marker may be."""
    f, at, kinds, scans, data = File(), start + 2, {}, [], []
    while at < stop:
        marker, size = buffer[at + 1], 0
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", buffer, at + 2)[0]
        body = buffer[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            f.height, f.width = struct.unpack_from(">HH", body, 1)
            if body[0] != 8 or body[5:] != bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]):
                raise ValueError("another sampling than this reader's")
        elif marker == 0xDB:
            f.quantiser = body[1:65]
        elif marker == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            f.payload = int(body.split()[1])
        elif marker == 0xC4:
            n = sum(body[1:17])
            kinds[body[0] >> 4, body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
        elif marker == 0xDA:
            n = body[0]
            scans.append((tuple(body[1 + 2 * i] - 1 for i in range(n)), body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15))
            end = int(marks[np.searchsorted(marks, at)])
            data.append((at, end))
            at = end
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
    f.tables, f.scans, f.data = tuple(sorted(kinds.items())), tuple(scans), tuple(data)
    return f


class Bits:
    """A slice's bytes without stuffing, as 64-bit windows at every byte."""

    def __init__(self, raw: np.ndarray):
        drop = np.zeros(len(raw), dtype=bool)
        drop[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
        self.moved = np.concatenate(([0], np.cumsum(drop)))
        clean = np.concatenate((raw[~drop], np.zeros(8, np.uint8))).astype(np.uint64)
        self.windows = np.zeros(len(clean) - 7, np.uint64)
        for k in range(8):
            self.windows |= clean[k : len(clean) - 7 + k] << np.uint64(56 - 8 * k)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n bits (1 to 32) at each bit place."""
        return ((self.windows[at >> 3] << (at & 7).astype(np.uint64)) >> np.asarray(64 - n).astype(np.uint64)).astype(np.int64)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def read_dc(bits: Bits, at: np.ndarray, first: np.ndarray, count: np.ndarray, table: np.ndarray, out: np.ndarray, low: int) -> None:
    """First DC scan: `count` units from `first` on in each interval, six blocks each; out is units x 6 x 64."""
    pred = np.zeros((3, len(at)), np.int64)
    for u in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > u)
        for b in range(6):
            hit = table[bits.peek(at[live], 16)]
            size = hit & 255
            place = at[live] + (hit >> 8)
            value = np.where(size > 0, extended(bits.peek(place, np.maximum(size, 1)), size), 0)
            at[live] = place + size
            pred[max(b - 3, 0), live] += value
            out[first[live] + u, b, 0] = pred[max(b - 3, 0), live] << low


def read_ac(bits: Bits, at: np.ndarray, first: np.ndarray, count: np.ndarray, table: np.ndarray, out: np.ndarray, begin: int, end: int, low: int) -> None:
    """First scan of a band, one symbol of every interval at a time; out is blocks x 64."""
    flat = out.reshape(-1)
    place, block, stop = at.copy(), first.copy(), first + count
    k = np.full(len(at), begin)
    live = np.flatnonzero(count > 0)
    place, block, stop, k = place[live], block[live], stop[live], k[live]
    while len(place):
        hit = table[bits.peek(place, 16)]
        size = hit & 15
        k += (hit >> 4) & 15
        place += hit >> 8
        empty = size == 0
        if empty.any():
            value = np.where(empty, 0, extended(bits.peek(place, np.maximum(size, 1)), size))
            on = ~empty
            flat[64 * block[on] + k[on]] = value[on] << low if not low else np.sign(value[on]) * (np.abs(value[on]) << low)
            place += size
            k += 1
            run = (hit >> 4) & 15
            over = np.flatnonzero(empty & (run < 15))
            if len(over):
                r = run[over]
                skip = np.where(r > 0, (1 << r) + bits.peek(place[over], np.maximum(r, 1)) * (r > 0), 1)
                place[over] += r
                block[over] += skip
                k[over] = begin
        else:
            value = extended(bits.peek(place, size), size)
            flat[64 * block + k] = value if not low else np.sign(value) * (np.abs(value) << low)
            place += size
            k += 1
        full = k > end
        block += full
        k[full] = begin
        done = block >= stop
        if done.any():
            keep = ~done
            place, block, stop, k = place[keep], block[keep], stop[keep], k[keep]


def refine_ac(bits: Bits, at: np.ndarray, first: np.ndarray, count: np.ndarray, table: np.ndarray, out: np.ndarray, begin: int, end: int, low: int) -> None:
    """Second scan of a band: corrections of what is there, and coefficients that appear; one coefficient of every interval at a time."""
    flat = out.reshape(-1)
    one = 1 << low
    live = np.flatnonzero(count > 0)
    place, block, stop = at[live].copy(), first[live].copy(), (first + count)[live]
    k = np.full(len(live), begin)
    run, new, ended, ask = (np.zeros(len(live), np.int64) for _ in range(4))
    ask[:] = 1
    while len(place):
        asks = np.flatnonzero((ask == 1) & (ended == 0))
        if len(asks):
            hit = table[bits.peek(place[asks], 16)]
            p = place[asks] + (hit >> 8)
            size, r = hit & 15, (hit >> 4) & 15
            sign = bits.peek(p, 1)
            new[asks] = np.where(size > 0, np.where(sign > 0, one, -one), 0)
            p += size > 0
            eob = (size == 0) & (r < 15)
            length = np.where(eob, (1 << r) + np.where(r > 0, bits.peek(p, np.maximum(r, 1)), 0), 0)
            p += np.where(eob, r, 0)
            ended[asks], run[asks], place[asks], ask[asks] = length, r, p, 0
        cell = 64 * block + k
        value = flat[cell].astype(np.int64)
        old = value != 0
        bit = bits.peek(place, 1)
        place += old
        add = old & (bit > 0) & ((np.abs(value) & one) == 0)
        put = ~old & (ended == 0) & (run == 0)
        flat[cell] = np.where(add, value + np.sign(value) * one, np.where(put, new, value))
        ask[put] = 1
        run -= ~old & ~put & (ended == 0)
        k += 1
        full = k > end
        block += full
        ended -= full & (ended > 0)
        ask[full] = 1
        k[full] = begin
        done = block >= stop
        if done.any():
            keep = ~done
            place, block, stop, k, run, new, ended, ask = (x[keep] for x in (place, block, stop, k, run, new, ended, ask))


def decode_alike(raw: np.ndarray, files: list[File], bits: Bits) -> list[np.ndarray]:
    """Coefficients (units x 6 x 64, zigzag order) of files with the same tables and scans."""
    units = np.array([f.width * f.height // 256 for f in files], np.int64)
    first_unit = np.cumsum(units) - units
    blocks = np.zeros((int(units.sum()), 6, 64), np.int16)
    y = np.zeros((4 * len(blocks), 64), np.int16)
    chroma = [np.zeros((len(blocks), 64), np.int16) for _ in range(2)]
    one, kinds = files[0], dict(files[0].tables)
    step = one.restart
    restart = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    for s, (parts, begin, end, high, low) in enumerate(one.scans):
        scale = 4 if parts == (0,) else 1
        counts = units * scale
        starts, firsts, sizes = [], [], []
        per = -(-counts // step) if step else np.ones(len(files), np.int64)
        lead = np.array([f.data[s][0] for f in files])
        stops = np.array([f.data[s][1] for f in files])
        a, b = np.searchsorted(restart, lead), np.searchsorted(restart, stops)
        if (b - a != per - 1).any():
            raise ValueError("restart markers are missing")
        index = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        owner = np.repeat(np.arange(len(files)), per)
        starts = np.where(index == 0, lead[owner], restart[np.minimum(a[owner] + index - 1, max(len(restart) - 1, 0))] + 2 if len(restart) else 0)
        firsts = (first_unit * scale)[owner] + index * (step or 0)
        sizes = np.minimum(counts[owner] - index * (step or 0), step or counts.max())
        at = 8 * (starts - bits.moved[starts])
        if begin == 0:
            if high:
                six = np.repeat(sizes, 1) * 6
                inside = np.arange(int(six.sum())) - np.repeat(np.cumsum(six) - six, six)
                bit = bits.peek(np.repeat(at, six) + inside, 1)
                dc = blocks.reshape(-1, 64)
                dc[np.repeat(firsts * 6, six) + inside, 0] |= (bit << low).astype(np.int16)
            else:
                read_dc(bits, at.copy(), firsts, sizes, decoder(*kinds[0, 0]), blocks, low)
            continue
        plane = y if parts == (0,) else chroma[parts[0] - 1]
        (refine_ac if high else read_ac)(bits, at, firsts, sizes, decoder(*kinds[1, 0]), plane, begin, end, low)
    luma = np.arange(len(y))
    for i, f in enumerate(files):
        if f.width > 16:
            luma[4 * first_unit[i] : 4 * (first_unit[i] + units[i])] = 4 * first_unit[i] + luma_order(f.width // 16, f.height // 16)
    placed = np.empty_like(y)
    placed[luma] = y
    blocks[:, :4, 1:] = placed.reshape(-1, 4, 64)[:, :, 1:]
    blocks[:, 4, 1:], blocks[:, 5, 1:] = chroma[0][:, 1:], chroma[1][:, 1:]
    return [blocks[a : a + n] for a, n in zip(first_unit, units, strict=True)]


def cosines() -> np.ndarray:
    """The inverse transform's matrix in units of 2**-13."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.rint(np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) * (1 << 13))


COSINES = cosines()


def pixels(blocks: np.ndarray, quantiser: bytes) -> np.ndarray:
    """Samples (0 to 255) of blocks of coefficients in zigzag order; sums of whole numbers, exact in any order."""
    natural = np.zeros((len(blocks), 64))
    natural[:, ZIGZAG] = blocks * np.frombuffer(quantiser, np.uint8).astype(np.float64)
    rows = (natural.reshape(-1, 8) @ COSINES).reshape(-1, 8, 8).swapaxes(1, 2).reshape(-1, 8) @ COSINES
    out = np.floor((rows + (1 << 25)) * 2.0**-26) + 128
    return np.clip(out, 0, 255).astype(np.uint8).reshape(-1, 8, 8).swapaxes(1, 2)


def rgb(coefficients: np.ndarray, width: int, quantiser: bytes) -> np.ndarray:
    """The picture (height x width x 3) of an image's coefficients, chroma repeated to full resolution."""
    w = width // 16
    h = len(coefficients) // w
    samples = pixels(coefficients.reshape(-1, 64), quantiser).reshape(h, w, 6, 8, 8)
    luma = samples[:, :, :4].reshape(h, w, 2, 2, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(16 * h, 16 * w).astype(np.int32)
    cb, cr = ((samples[:, :, c].transpose(0, 2, 1, 3).reshape(8 * h, 8 * w).astype(np.int32) - 128).repeat(2, axis=0).repeat(2, axis=1) for c in (4, 5))
    out = np.stack((luma + ((91881 * cr + 32768) >> 16), luma - ((22554 * cb + 46802 * cr + 32768) >> 16), luma + ((116130 * cb + 32768) >> 16)), axis=-1)
    return np.clip(out, 0, 255).astype(np.uint8)


def marker_places(raw: np.ndarray, low: int, high: int, begin: int = 0, stop: int | None = None, block: int = 1 << 24) -> np.ndarray:
    """Where in raw[begin:stop] a byte 255 is followed by one from `low` to `high`."""
    out, stop = [np.zeros(0, np.int64)], len(raw) if stop is None else stop
    for i in range(begin, stop - 1, block):
        own = raw[i : min(i + block + 1, stop)]
        at = np.flatnonzero(own[:-1] == 255)
        out.append(i + at[(own[at + 1] >= low) & (own[at + 1] <= high)])
    return np.concatenate(out)


def markers(raw: np.ndarray) -> np.ndarray:
    """Places where a marker other than a restart may be."""
    return np.union1d(marker_places(raw, 1, 0xCF), marker_places(raw, 0xD8, 0xFF))


def payload_of(blocks: np.ndarray, size: int) -> bytes:
    return (blocks.reshape(-1)[: max(size, 0)] + 128).astype(np.uint8).tobytes()


def decode_long(media: bytes) -> tuple[bytes, int, int, np.ndarray]:
    """Payload, width, height and RGB tensor of one file, band by band."""
    raw = np.frombuffer(media, np.uint8)
    f = parse(media, 0, len(raw), markers(raw))
    w, h = f.width // 16, f.height // 16
    if not f.restart or BAND % (8 * f.restart):
        return decode([media], False)[0]
    restarts = [marker_places(raw, 0xD0, 0xD7, a, b) for a, b in f.data]
    picture, payload = np.empty((f.height, f.width, 3), np.uint8), []
    for top in range(0, h, BAND):
        rows = min(BAND, h - top)
        pieces, data, size = [], [], 0
        for (parts, *_), (a, b), places in zip(f.scans, f.data, restarts, strict=True):
            # Intervals of the scan before this band, and up to its end.
            first, last = (x * w * (4 if parts == (0,) else 1) // f.restart for x in (top, top + rows))
            begin = int(places[first - 1]) + 2 if first else a
            stop = int(places[last - 1]) if top + rows < h else b
            pieces.append(raw[begin:stop])
            data.append((size, size + stop - begin))
            size += stop - begin
        own = np.concatenate((*pieces, np.zeros(1, np.uint8)))
        band = replace(f, height=16 * rows, data=tuple(data))
        blocks = decode_alike(own, [band], Bits(own))[0]
        payload.append(payload_of(blocks, f.payload - top * w * UNIT))
        picture[16 * top : 16 * (top + rows)] = rgb(blocks, f.width, f.quantiser)
    return b"".join(payload), f.width, f.height, picture


def decode(media: list[bytes], apart: bool = True) -> list[tuple[bytes, int, int, np.ndarray]]:
    """Payload, width, height and RGB tensor of each file; one long file goes band by band."""
    if apart and len(media) == 1 and len(media[0]) > SLICE:
        return [decode_long(media[0])]
    buffer = b"".join(media)
    raw = np.frombuffer(buffer, np.uint8)
    if not len(raw):
        return []
    marks = markers(raw)
    stops = np.cumsum([len(m) for m in media])
    files = [parse(buffer, int(b) - len(m), int(b), marks) for m, b in zip(media, stops, strict=True)]
    bits = Bits(raw)
    alike: dict[tuple, list[int]] = defaultdict(list)
    for i, f in enumerate(files):
        alike[f.tables, f.scans, f.restart].append(i)
    out: list = [None] * len(files)
    for own in alike.values():
        found = decode_alike(raw, [files[i] for i in own], bits)
        # Pictures of one unit's width stand on each other and are transformed at once.
        stacks: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        for j, i in enumerate(own):
            stacks[files[i].width, files[i].quantiser].append(j)
        for (width, quantiser), members in stacks.items():
            whole = [members] if width == 16 else [[j] for j in members]
            for group in whole:
                picture, at = rgb(np.concatenate([found[j] for j in group]), width, quantiser), 0
                for j in group:
                    f = files[own[j]]
                    out[own[j]] = (payload_of(found[j], f.payload), f.width, f.height, picture[at : at + f.height])
                    at += f.height
    return out


def feature(picture: np.ndarray) -> str:
    """Size, mean colours in thousandths and checksum of a tensor."""
    h, w, _ = picture.shape
    total = sum(picture[i : i + 1024].sum(axis=(0, 1), dtype=np.int64) for i in range(0, h, 1024))
    means = total * 1000 // (h * w)
    return f"{w}x{h}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(np.ascontiguousarray(picture)):08x}"


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of texts, one after another, and their sizes."""
    n = np.diff(offsets)
    size = np.maximum(-(-n // PAD), 1) * PAD
    out = np.full(int(size.sum()), 255, np.uint8)
    if len(n) == 1:
        out[: len(raw)] = raw
    else:
        out[np.arange(len(raw)) + np.repeat(np.cumsum(size) - size - offsets[:-1], n)] = raw
    return out, size


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (the JPEG file of its padded bytes) of every row of `docs`."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, offsets = utf8_bytes(part.column("text"))
                payloads, size = padded(raw, offsets)
                files = [encode_long(payloads)] if is_long(part.column("text"), SLICE) else encode(raw=payloads, sizes=size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(stored, f"doc_id {kind}, n_bytes bigint, media binary")


def load(media: DataFrame) -> DataFrame:
    """All columns of `media`, with payload, width, height and rgb (the tensor, height x width x 3 bytes)."""

    def read(files: list[bytes]) -> list[pa.Array]:
        found = decode(files)
        return [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3].tobytes() for x in found], pa.binary())]

    return mapped(media, "payload binary, width int, height int, rgb binary", read, keep=True)


def tensors(media: DataFrame) -> DataFrame:
    """`load` with the digests of payload and media in their place."""

    def read(files: list[bytes]) -> list[pa.Array]:
        found = decode(files)
        columns = (
            ([len(x[0]) for x in found], pa.int64()), ([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string()), ([zlib.crc32(x[0][-32:]) for x in found], pa.int64()),
            ([len(m) for m in files], pa.int64()), ([hashlib.sha256(m).hexdigest() for m in files], pa.string()), ([x[1] for x in found], pa.int32()), ([x[2] for x in found], pa.int32()),
            ([x[3].tobytes() for x in found], pa.binary()),
        )
        return [pa.array(values, kind) for values, kind in columns]

    return mapped(media, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, rgb binary", read, keep=False)


def mapped(media: DataFrame, fields: str, read: Callable[[list[bytes]], list[pa.Array]], keep: bool) -> DataFrame:
    """Columns made of the files of `media`, beside its other columns."""
    names = [c for c in media.columns if keep or c != "media"]

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", SLICE):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *read(part.column("media").to_pylist())], [*names, *(f.split()[0] for f in fields.split(", "))])

    own = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)
    return media.mapInArrow(loaded, f"{own}, {fields}")


def described(stored: DataFrame) -> DataFrame:
    """A table of tensors (width, height and rgb) with the feature of each in place of rgb."""
    names = [c for c in stored.columns if c != "rgb"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature(np.frombuffer(x.as_buffer(), np.uint8).reshape(h, w, 3)) for x, h, w in zip(batch.column("rgb"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], [*names, "feature"])

    own = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in names)
    return stored.mapInArrow(read, f"{own}, feature string")


def waves(spark: SparkSession, path: str, most: int = WAVES) -> list[DataFrame]:
    """A table in up to `most` parts that together are all of its rows: groups of its files."""
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    n = min(most, len(files))
    if n < 2:
        return [whole]
    bounds = [len(files) * i // n for i in range(n + 1)]
    own = spark.read.schema(whole.schema).option("basePath", path)
    return [own.parquet(*files[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def digests(docs: DataFrame | list[DataFrame]) -> DataFrame:
    """What was stored for every row of `docs`, as read back: media and tensors are tables of the shared folder. Of several frames, such as `waves`, the tables of one are removed when its digests are written, before the next."""
    out = []
    for part in docs if isinstance(docs, list) else [docs]:
        media = cut(store(part), "media")
        pictures = cut(tensors(media), "tensors")
        out.append(cut(described(pictures).drop("width", "height"), "digests"))
        drop(media)
        drop(pictures)
    return reduce(DataFrame.unionAll, out)
