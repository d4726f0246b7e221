"""Baseline JPEG in numpy: a lossless writer for byte payloads and a reader.

The writer's unit is the quantised coefficient.  One MCU of three 8 by 8
components holds 192 payload bytes, each as one coefficient of size category 8,
whose 8 extra bits are the byte.  A restart interval per MCU resets the
predictors, so every DC difference is a byte as well.  Any baseline reader
accepts the file.

The reader takes baseline files in general (any Huffman tables, sampling,
restart intervals, one or more scans).  All restart intervals of many files
are decoded together, one symbol of each at a step.
"""

from __future__ import annotations

import functools
import re
import struct
from dataclasses import dataclass, field

import numpy as np

MCU = 192
ROW = 64  # MCUs in a row, more only where a column would be too high
MOST = 8191  # MCUs of 8 pixels in 65,535
LANES = 1 << 15  # restart intervals decoded together
END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")

# Fixed values of the format: marker codes.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def _tables() -> bytes:
    quant = bytes([0, 4]) + bytes([1] * 63)
    one_code = bytes([1]) + bytes(15) + bytes([8])  # the 1-bit code 0 is size 8 without a run
    return _segment(DQT, quant) + _segment(DHT, b"\x00" + one_code + b"\x10" + one_code) + _segment(DRI, b"\x00\x01")


def grid(mcus: int) -> tuple[int, int]:
    width = max(min(mcus, ROW), -(-mcus // MOST))
    return width, -(-mcus // width)


def _head(width: int, height: int, size: int) -> bytes:
    parts = b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    frame = _segment(SOF0, struct.pack(">BHHB", 8, 8 * height, 8 * width, 3) + parts)
    scan = _segment(SOS, b"\x03" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\x00\x3f\x00")
    return b"\xff\xd8" + _segment(COM, b"payload %d" % size) + _tables() + frame + scan


def encode(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose size is a positive multiple of 192."""
    shapes = [grid(len(p) // MCU) for p in payloads]
    full = [w * h for w, h in shapes]
    data = np.frombuffer(b"".join(p + b" " * (n * MCU - len(p)) for p, n in zip(payloads, full, strict=True)), np.uint8).reshape(-1, 8)
    bits = np.empty((len(data), 9), np.uint8)  # eight times a 0 and 8 bits
    bits[:, 0] = data[:, 0] >> 1
    # a byte's last j bits share its place with the next one's leading 0
    for j in range(1, 8):
        bits[:, j] = (data[:, j - 1] << np.uint8(8 - j)) | (data[:, j] >> np.uint8(j + 1))
    bits[:, 8] = data[:, 7]
    mcus = len(data) // (MCU // 8)
    coded = np.empty((mcus, MCU * 9 // 8 + 2), np.uint8)
    coded[:, :-2] = bits.reshape(mcus, -1)
    ends = np.cumsum(full)
    place = np.arange(mcus) - np.repeat(ends - full, full)
    coded[:, -2] = 0xFF
    coded[:, -1] = 0xD0 + (place & 7)
    coded[ends - 1, -1] = EOI
    stuff = coded == 0xFF
    stuff[:, -2] = False
    at = np.flatnonzero(stuff.ravel())
    flat = np.insert(coded.ravel(), at + 1, 0).tobytes()
    cuts = ends * coded.shape[1] + np.searchsorted(at, ends * coded.shape[1])
    return [_head(w, h, len(p)) + flat[a:b] for p, (w, h), a, b in zip(payloads, shapes, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


@dataclass
class Part:
    """A component: sampling, tables, blocks and, once read, its coefficients in zigzag order."""

    across: int
    down: int
    quant: int
    shape: tuple[int, int] = (0, 0)
    coefficients: np.ndarray | None = None


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    parts: dict[int, Part] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class Scan:
    picture: Picture
    data: bytes
    interval: int  # MCUs between restarts, 0: none
    ids: list[int]
    tables: tuple[tuple[bytes, bytes], ...]  # DC and AC table of each


@functools.lru_cache(64)
def lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: length of the code times 256 plus its symbol; 0 if none."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse(data: bytes) -> tuple[Picture, list[Scan]]:
    """Markers of one file; raises ValueError if it is no baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    picture, scans, huffman, interval, at = Picture(), [], {}, 0, 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == EOI:
            return picture, scans
        size = int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == COM:
            picture.comment = body
        elif marker == DQT:
            while body:
                wide, n = body[0] >> 4, 65 + 64 * (body[0] >> 4)
                picture.quants[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]], body = body[1:n], body[n:]
        elif marker == DRI:
            interval = int.from_bytes(body)
        elif marker == SOF0:
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            picture.height, picture.width = struct.unpack(">HH", body[1:5])
            picture.parts = {body[i]: Part(body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == SOS:
            ids = [body[1 + 2 * i] for i in range(body[0])]
            tables = tuple((huffman[body[2 + 2 * i] >> 4], huffman[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0]))
            end = END_OF_SCAN.search(data, at)
            if not end:
                raise ValueError("a scan does not end")
            scans.append(Scan(picture, data[at : end.start()], interval, ids, tables))
            at = end.start()


def _layout(scan: Scan) -> tuple[int, int, list[tuple[int, int, int]]]:
    """MCUs across and down, and of each block in an MCU: index of the component, row and column."""
    p = scan.picture
    wide, high = max(x.across for x in p.parts.values()), max(x.down for x in p.parts.values())
    if len(scan.ids) == 1:  # its blocks in order, without those beyond the edge
        x = p.parts[scan.ids[0]]
        return -(-p.width * x.across // (8 * wide)), -(-p.height * x.down // (8 * high)), [(0, 0, 0)]
    blocks = [(k, r, c) for k, i in enumerate(scan.ids) for r in range(p.parts[i].down) for c in range(p.parts[i].across)]
    return -(-p.width // (8 * wide)), -(-p.height // (8 * high)), blocks


def _symbols(words: np.ndarray, start: np.ndarray, blocks: np.ndarray, part_of: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Coefficients (lane, block, 64) of restart intervals that start at given bits."""
    out = np.zeros((len(start), int(blocks.max(initial=0)), 64), np.int16)
    lane, bit, block, k = np.arange(len(start)), start.astype(np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    predicted = np.zeros((len(start), int(part_of.max()) + 1), np.int64)
    flat, stride, last = out.reshape(-1), out.shape[1] * 64, len(words) - 1
    todo = blocks
    while len(lane):
        part = part_of[block % len(part_of)]
        x = words[np.minimum(bit >> 3, last)].astype(np.uint64) << (bit & 7).astype(np.uint64)
        dc = k == 0
        entry = tables[2 * part + ~dc, (x >> np.uint64(48)).astype(np.int64)]
        if not entry.all():
            raise ValueError("bits that are no code")
        length, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        y = x << length.astype(np.uint64)
        extra = ((y >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (extra < (1 << size >> 1)), extra - (1 << size) + 1, extra)
        bit += length + size
        if dc.any():
            value = np.where(dc, value + predicted[lane, part], value)
            predicted[lane[dc], part[dc]] = value[dc]
        k += np.where(dc, 0, run)
        held = dc | (size > 0)
        if (k > 63).any():
            raise ValueError("a block has too many coefficients")
        if held.all():
            flat[lane * stride + block * 64 + k] = value
            k += 1
        else:
            flat[(lane * stride + block * 64 + k)[held]] = value[held]
            k = np.where(held | (run == 15), k + 1, 64)
        over = k > 63
        if over.any():
            block += over
            k[over] = 0
            left = block < todo
            if not left.all():
                lane, bit, block, k, todo = lane[left], bit[left], block[left], k[left], todo[left]
    return out


def decode(files: list[bytes]) -> list[Picture]:
    """Pictures with the coefficients of every component."""
    parsed = [parse(f) for f in files]
    alike: dict[tuple, list[Scan]] = {}
    for _, scans in parsed:
        for s in scans:
            alike.setdefault((s.tables, tuple(_layout(s)[2])), []).append(s)
    for (tables, blocks), scans in alike.items():
        joined = np.frombuffer(b"".join(s.data for s in scans) + bytes(16), np.uint8)
        ends = np.cumsum([len(s.data) for s in scans])
        starts = ends - [len(s.data) for s in scans]
        ff = np.flatnonzero(joined == 0xFF)
        after = joined[ff + 1]
        restart = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(joined), bool)
        keep[ff[after == 0] + 1] = False
        keep[ff[after == 0xFF]] = False  # a fill byte
        keep[restart] = keep[restart + 1] = False
        dropped = np.flatnonzero(~keep)
        plain = joined[keep]
        begin = np.sort(np.concatenate([starts, restart + 2]))
        begin = begin - np.searchsorted(dropped, begin)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(plain, 8)).view(">u8").ravel()
        lanes = []
        for s in scans:
            across, down, _ = _layout(s)
            n = across * down
            lanes += [s.interval] * (n // s.interval) + [n % s.interval] * (n % s.interval > 0) if s.interval else [n]
        if len(lanes) != len(begin):
            raise ValueError("restart markers do not fit the size")
        todo = np.array(lanes, np.int64) * len(blocks)
        part_of = np.array([b[0] for b in blocks])
        stacked = np.stack([lookup(t) for pair in tables for t in pair])
        read = []
        for a in range(0, len(lanes), LANES):
            got = _symbols(words, begin[a : a + LANES] * 8, todo[a : a + LANES], part_of, stacked)
            whole = np.arange(got.shape[1])[None, :] < todo[a : a + LANES, None]
            read.append(got.reshape(-1, 64) if whole.all() else got[whole])
        all_blocks, at = np.concatenate(read), 0
        for s in scans:
            across, down, _ = _layout(s)
            n = across * down * len(blocks)
            mine = all_blocks[at : at + n].reshape(down, across, len(blocks), 64)
            at += n
            for k, i in enumerate(s.ids):
                own = [j for j, b in enumerate(blocks) if b[0] == k]
                rows, columns = max(blocks[j][1] for j in own) + 1, max(blocks[j][2] for j in own) + 1
                part = s.picture.parts[i]
                part.shape = (down * rows, across * columns)
                part.coefficients = mine[:, :, own].reshape(down, across, rows, columns, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    return [p for p, _ in parsed]


def thumbnail(picture: Picture) -> np.ndarray:
    """Luminance at an eighth of the size, from the DC coefficients alone."""
    part = next(iter(picture.parts.values()))
    quant = picture.quants[part.quant][0]
    mean = np.rint(part.coefficients[:, 0].astype(np.float64) * quant / 8) + 128
    return np.clip(mean, 0, 255).astype(np.uint8).reshape(part.shape)


def average_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: which of 8 by 8 areas, each the mean of all its pixels, are brighter than the areas' mean."""
    h, w = pixels.shape
    top, left = np.arange(8) * h // 8, np.arange(8) * w // 8
    # below 8 rows or columns an area is the one pixel at its start
    bottom, right = np.maximum(np.arange(1, 9) * h // 8, top + 1), np.maximum(np.arange(1, 9) * w // 8, left + 1)
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = pixels.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    total = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    areas = total / np.outer(bottom - top, right - left)
    return np.packbits(areas > areas.mean()).tobytes().hex()


def payload(picture: Picture) -> bytes:
    """The bytes that ``encode`` stored."""
    size = int(picture.comment.removeprefix(b"payload "))
    mixed = np.concatenate([p.coefficients for p in picture.parts.values()], axis=1)
    return np.where(mixed > 0, mixed, mixed + 255).astype(np.uint8).tobytes()[:size]
