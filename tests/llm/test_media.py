"""The JPEG codec against a plain encoder of general baseline files, and the columns."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from tests.llm.cases import ODD, empty, frame
from tidemark.llm import jpeg, media_columns


def canonical(counts):
    """Code of each symbol in a table given as 16 counts and symbols."""
    codes, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            codes[counts[at]] = f"{code:0{length}b}"
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def table(symbols):
    """All symbols with 8-bit codes, but the first with 3 bits."""
    first, rest = symbols[:1], symbols[1:]
    counts = [0] * 16
    counts[2], counts[8] = 1, len(rest)
    return bytes(counts) + bytes(first + rest)


def bits_of(v):
    size = abs(v).bit_length()
    return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""


def encode_plain(width, height, sampling, blocks, interval, dc, ac):
    """A baseline file with zero runs, end-of-block codes and restarts."""
    codes = canonical(dc), canonical(ac)
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    out, bits, last, n = b"", "", [0] * len(sampling), 0

    def flush():
        nonlocal out, bits
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        bits = ""

    for m in range(across * down):
        if interval and m and m % interval == 0:
            flush()
            out += bytes([0xFF, 0xD0 + n % 8])
            n, last = n + 1, [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for k in range(h * v):
                block = blocks[c][(m, k)]
                size, extra = bits_of(block[0] - last[c])
                last[c] = block[0]
                bits += codes[0][size] + extra
                run, end = 0, max([i for i in range(64) if block[i]], default=0)
                for i in range(1, end + 1):
                    if block[i] == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits += codes[1][0xF0]
                        run -= 16
                    size, extra = bits_of(block[i])
                    bits += codes[1][run << 4 | size] + extra
                    run = 0
                if end < 63:
                    bits += codes[1][0]
    flush()
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes(range(2, 66))) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac)
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + parts) + (seg(0xDD, struct.pack(">H", interval)) if interval else b"")
    return head + seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + b"\0\x3f\0") + out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_general_files(sampling, interval):
    rng = random.Random(str((sampling, interval)))
    dc, ac = table(list(range(12))), table([0, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 9)]][:200])
    files, expected = [], []
    for width, height in ((40, 24), (8, 8), (17, 33)):
        wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
        across, down = -(-width // (8 * wide)), -(-height // (8 * high))
        blocks = [{(m, k): [rng.randrange(-500, 500)] + [rng.choice([0] * 9 + [1, -7, 100]) for _ in range(63)] for m in range(across * down) for k in range(h * v)} for h, v in sampling]
        files.append(encode_plain(width, height, sampling, blocks, interval, dc, ac))
        want = []
        for c, (h, v) in enumerate(sampling):
            grid = np.zeros((down * v, across * h, 64), int)
            for (m, k), b in blocks[c].items():
                grid[m // across * v + k // h, m % across * h + k % h] = b
            want.append(grid.reshape(-1, 64))
        expected.append(want)
    for picture, want in zip(jpeg.decode(files), expected, strict=True):
        for part, own in zip(picture.parts.values(), want, strict=True):
            assert (part.coefficients == own).all()
        assert jpeg.thumbnail(picture).shape == next(iter(picture.parts.values())).shape


def test_payloads_come_back():
    payloads = [media_columns.padded(x) for x in (b"", b"\xff" * 1000, os.urandom(50_000), bytes(range(256)) * 9, b"a" * 191, b"a" * 192, b"a" * 193)]
    files = jpeg.encode(payloads)
    assert [jpeg.payload(p) for p in jpeg.decode(files)] == payloads
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)


def test_thumbnail_is_the_mean_of_blocks():
    picture = jpeg.decode(jpeg.encode([bytes([200]) + bytes(191)]))[0]
    assert jpeg.thumbnail(picture).tolist() == [[round(200 * 4 / 8) + 128]]


def test_average_hash_sees_every_pixel():
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (3, 5), (8, 8), (13, 70), (64, 80)):
        pixels = rng.integers(0, 256, (h, w)).astype(np.uint8)
        cut = lambda n: [(i * n // 8, max((i + 1) * n // 8, i * n // 8 + 1)) for i in range(8)]
        means = np.array([[pixels[a:b, c:d].mean() for c, d in cut(w)] for a, b in cut(h)])
        assert jpeg.average_hash(pixels) == np.packbits(means > means.mean()).tobytes().hex()
    dark = np.zeros((64, 64), np.uint8)
    lit = dark.copy()
    lit[1:8, 1:8] = 200  # no pixel at the start of an area
    assert jpeg.average_hash(dark) != jpeg.average_hash(lit)


def test_broken_files():
    good = jpeg.encode([b" " * 192])[0]
    for bad in (b"GIF89a", good[:60], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode([bad])


def test_columns(spark):
    rows = media_columns.media_columns(frame(spark, ODD), keep_media=True).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r in rows:
        data = jpeg.payload(jpeg.decode([bytes(r.media)])[0])
        assert r.payload_bytes == len(data) and len(data) % 192 == 0 and len(data) > 0
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert data[r.n_bytes :].strip(b" ") == b""
        assert by_text.setdefault(data, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    want = sorted(media_columns.padded((t or "").encode()) for _, t in ODD)
    assert sorted(jpeg.payload(jpeg.decode([bytes(r.media)])[0]) for r in rows) == want
    assert media_columns.media_columns(empty(spark)).count() == 0
