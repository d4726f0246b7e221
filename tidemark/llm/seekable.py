"""Seekable Zstandard bundles of WARC records.

A bundle is a run of independent Zstandard frames, each with some whole
records, and a skippable frame at the end with the sizes of all frames.  Any
Zstandard reader unpacks it; with the footer a single frame can be reached.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard

# Fixed values of the format: the skippable frame's and the footer's magic numbers.
SKIPPABLE = 0x184D2A5E
FOOTER = 0x8F92EAB1

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


class Bundle:
    """Collects records; ``place`` of each is its frame, offset and length there."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.raw = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.held_bytes, len(record)
        self.held.append(record)
        self.held_bytes += len(record)
        self.raw += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.packer.compress(b"".join(self.held))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held_bytes))
            self.held, self.held_bytes = [], 0

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, packed size and size of each frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - frames * width, []
    start = 0
    for k in range(frames):
        packed, size = struct.unpack_from("<II", bundle, at + k * width)
        out.append((start, packed, size))
        start += packed
    return out


def frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, size = place
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


def record_at(bundle: bytes, number: int, offset: int, length: int) -> bytes:
    """One record, unpacking only its frame."""
    return frame(bundle, seek_table(bundle)[number])[offset : offset + length]


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The HTTP body of a response."""
        return self.block.partition(b"\r\n\r\n")[2]


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    digits = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with the whole payload, or a revisit with its digest and length alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, Record]]:
    """Records of an unpacked frame, each with its offset; raises ValueError at anything else."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield at, Record(headers, block)
        at = end + 8 + n


def payload_facts(record: Record) -> tuple[int, str]:
    """Size and SHA-256 of the full payload; a response's are computed and held against its headers."""
    said = record.headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if record.headers["WARC-Type"] == "revisit":
        http = record.block.decode("latin-1").split("\r\n")
        return next(int(h.split(": ")[1]) for h in http if h.startswith("Content-Length")), said
    found = hashlib.sha256(record.payload).hexdigest()
    if found != said:
        raise ValueError(f"the payload of {record.headers['WARC-Record-ID']} is damaged")
    return len(record.payload), found
