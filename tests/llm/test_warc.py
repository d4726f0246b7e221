"""Bundles: layout, seeking, revisits, damage."""

import hashlib
import io
import random

import pytest
import zstandard

from tidemark.llm import seekable, warc

PAGES = [
    (5, "http://a.example/x y\r\nEvil: 1", "<p>" + "same " * 40),
    (3, "http://a.example/1", "<p>" + "same " * 40),
    (9, None, "<p>" + "same " * 40),
    (1, "http://a.example/s", "short"),
    (2, "http://a.example/s", "short"),
    (4, "http://b.example/", None),
    (6, "http://b.example/", ""),
    (7, "http://b.example/ü", "é" * 50),
    (8, "http://b.example/ü", "é" * 50),
    (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200),
    (None, "n", "z" * 300),
    (None, "n", "z" * 300),
    (None, "n", "<p>" + "same " * 40),
    (11, "twice", "t" * 100),
    (11, "twice", "t" * 100),
    (12, "long", "long text " * 60_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, first string")


def expected(rows):
    least = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            least[data] = min(least.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(data, page)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("frame_bytes", "bundle_bytes"), [(1 << 18, 1 << 22), (500, 2_000)])
def test_archives_come_back(spark, tmp_path, frame_bytes, bundle_bytes):
    got = warc.archive(frame(spark, PAGES), str(tmp_path / "w"), frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(PAGES)
    for row in spark.read.parquet(str(tmp_path / "w")).collect():
        data = bytes(row.data)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        table = seekable.seek_table(data)
        assert sum(size for _, _, size in table) == len(whole)
        for place in row.records:
            record = seekable.record_at(data, place.frame, place.offset, place.length)
            ((_, parsed),) = seekable.parse_records(record)
            assert parsed.headers["WARC-Record-ID"] == place.record_id
            assert "Evil" not in parsed.headers


def test_many_short_and_many_equal_pages(spark):
    rows = [(i, None, "") for i in range(400)] + [(1_000 + i, "u", "short") for i in range(400)] + [(2_000 + i, "u", "e" * 100) for i in range(400)]
    got = warc.archive(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_no_pages(spark, tmp_path):
    assert warc.archive(frame(spark, []), str(tmp_path / "w")).count() == 0


def test_a_response_holds_the_payload_and_a_revisit_does_not():
    payload = b"x" * 500
    digest = hashlib.sha256(payload).hexdigest()
    response = seekable.make_record(1, "u", payload, digest, 1, False, "d")
    revisit = seekable.make_record(2, "u", payload, digest, 1, True, "d")
    assert payload in response and payload not in revisit
    for data in (response, revisit):
        ((_, r),) = seekable.parse_records(data)
        assert seekable.payload_facts(r) == (500, digest)


def test_damage_is_found():
    bundle = seekable.Bundle(1_000)
    rng = random.Random(1)
    for i in range(20):
        payload = bytes(rng.randrange(256) for _ in range(300))
        bundle.add(seekable.make_record(i, "u", payload, hashlib.sha256(payload).hexdigest(), i, False, "d"))
    data = bundle.close()
    with pytest.raises(ValueError):
        seekable.seek_table(data[:-1])
    first = seekable.frame(data, seekable.seek_table(data)[0])
    with pytest.raises(ValueError):
        list(seekable.parse_records(first[:-3]))
    at = first.index(b"\r\n\r\n", first.index(b"HTTP/1.1")) + 10
    ((_, broken), *_) = seekable.parse_records(first[:at] + bytes([first[at] ^ 1]) + first[at + 1 :])
    with pytest.raises(ValueError):
        seekable.payload_facts(broken)
