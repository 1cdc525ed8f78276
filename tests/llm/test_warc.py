"""Archives: round trips, a plain version of the records, broken files, odd inputs."""

import gzip
import hashlib
import io
import os
import re

import pytest
from strikelens.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to string, salt string, chunk_no string"
MARK = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"  # what looks like a record inside a payload


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def _plain(rows):
    held = [(i, (h or "").encode()) for i, _, h in rows]
    key = lambda i: (i is not None, i or 0)
    tops = {}
    for i, p in held:
        if len(p) >= warc.SHARED_BYTES:
            tops[p] = max(tops.get(p, i), i, key=key)
    out = []
    for i, p in held:
        to = tops.get(p)
        revisit = p in tops and to != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(map(repr, out))


def _found(df):
    return sorted(repr(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ROWS = [
    (1, "http://a.example/ä b\r\nX: y", "é" * 700), (2, None, "é" * 700), (7, "u", "é" * 700), (7, "u", "é" * 700), (None, "u", "é" * 700),
    (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, None, None), (None, "u", "n" * 2000), (None, "u", "n" * 2000),
    (8, "u", MARK * 400), (9, "u", MARK * 400), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000),
    (-14, "u", "漢字 \x00 😀" * 90_000), (15, "u", "漢字 \x00 😀" * 90_000),
]


def test_archived_equals_plain_version(spark, tmp_path):
    assert _found(warc.archived(_pages(spark, ROWS), str(tmp_path))) == _plain(ROWS)


def test_a_payload_of_very_many_rows(spark, tmp_path):
    rows = [(i, f"u{i}", "same " * 300) for i in range(3000)] + [(10_000 + i, "u", f"{i} " * 600) for i in range(500)]
    assert _found(warc.archived(_pages(spark, rows), str(tmp_path))) == _plain(rows)


def test_empty_table(spark, tmp_path):
    assert warc.archived(_pages(spark, []), str(tmp_path)).collect() == []


@pytest.mark.parametrize("compress", [True, False])
def test_chunks_come_back(spark, tmp_path, compress):
    pages = _pages(spark, ROWS)
    warc.write_archive(warc.chunks(warc.records(pages), size=1000), str(tmp_path), compress=compress, file_bytes=5000)
    got = {}
    rows = warc.read_chunks(spark, str(tmp_path), size=777).collect()
    for r in sorted(rows, key=lambda r: (r.file, r.record_no, r.chunk_no)):
        held, digest = got.setdefault((r.file, r.record_no), ([], hashlib.sha1()))
        assert len(r.data) <= 777 and r.chunk_no == len(held)
        held.append(r.data)
        digest.update(r.data)
        assert r.digest == digest.hexdigest()
        assert r.last == (r.type == "revisit" or sum(map(len, held)) == r.payload_bytes)
    payloads = sorted(b"".join(held) for held, _ in got.values())
    types = {(r.file, r.record_no): r.type for r in rows}
    stored = sorted(b"".join(held) for k, (held, _) in got.items() if types[k] == "response")
    plain = [(h or "").encode() for _, _, h in ROWS]
    assert len(payloads) == len(ROWS)
    assert sorted(set(stored)) == sorted(set(plain))
    assert len({r.file for r in rows}) > 1


def test_files_are_warc(spark, tmp_path):
    """What is stored is read by a parser that knows nothing of ours."""
    warc.write_archive(warc.chunks(warc.records(_pages(spark, ROWS))), str(tmp_path))
    n = 0
    for name in os.listdir(tmp_path / "archives"):
        raw = gzip.open(tmp_path / "archives" / name).read()
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$", fields["WARC-Date"])
            size = int(fields["Content-Length"])
            assert raw[size : size + 4] == b"\r\n\r\n"
            raw, n = raw[size + 4 :], n + 1
    assert n == len(ROWS)


def _record(payload, kind="response", **more):
    extra = "".join(f"{k}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_parser_reads_foreign_archives():
    payloads = [b"", b"x" * 10_000, MARK.encode(), b"\r\n\r\n", b"last"]
    whole = b"".join(_record(p, n=i) for i, p in enumerate(payloads))
    members = b"".join(gzip.compress(_record(p, n=i)) for i, p in enumerate(payloads))
    for raw in (whole, members, gzip.compress(whole), whole.rstrip(b"\r\n")):
        for size in (3, 7, 64, 5000, 1 << 16):
            got = {}
            for headers, number, data, digest, last in warc.parse(io.BytesIO(raw), size):
                held = got.setdefault(headers["n"], [])
                assert number == len(held) and len(data) <= size
                held.append(data)
                assert digest == hashlib.sha1(b"".join(held)).hexdigest()
            assert [b"".join(h) for h in got.values()] == payloads
    assert list(warc.parse(io.BytesIO(b""))) == []


def test_broken_archives_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="early"):
        list(warc.parse(io.BytesIO(_record(b"x" * 100)[:-50])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))
    with pytest.raises(ValueError, match="header block"):
        list(warc.parse(io.BytesIO(b"WARC/1.0\r\n" + b"a: b\r\n" * 300_000)))
    warc.write_archive(warc.chunks(warc.records(_pages(spark, ROWS[:1]))), str(tmp_path), compress=False)
    [name] = [n for n in os.listdir(tmp_path / "archives") if n.endswith(".warc")]
    file = tmp_path / "archives" / name
    file.write_bytes(file.read_bytes().replace("éé".encode(), b"abcd", 1))
    for crc in (tmp_path / "archives").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="broken payload"):
        warc.read_pages(spark, str(tmp_path)).collect()


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    warc.write_archive(warc.chunks(warc.records(_pages(spark, ROWS))), str(tmp_path))
    (tmp_path / "archives" / "left-behind.warc").write_bytes(b"half a record")
    assert _found(warc.read_pages(spark, str(tmp_path))) == _plain(ROWS)


def test_storage_paths():
    for path in ("/a/b", "file:/a/b", "file:///a/b"):
        assert warc.storage(path)[1] == "/a/b"
