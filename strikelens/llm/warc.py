"""WARC archives through a table of chunks.

A payload is never handled whole: it is cut into rows of a record identifier and a chunk number,
and whoever walks the rows carries the digest of what came before. Archives are written from such
rows (a record's rows follow each other, so a task holds one chunk) and read back into such rows
by a parser that asks the stream for a chunk at a time.

A task writes files under names of its own and names them in the index, which Spark commits; files
of a lost or repeated attempt are named nowhere and are not read. A file ends at the first record
end past ``FILE_BYTES`` (before compression), and a file is read by one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikelens.llm.common import map_batches

CHUNK, FILE_BYTES = 1 << 16, 128 << 20
#: Payloads from this size on are stored once.
SHARED_BYTES = 1000
#: Parts that the records of one payload are dealt to.
SALTS = 32
#: The longest header block that is read as one.
HEADER_BYTES = 1 << 20
LEVEL = 3

_ENDS = b"\r\n\r\n"
_RECORDS = "record_id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string"


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]:", "s3:", path)
    return pafs.FileSystem.from_uri(path)


def records(pages: DataFrame) -> DataFrame:
    """A record for each row of ``pages``: ``page_id``, ``uri``, ``payload`` (``html`` in UTF-8, null:
    empty), its size and SHA-1, and ``refers_to``: the largest ``page_id`` with an equal payload of
    ``SHARED_BYTES`` or more, where that is another one.

    Rows of one payload are first counted in ``SALTS`` parts and meet their target in these parts,
    so that a payload of very many rows is in no one task.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALTS)).cast("int"))
    keys = ["payload_digest", "payload_bytes"]
    parts = rows.where(F.col("payload_bytes") >= SHARED_BYTES).groupBy(*keys, "salt").agg(F.max("page_id").alias("top"))
    tops = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # at most SALTS rows
    parts = parts.withColumn("top", F.max("top").over(tops))
    found = rows.join(parts.hint("shuffle_hash"), [*keys, "salt"], "left")
    return found.select(
        "page_id", "uri", "payload", "payload_bytes", "payload_digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"),
    )


def chunks(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of ``records``: a row for each ``size`` bytes of a payload, numbered from 0, and
    one without bytes where nothing is stored. A record's rows follow each other."""
    stored = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(stored / size) - 1, F.lit(0).cast("long")))
    table = found.withColumn("stored_bytes", stored.cast("long")).withColumn("chunk_no", F.explode(numbers))
    data = F.expr(f"case when refers_to is null then substring(payload, cast(chunk_no * {size} as int) + 1, {size}) else x'' end")
    return table.select("page_id", "uri", "payload_bytes", "payload_digest", "refers_to", "stored_bytes", "chunk_no", data.alias("data"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _header(row: dict, date: str) -> bytes:
    """The header block of a record, with the empty line that ends it."""
    revisit = row["refers_to"] is not None
    uri = urllib.parse.quote(row["uri"] or "", safe="%/:?#[]@!$&'()*+,;=~-._")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(row['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {row['stored_bytes']}",
    ]
    if revisit:
        lines.insert(5, f"WARC-Refers-To: {_name(row['refers_to'])}")
        lines.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + _ENDS


class _File:
    """One archive being written, each record a gzip member of its own if compressed."""

    def __init__(self, folder: str, compress: bool) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
        system, inner = storage(self.path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out, self.compress, self.n, self.bytes, self.member = system.open_output_stream(inner, compression=None), compress, 0, 0, None

    def begin(self) -> None:
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31) if self.compress else None
        self.n += 1

    def write(self, data: bytes) -> None:
        self.bytes += len(data)
        self.out.write(self.member.compress(data) if self.member else data)

    def end(self) -> None:
        self.write(_ENDS)
        if self.member:
            self.out.write(self.member.flush())

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([self.path]), pa.array([self.n], pa.int64()), pa.array([self.bytes], pa.int64())], names=["file", "n_records", "n_bytes"]
        )


def write_archive(table: DataFrame, path: str, compress: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Store a chunk table below ``path``: archives, and the index that names them.

    The digest of a stored payload is carried from chunk to chunk and compared with the one that
    its header has told; a record that ends early or differs raises.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = f"{path}/archives"

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, digest, left, told = None, None, 0, ""
        for batch in batches:
            data = batch.column("data")
            for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if row["chunk_no"] == 0:
                    if left:
                        raise ValueError(f"a record ends {left} bytes early")
                    if file and file.bytes >= file_bytes:
                        yield file.close()
                        file = None
                    file = file or _File(folder, compress)
                    file.begin()
                    file.write(_header(row, date))
                    digest, left, told = hashlib.sha1(), row["stored_bytes"], row["payload_digest"]
                piece = data[i].as_buffer()
                digest.update(piece)
                left -= len(piece)
                file.write(piece.to_pybytes())
                if not left:
                    file.end()
                    if row["refers_to"] is None and digest.hexdigest() != told:
                        raise ValueError(f"payload of {_name(row['page_id'])} is not what its digest says")
        if left:
            raise ValueError(f"a record ends {left} bytes early")
        if file:
            yield file.close()

    map_batches(table, job, "file string, n_records long, n_bytes long").write.parquet(f"{path}/index")


class _Bytes:
    """A stream read a chunk at a time, plain or of gzip members."""

    def __init__(self, raw, size: int) -> None:
        self.raw, self.size, self.held, self.member = raw, size, b"", None
        first = raw.read(2)
        if first == b"\x1f\x8b":
            self.member = zlib.decompressobj(31)
        self.rest = first

    def _more(self) -> bytes:
        """Some further bytes, at most ``size``; none at the end."""
        if self.member is None:
            data, self.rest = self.rest or self.raw.read(self.size), b""
            return data
        while True:
            data = self.rest or self.raw.read(self.size)
            if not data:
                return b"" if self.member.eof else self.member.decompress(b"", self.size)
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(data, self.size)
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if out:
                return out

    def read(self, most: int) -> bytes:
        """At most ``most`` bytes; none at the end of the stream."""
        data = self.held or self._more()
        self.held = data[most:]
        return data[:most]

    def until(self, mark: bytes, most: int) -> bytes | None:
        """All up to ``mark``, without it; what comes before the end if there is none, ``None`` at the end."""
        got = b""
        while mark not in got:
            data = self.read(self.size)
            if not data:
                return got or None
            got += data
            if len(got) > most and mark not in got:
                raise ValueError(f"a header block of more than {most} bytes")
        head, _, tail = got.partition(mark)
        self.held = tail + self.held
        return head


def parse(raw, size: int = CHUNK) -> Iterator[tuple[dict, int, bytes, str, bool]]:
    """(headers, chunk number, bytes, SHA-1 of the payload so far, whether it is the last chunk) of
    the records of a stream, in order; a record without bytes has one chunk without bytes.
    Header names are in lower case. Nothing longer than a chunk or a header block is held."""
    stream = _Bytes(raw, size)
    while True:
        block = stream.until(_ENDS, HEADER_BYTES)
        if block is None:
            return
        block = block.strip(b"\r\n")
        if not block:  # what ends a record
            continue
        lines = block.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        left, number, digest = int(headers["content-length"]), 0, hashlib.sha1()
        while True:
            got, room = [], min(size, left)
            while room:
                piece = stream.read(room)
                if not piece:
                    raise ValueError(f"{headers.get('warc-record-id')} ends {left} bytes early")
                got.append(piece)
                room -= len(piece)
            data = b"".join(got)
            digest.update(data)
            left -= len(data)
            yield headers, number, data, digest.hexdigest(), not left
            number += 1
            if not left:
                break


def read_chunks(spark: SparkSession, path: str, with_data: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunk table of the archives below ``path``: ``file``, ``record_no`` in it, the record's
    ``record_id``, ``type``, ``uri``, ``refers_to``, ``payload_bytes`` and ``payload_digest`` as told by
    its header, ``chunk_no``, ``digest`` (SHA-1 of the payload up to and with this chunk), ``last`` and, if
    asked for, ``data``."""
    index = spark.read.schema("file string, n_records long, n_bytes long").parquet(f"{path}/index").select("file")
    # A row is a whole archive's work: a task has few of them.
    files = index.repartition(spark.sparkContext.defaultParallelism * 4, "file")
    schema = f"file string, record_no long, {_RECORDS}, chunk_no long, digest string, last boolean" + (", data binary" if with_data else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def hexed(told: str | None) -> str | None:
        kind, _, value = (told or "").partition(":")
        return base64.b32decode(value).hex() if kind == "sha1" else None

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, inner = storage(file)
                rows, held, record = [], 0, -1
                with system.open_input_stream(inner, compression=None) as raw:
                    for headers, number, data, digest, last in parse(raw, size):
                        record += number == 0
                        row = [
                            file, record, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"),
                            headers.get("warc-refers-to"), int(headers.get("x-payload-length", headers["content-length"])),
                            hexed(headers.get("warc-payload-digest")), number, digest, last,
                        ]
                        rows.append([*row, data] if with_data else row)
                        held += len(data) if with_data else 256
                        if held >= 64 * CHUNK:
                            yield _batch(rows, names, schema)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, schema)

    return map_batches(files, job, schema)


def _batch(rows: list, names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: ``page_id``, ``payload_bytes``, ``payload_digest`` (of a response
    what its bytes give, which must be what its header says), ``record_type`` and ``refers_to``."""
    last = read_chunks(spark, path, with_data=False).where("last")
    number = r"regexp_extract({}, '^<urn:page:(-?[0-9]+)>$', 1)"
    broken = F.raise_error(F.concat(F.lit("broken payload: "), "record_id")).cast("string")
    digest = F.when(F.col("type") == "revisit", F.col("payload_digest")).when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(broken)
    return last.where(F.col("type").isin("response", "revisit")).select(
        F.expr(f"cast(nullif({number.format('record_id')}, '') as bigint)").alias("page_id"),
        "payload_bytes",
        digest.alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr(f"cast(nullif({number.format('refers_to')}, '') as bigint)").alias("refers_to"),
    )


def archived(pages: DataFrame, path: str) -> DataFrame:
    """``pages`` written as archives below ``path`` and read back.

    A row gives a record, also where rows repeat. Of records with equal payloads of
    ``SHARED_BYTES`` or more those with the largest ``page_id`` are responses and the others
    revisit them; smaller ones are all responses. Rows without ``page_id`` count as smaller than
    any id. A null url is stored as an empty one; bytes that a header can't hold are
    percent-encoded. An empty table gives no archive and no rows. Other columns are ignored.
    """
    write_archive(chunks(records(pages)), path)
    return read_pages(pages.sparkSession, path)
