"""Web archives packed in ZIP files: a writer, and a reader that range-reads records.

An archive holds stored (not compressed) members in pairs: a WARC file of some
records and an index with the range of each. The reader parses the end record and
the central directory, in their ZIP64 forms too, finds the members and reads the
records' ranges of an index in place. Spark's text writer writes archives through
any Hadoop file system with its commit protocol, one per partition: it ends each
row with a line feed, which pads between members and is the ZIP comment at the end.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, shuffle_partitions

MEMBER = 4 << 20  # bytes of records after which a member ends
RUN = 1 << 20  # bytes of neighbouring records read at once, at least one record
_DATE = "2024-01-01T00:00:00Z"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF

# ---- ZIP


def _local(name: bytes, data_size: int, crc: int, zip64: bool) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, data_size, data_size) if zip64 else b""
    n = _MAX32 if zip64 else data_size
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, n, n, len(name), len(extra)) + name + extra


class ZipWriter:
    """Rows of bytes that, each followed by one line feed, make up a ZIP archive."""

    def __init__(self, zip64: bool = False) -> None:
        self.at, self.entries, self.force = 0, [], zip64

    def member(self, name: str, data: bytes) -> bytes:
        raw, crc = name.encode(), zlib.crc32(data)
        big = self.force or len(data) >= _MAX32
        self.entries.append((raw, crc, len(data), self.at))
        row = _local(raw, len(data), crc, big) + data
        self.at += len(row) + 1
        return row

    def end(self) -> bytes:
        out = bytearray()
        for name, crc, size, offset in self.entries:
            big = self.force or size >= _MAX32 or offset >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            n, o = (_MAX32, _MAX32) if big else (size, offset)
            out += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, n, n, len(name), len(extra), 0, 0, 0, 0, o) + name + extra
        n, size, start = len(self.entries), len(out), self.at
        if self.force or n >= _MAX16 or start + size >= _MAX32:
            out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start)
            out += struct.pack("<IIQI", 0x07064B50, 0, start + size, 1)
            n, size, start = _MAX16, _MAX32, _MAX32
        # the comment is the line feed that follows the row
        return bytes(out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 1))


def _open(path: str, content: bytes | None = None):
    """A random-access file: by pyarrow's file systems (local, hdfs, s3, gs, abfs), or over content that Spark has read."""
    from pyarrow import fs

    if content is not None:
        return pa.BufferReader(content)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote(re.sub("^file:/*", "/", path)))
    where, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return where.open_input_file(name)


def directory(f, size: int) -> list[tuple[str, int, int]]:
    """(name, offset of the data, size) of the stored members; ValueError if it isn't a ZIP archive of such."""
    tail_size = min(size, 22 + _MAX16 + 20)
    tail = f.read_at(tail_size, size - tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack("<IHHHHIIH", tail[at : at + 22])
    if (n == _MAX16 or length == _MAX32 or start == _MAX32) and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        end64 = f.read_at(56, struct.unpack("<IIQI", tail[at - 20 : at])[2])
        _, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", end64)
    out, pos, block = [], 0, f.read_at(length, start)
    for _ in range(n):
        sig, _, _, _, method, _, _, _, packed, plain, ln, lx, lc, _, _, _, offset = struct.unpack("<IHHHHHHIIIHHHHHII", block[pos : pos + 46])
        if sig != 0x02014B50:
            raise ValueError("central directory is damaged")
        name, extra = block[pos + 46 : pos + 46 + ln].decode(), block[pos + 46 + ln : pos + 46 + ln + lx]
        while len(extra) >= 4:
            kind, have = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{have // 8}Q", extra[4 : 4 + have // 8 * 8]))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                offset = next(wide) if offset == _MAX32 else offset
            extra = extra[4 + have :]
        if method != 0 or packed != plain:
            raise ValueError(f"{name} is compressed")
        head = f.read_at(30, offset)
        out.append((name, offset + 30 + sum(struct.unpack("<HH", head[26:30])), plain))
        pos += 46 + ln + lx + lc
    return out


# ---- WARC


def _record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}",
    ]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, the HTTP head and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def write(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, member: int = MEMBER, zip64: bool = False) -> None:
    """Writes a record per row to ZIP archives under ``path``, one archive per partition.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id
    is a response and the others are revisits of it (rows that repeat that id are all
    responses); null html is an empty payload. Rows without id become responses unless
    an equal payload has an id. Other columns aren't read, whatever their names; an empty
    table writes no archive; a record is held whole by its task, however long.
    Only digests are shuffled while the table of repeated ones, by which rows are
    joined, is below the session's broadcast threshold. Beyond it rows are shuffled by
    digest: payloads below ``least`` spread evenly there, since they can match nothing, and AQE splits
    the rows of a popular one.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("html")).withColumn("digest", F.sha1("html"))
    repeated = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated = materialize(repeated, "digests")
    # payloads that are too short to be revisited have keys of their own, so that empty pages aren't one key
    rows = rows.withColumn("match", F.when(F.octet_length("html") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    joined = rows.join(repeated.withColumnRenamed("digest", "match"), "match", "left")
    joined = joined.select("id", "url", "html", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, part, k = ZipWriter(zip64), TaskContext.get().partitionId(), 0
        data, index = bytearray(), []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal k
            name = f"{part:05d}-{k:05d}"
            yield row(zip_.member(f"archive/{name}.warc", bytes(data)))
            yield row(zip_.member(f"indexes/{name}.jsonl", "".join(json.dumps(x) + "\n" for x in index).encode()))
            data.clear()
            index.clear()
            k += 1

        for batch in batches:
            for i, url, html, digest, refers in zip(*(batch.column(c) for c in range(5))):
                record = _record(i.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers.as_py())
                if data and len(data) + len(record) > member:
                    yield from close()
                index.append([len(data), len(record)])
                data.extend(record)
        if data:
            yield from close()
        if zip_.entries:
            yield row(zip_.end())

    def row(data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str, ranged: bool = True) -> DataFrame:
    """The records of all archives under ``path``: (page_id, url, record_type, refers_to, payload_digest, http, payload).

    payload_digest is the bare lower-case hex SHA-1 of the full payload; a revisit's
    payload is null. Archives are listed and their directories parsed by tasks; then
    members, a few megabytes each, are dealt out, and runs of neighbouring records
    read by range. A response whose digest doesn't match fails the job. Ranges are read by
    pyarrow's file systems; for one that only Hadoop knows set ``ranged`` to False: Spark then
    reads archives whole, one per task at a time, and everything else is the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    files = files.select("path", "length", *([] if ranged else ["content"]))

    def located(f, size: int) -> list[tuple[int, int, int]]:
        """(start of the records, start and size of their index) of each pair of members."""
        found = {n: (o, s) for n, o, s in directory(f, size)}
        return [(o, *found[i]) for n, (o, s) in found.items() if n.startswith("archive/") and (i := f"indexes/{n[8:-5]}.jsonl") in found]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(name) as f:
                    pairs = located(f, size)
                cols = list(zip(*pairs)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pairs), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["path", "start", "index", "index_size"])

    def records_of(f, start: int, index: int, size: int) -> Iterator[pa.RecordBatch]:
        ranges = [json.loads(x) for x in f.read_at(size, index).splitlines()]
        at = 0
        while at < len(ranges):
            to, low = at + 1, ranges[at][0]
            while to < len(ranges) and ranges[to][0] + ranges[to][1] - low <= RUN:
                to += 1
            block = f.read_at(ranges[to - 1][0] + ranges[to - 1][1] - low, start + low)
            yield made([block[o - low : o - low + n] for o, n in ranges[at:to]])
            at = to

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *where in zip(*(batch.column(k).to_pylist() for k in range(4))):
                with _open(name) as f:
                    yield from records_of(f, *where)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, content in zip(*(batch.column(k) for k in range(3))):
                with _open(name.as_py(), content.as_py()) as f:
                    for where in located(f, size.as_py()):
                        yield from records_of(f, *where)

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def made(raw: list[bytes]) -> pa.RecordBatch:
        rows = []
        for x in raw:
            fields, http, payload = parse_record(x)
            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
            kind = fields["warc-type"]
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
            # the HTTP head is kept with a revisit, and with it the payload's length
            length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
            rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), digest, length, payload if kind == "response" else None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    if not ranged:
        return files.mapInArrow(whole, schema)
    found = files.mapInArrow(members, "path string, start long, index long, index_size long")
    return found.repartition(shuffle_partitions(spark)).mapInArrow(records, schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes ``df`` to archives in the shared folder and returns their records, a row per row of ``df``."""
    path = scratch_path(df.sparkSession, "warc")
    write(df, path, **options)
    return read(df.sparkSession, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT html, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN r.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r.top <> p.page_id THEN r.top END AS refers_to
FROM p LEFT JOIN r ON p.html = r.html
"""
