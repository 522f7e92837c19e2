"""WARC archives: pages written as records, whole-file gzip streams normalised to a member for each record, records read by offset.

Many archives come as one gzip stream over all records, so nothing in them can be read but from the start. The normaliser
inflates such a stream once, in pieces, writes every record again as a gzip member of its own and puts an index beside
the file (JSON lines: offset, length, type, id, digest of a record). With it any record is read by itself, so a large archive is
read by many tasks. Streams that already have several members are normalised alike; one that ends early raises.

Of records with equal payloads of `least` bytes or more, the one with the largest page_id is the response and the others
are revisits of it: they have its HTTP head, not its payload. Equal payloads are found by SHA-256; only the groups of two
or more come back to the scan that writes, as a broadcast up to BROADCAST_ROWS groups and by a join beyond.

Every file has a name of its own, and the names come back as rows of the task that wrote it, which are saved: a repeated or
lost task leaves files that no row names, and nothing reads them. They go with the folder.

Cases: a null payload is empty, a null url has no target header, line breaks in a url are escaped. A null page_id is less than
any other. Rows that share the largest page_id of a payload are all responses; any other repeated row is a revisit. An
empty table gives no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, drop_folder, new_folder, read_table, saved, small_batches, steps

#: Bytes of records in an archive, before compression.
ARCHIVE_BYTES = 256 << 20
#: Bytes that the normaliser holds of a record.
PIECE = 1 << 20
#: Compressed bytes of an archive that a task reads at a time.
READ_BYTES = 8 << 20
#: Groups of equal payloads (about 50 bytes each) that are broadcast.
BROADCAST_ROWS = 200_000
#: Compression of normalised archives, and of the streams before, which go when they are normalised.
LEVEL, RAW_LEVEL = 6, 1
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, records long, bytes long"
INDEX = "archive string, offset long, length long, kind string, record_id string, digest string"
RECORDS = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that driver and tasks share, and the path in it."""
    uri = re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", uri))
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A record's bytes; refers_to: the id of the response, of a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """The fields of a WARC or HTTP head, by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


class Output:
    """A file of one gzip member, or of many."""

    def __init__(self, fs: pafs.FileSystem, path: str, level: int = LEVEL) -> None:
        self.stream, self.level, self.at = fs.open_output_stream(path, compression=None), level, 0
        self.begin()

    def begin(self) -> None:
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.flush())

    def _put(self, data: bytes) -> None:
        self.at += len(data)
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()


class Inflated:
    """The bytes of a gzip file of one member or more, in order; at most a few pieces are held."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.stream, self.buffer = fs.open_input_stream(path, compression=None), bytearray()
        self.member, self.rest = zlib.decompressobj(31), b""

    def fill(self) -> bool:
        """Puts a piece into the buffer; False at the end."""
        while True:
            if self.member.eof:
                self.rest = self.member.unused_data or self.stream.read(PIECE)
                if not self.rest:
                    return False
                self.member = zlib.decompressobj(31)
            else:
                self.rest = self.member.unconsumed_tail or self.rest or self.stream.read(PIECE)
                if not self.rest:
                    raise EOFError("the gzip stream ends early")
            made, self.rest = self.member.decompress(self.rest, PIECE), b""
            if made:
                self.buffer += made
                return True

    def head(self) -> bytes | None:
        """The bytes up to an empty line, or None at the end."""
        at = 0
        while (found := self.buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 3)
            if not self.fill():
                if self.buffer.strip():
                    raise EOFError("the last record ends early")
                return None
        return bytes(self.take(found + 4))

    def take(self, n: int) -> bytearray:
        out = self.buffer[:n]
        del self.buffer[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise EOFError("the last record ends early")
            piece = bytes(self.take(min(n, PIECE)))
            n -= len(piece)
            yield piece


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files(folder)
        out, rows, size = None, 0, 0

        def close() -> pa.RecordBatch:
            out.end()
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [rows], "bytes": [out.at]})

        for batch in steps(batches, "payload"):
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url")] + [as_bytes(batch.column("payload"))] + [batch.column(k).to_pylist() for k in ("revisit", "last")]
            for page_id, url, payload, revisit, last in zip(*columns, strict=True):
                if out is None:
                    name, rows, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = Output(fs, f"{path}/{name}", RAW_LEVEL)
                data = record_of(page_id, url, payload, record_id(last) if revisit else None)
                out.write(data)
                rows, size = rows + 1, size + len(data)
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def with_revisits(pages: DataFrame, least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages(page_id, url, html) with payload, and whether a row revisits an equal payload, whose largest page_id is `last`."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    key = F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256)))
    groups = df.select("page_id", key.alias("key")).where("key is not null").groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1").drop("n"))
    small = groups.count() <= broadcast_rows
    df = df.withColumn("key", key).join(F.broadcast(groups) if small else groups, "key", "left")
    return df.select("page_id", "url", "payload", (F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))).alias("revisit"), "last")


def _make_folder(spark: SparkSession) -> str:
    folder = new_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """ARCHIVES for the records of with_revisits(), written to the folder as whole-file gzip streams."""
    small_batches(records.sparkSession)
    return saved(records.select("page_id", "url", "payload", "revisit", "last").mapInArrow(_write(folder, archive_bytes), ARCHIVES))


def normalise_file(fs: pafs.FileSystem, path: str, target_fs: pafs.FileSystem, target: str) -> tuple[int, int]:
    """One archive to one with a member for each record, and its index at `target`.idx; the number of records, and of bytes."""
    source, out, n = Inflated(fs, path), Output(target_fs, target), 0
    with target_fs.open_output_stream(f"{target}.idx", compression=None) as index:
        while (head := source.head()) is not None:
            fields = fields_of(head)
            start = out.at
            out.begin()
            out.write(head)
            for piece in source.pieces(int(fields["content-length"])):
                out.write(piece)
            if (end := b"".join(source.pieces(4))) != b"\r\n\r\n":
                raise ValueError(f"{path}: record {n} is longer than its length says")
            out.write(end)
            out.end()
            row = {"offset": start, "length": out.at - start, "kind": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "digest": fields.get("warc-payload-digest")}
            index.write(json.dumps(row).encode() + b"\n")
            n += 1
    out.close()
    return n, out.at


def _normalise(folder: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, path), (target_fs, to) = files(folder), files(target)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                n, size = normalise_file(fs, f"{path}/{archive}", target_fs, f"{to}/{name}")
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size]})

    return run


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """ARCHIVES of the normalised files in `target`, for archives(archive) in `folder`. A stream can't be split: it is a task's."""
    n = archives.count()
    return saved(archives.select("archive").repartition(max(1, n)).mapInArrow(_normalise(folder, target), ARCHIVES))


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{archive}.idx", compression=None) as stream:
                    rest = b""
                    while data := stream.read(PIECE):
                        *lines, rest = (rest + data).split(b"\n")
                        rows = [{"archive": archive} | json.loads(x) for x in lines]
                        yield pa.RecordBatch.from_pylist(rows, _INDEX)

    return run


_INDEX = pa.schema([(k, pa.int64() if k in ("offset", "length") else pa.string()) for k in ("archive", "offset", "length", "kind", "record_id", "digest")])
_RECORDS = pa.schema([(k, pa.int64() if k == "payload_bytes" else pa.binary() if k == "payload" else pa.string()) for k in ("record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")])


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """INDEX for every record of the normalised archives."""
    return archives.select("archive").mapInArrow(_index(folder), INDEX)


def parse_record(data: bytes) -> dict:
    """A row of RECORDS. Digest and size of a response are those of the payload that was read, of a revisit what its head says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    revisit, told = fields["warc-type"] == "revisit", fields["warc-payload-digest"].removeprefix("sha1:")
    digest = told if revisit else digest_of(payload)
    if digest != told:
        raise ValueError(f"{fields['warc-record-id']}: the payload is not what its digest says")
    size = int(fields_of(http)["content-length"]) if revisit else len(payload)
    return {"record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("warc-refers-to"), "payload": None if revisit else payload}


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files(folder)
        now, stream = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
                if archive != now:
                    if stream is not None:
                        stream.close()
                    now, stream = archive, fs.open_input_file(f"{path}/{archive}")
                row = parse_record(zlib.decompress(stream.read_at(length, offset), 31))
                if not payloads:
                    row["payload"] = None
                rows.append(row)
                size += len(row["payload"] or b"")
                if size > PIECE:
                    yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return run


def read_records(index: DataFrame, folder: str, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """RECORDS for the rows of an index, each read at its offset; stretches of READ_BYTES of an archive are dealt to tasks.

    tasks: as many as there are stretches, unless given. Index rows are small, so Spark would join them all in one task.
    """
    stretch = F.expr(f"offset div {READ_BYTES}")
    tasks = tasks or max(1, index.agg(F.count_distinct("archive", stretch)).first()[0])
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(folder, payloads), RECORDS)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [pa.array(map(page_of, batch.column(k).to_pylist()), pa.int64()) for k in ("record_id", "refers_to")]
        yield pa.RecordBatch.from_arrays([ids[0], *(batch.column(k) for k in ("payload_bytes", "payload_digest", "record_type")), ids[1]], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive_pages(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, str]:
    """Pages to normalised archives: ARCHIVES, and their folder."""
    spark = pages.sparkSession
    raw, target = _make_folder(spark), _make_folder(spark)
    written = write_archives(with_revisits(pages, least, broadcast_rows), raw, archive_bytes)
    done = normalise(written, raw, target)
    drop_folder(raw)
    return done, target


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, folder = archive_pages(read_table(spark, sf_dir, "pages"))
    stretches = archives.agg(F.sum(F.expr(f"bytes div {READ_BYTES} + 1"))).first()[0]
    found = read_records(read_index(archives, folder), folder, payloads=False, tasks=stretches)
    return found.mapInArrow(_pages, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS last,
    array_to_string(flatten(list_transform(range(8), lambda j: list_transform(range(4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 5 * CAST(j AS INT) + 1, 5) AS INT) >> (15 - 5 * CAST(k AS INT))) & 31), 1)))), '') AS payload_digest
  FROM p)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
