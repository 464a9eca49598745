"""WARC archives: one gzip member per record, and a reader that splits them anywhere."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_dir, store, written

GZIP_MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: bytes of compressed archive that one task scans
SPLIT_BYTES = 8 << 20
#: tasks of a reader at most
MOST_TASKS = 100_000
#: read at once
STEP = 1 << 18
#: bytes of a member that are decoded to tell whether it starts a record
PROBE = 1 << 12


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: of pages with equal payloads of at least least_bytes, all but those with the largest page_id refer to it.

    Null html is an empty payload, and a null page_id orders before all others. Rows that repeat the largest page_id are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("_key", F.sha2("payload", 256))
    first = rows.groupBy("_key").agg(F.max("page_id").alias("_first"))
    other = (F.octet_length("payload") >= least_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_key").select("page_id", "url", "payload", F.when(other, F.col("_first")).alias("refers_to"))


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, record_id: str) -> bytes:
    """A record as one gzip member. A revisit has the HTTP head of its payload, without the payload. Page numbers have headers of their own, as pages may repeat theirs."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def decode_record(data: bytes) -> dict:
    """Fields of a decoded member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    url, number = fields.get("WARC-Target-URI"), lambda name: int(fields[name]) if name in fields else None
    out = {"record_id": fields["WARC-Record-ID"], "page_id": number("X-Page-ID"), "url": None if url is None else unquote(url), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": length, "refers_to": number("X-Refers-To-Page-ID")}
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "refers_to": None}


class _Window:
    """Bytes of a file by place, read in steps."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(max(n, STEP), self.size - at))
        return self.data[at - self.at : at - self.at + n]


def _starts_record(window: _Window, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(window.read(at, min(PROBE, window.size - at)), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def _member(window: _Window, at: int) -> tuple[bytes, int]:
    """A decoded member and the place after it."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        data = window.read(at, min(STEP, window.size - at))
        if not data:
            raise ValueError("an archive ends inside a record")
        out.append(unpack.decompress(data))
        at += len(data)
    return b"".join(out), at - len(unpack.unused_data)


def records_of_split(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records that start in [start, end): scans for the gzip magic, and takes a place for a member only if what it decodes to has a record's head."""
    window, at = _Window(file, size), start
    while at < min(end, size):
        if window.read(at, 3) == GZIP_MAGIC and _starts_record(window, at):
            data, at = _member(window, at)
            yield decode_record(data)
            continue
        data = window.read(at, min(STEP, size - at))
        found = data.find(GZIP_MAGIC, 1)
        at += found if found > 0 else max(1, len(data) - 2)


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of with_revisits, an archive for each task; returns (path, bytes, records). Each attempt has a file of its own."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size, n = TaskContext.get(), None, 0, 0
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, name = store(path)
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(name, compression=None)
            for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = encode_record(page_id, url, payload.encode(), refers_to, date, f"urn:uuid:{uuid5(NAMESPACE_URL, f'{path}#{n}')}")
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return rows.mapInArrow(write, "path string, bytes long, records long")


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives (path, bytes): record_id, page_id, url, record_type, payload_digest, payload, payload_bytes, refers_to. A task takes one split or, beyond MOST_TASKS, several."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(k).to_pylist() for k in ("path", "bytes", "start")), strict=True):
                fs, name = store(path)
                with fs.open_input_file(name) as file:
                    rows: list[dict] = []
                    for record in records_of_split(file, size, start, start + split_bytes):
                        rows.append(record)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
    splits = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return splits.repartition(min(MOST_TASKS, max(1, splits.count())), "path", "start").mapInArrow(read, "record_id string, page_id long, url string, record_type string, payload_digest string, payload binary, payload_bytes long, refers_to long")


def through_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC records and reads them back. An empty table gives no archive and no rows; other columns are ignored. The list of archives is a table."""
    archives, _ = written(write_archives(with_revisits(pages, least_bytes), new_dir(pages.sparkSession, "warc")), "archives")
    return read_archives(archives)
