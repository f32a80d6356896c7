"""WARC archives: writing, normalising whole-file gzip, and indexed reading.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a stream once, in
blocks, rewrites each record as a gzip member of its own, and writes a sidecar index of the members' offsets, so that
any record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlquarry.llm.workspace import Workspace, split_join, with_temp_dir

BLOCK = 1 << 18
#: The lines that start and separate records, and the profile of a revisit.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    """min_revisit: least payload bytes of records that may revisit another. archive_bytes: payload after which a task
    starts the next archive; it bounds what one task inflates, not what it holds in memory."""

    min_revisit: int = 0
    archive_bytes: int = 256 << 20
    level: int = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that keeps the HTTP headers, Content-Length of the payload included."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    target = "".join(c if " " < c != "\x7f" else "%{:02X}".format(ord(c)) for c in (url or "about:blank"))
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one whole record."""
    if not record.startswith(b"WARC/"):
        raise ValueError("a record doesn't start with its version")
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _headers(head.partition(b"\r\n")[2])
    body = rest[: int(warc["content-length"])]
    if len(body) != int(warc["content-length"]):
        raise ValueError("a record is cut short")
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, _headers(http.partition(b"\r\n")[2]), payload


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Blocks of a gzip file of one or many members, each inflated once and none larger than BLOCK. A file that ends within
    a member, before its checksum, is an error."""
    stream, data, begun = zlib.decompressobj(31), read(BLOCK), False
    while data:
        out = stream.decompress(data, BLOCK)
        if out:
            yield out
        data, begun = stream.unconsumed_tail, True
        if stream.eof:
            data, begun = stream.unused_data, False
            stream = zlib.decompressobj(31)
        if not data:
            data = read(BLOCK)
    if tail := stream.flush():
        yield tail
    if begun and not stream.eof:
        raise ValueError("the archive is cut short")


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record at a time."""
    buffer = bytearray()
    need = None
    for block in blocks:
        buffer += block
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(bytes(buffer[:end]).partition(b"\r\n")[2])["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends within a record")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _commit(files: fs.FileSystem, written: str, final: str) -> None:
    """Give a finished file its name. A second attempt of a task takes the place of what the first has left; it holds the
    same records."""
    if files.get_file_info(final).type != fs.FileType.NotFound:
        files.delete_file(final)
    files.move(written, final)


def write_archives(records: DataFrame, folder: str, cfg: WarcConfig) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to) as archives of one gzip stream each; rows: archive, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        made, sink, press, held, n, name, temp = [], None, None, 0, 0, "", ""

        def close() -> None:
            nonlocal sink
            sink.write(press.flush())
            sink.close()
            _commit(files, f"{root}/{temp}", f"{root}/{name}")
            made.append((f"{folder}/{name}", n))
            sink = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if sink is None:
                    name, temp = f"part-{part:06d}-{len(made):04d}.warc.gz", f"_tmp-{uuid.uuid4().hex}"
                    sink, press, held, n = files.open_output_stream(f"{root}/{temp}"), zlib.compressobj(cfg.level, zlib.DEFLATED, 31), 0, 0
                sink.write(press.compress(make_record(page_id, url, payload, digest, refers_to)))
                held, n = held + len(payload), n + 1
                if held >= cfg.archive_bytes:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "n_records"])

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, n_records long")


def normalise_archive(archive: str, cfg: WarcConfig) -> tuple[str, str, int]:
    """Rewrite one archive with a member for each record, beside a sidecar index; gives both paths and the record count."""
    files, path = _open(archive)
    base = archive.removesuffix(".warc.gz")
    out, index = f"{path.removesuffix('.warc.gz')}.members.warc.gz", f"{path.removesuffix('.warc.gz')}.index.jsonl"
    temp = f"{path.rpartition('/')[0]}/_tmp-{uuid.uuid4().hex}"
    at = n = 0
    with files.open_input_stream(path, compression=None) as source, files.open_output_stream(f"{temp}.a", compression=None) as sink, files.open_output_stream(f"{temp}.b", compression=None) as side:
        for record in split_records(inflate(source.read)):
            press = zlib.compressobj(cfg.level, zlib.DEFLATED, 31)
            member = press.compress(record) + press.flush()
            sink.write(member)
            head = _headers(record[: record.find(b"\r\n\r\n")].partition(b"\r\n")[2])
            side.write((json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}) + "\n").encode())
            at, n = at + len(member), n + 1
    _commit(files, f"{temp}.a", out)
    _commit(files, f"{temp}.b", index)
    return f"{base}.members.warc.gz", f"{base}.index.jsonl", n


def normalise(archives: DataFrame, cfg: WarcConfig) -> DataFrame:
    """Normalise each archive of the column archive, one task per archive at most; rows: archive, index, n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [normalise_archive(x, cfg) for x in batch.column("archive").to_pylist()]
            columns = list(zip(*made, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["archive", "index", "n_records"])

    return archives.select("archive").mapInArrow(run, "archive string, index string, n_records long")


def read_index(index: str) -> list[dict]:
    files, path = _open(index)
    with files.open_input_stream(path, compression=None) as source:
        return [json.loads(line) for line in source.read().splitlines()]


def read_member(archive: str, offset: int, length: int) -> bytes:
    """One record, by its offset alone."""
    files, path = _open(archive)
    with files.open_input_file(path) as source:
        return zlib.decompress(source.read_at(length, offset), 31)


RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string"


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives (archive, index). payload_bytes and payload_digest are of the full payload: read
    back and digested for responses, from the headers for revisits. A response whose payload and digest differ is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                files, path = _open(archive)
                rows = []
                with files.open_input_file(path) as source:
                    for entry in read_index(index):
                        warc, http, payload = parse_record(zlib.decompress(source.read_at(entry["length"], entry["offset"]), 31))
                        digest = warc["warc-payload-digest"].partition(":")[2]
                        size = int(http["content-length"])
                        if warc["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
                            raise ValueError(f"{archive}: payload of {warc['warc-record-id']} doesn't match its digest")
                        rows.append((_page_of(warc["warc-record-id"]), warc["warc-type"], _page_of(warc.get("warc-refers-to")), size, digest, warc["warc-target-uri"]))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return archives.select("archive", "index").mapInArrow(run, RECORD)


def with_revisits(pages: DataFrame, cfg: WarcConfig) -> DataFrame:
    """page_id, url, payload, digest and refers_to: of equal payloads the one with the largest page_id is the response.

    Only digests and ids are grouped; the ids of the revisits are written as a table, whose size then decides whether it is
    broadcast to the payloads or these are dealt by page_id. A null html is an empty payload. Rows without a page_id are
    responses, as are all rows with the largest page_id of their payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = rows.filter(f"page_id is not null and octet_length(payload) >= {int(cfg.min_revisit)}").select("page_id", "digest")
    best = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("least < refers_to").drop("least")
    revisits = split_join(ids, best, ["digest"]).filter("page_id < refers_to").distinct()
    revisits = Workspace(pages.sparkSession, "warc-revisits").table(revisits, "revisits")
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def archive_pages(pages: DataFrame, folder: str | None = None, cfg: WarcConfig | None = None) -> DataFrame:
    """Archives of pages (page_id, url, html), normalised: one row per archive with archive, index and n_records.

    folder is a URI that all executors share; the default is a new one below spark.checkpoint.dir.
    """
    cfg = cfg or WarcConfig()
    spark: SparkSession = pages.sparkSession
    folder = folder or with_temp_dir(spark, "warc")
    ws = Workspace(spark, "warc-index")
    records = with_revisits(pages, cfg)

    def base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column("digest").to_pylist()], pa.string())
            yield batch.set_column(batch.schema.get_field_index("digest"), "digest", digest)

    raw = ws.table(write_archives(records.mapInArrow(base32, records.schema), folder, cfg), "raw")
    return ws.table(normalise(_each_alone(raw), cfg), "normalised")


def _each_alone(archives: DataFrame) -> DataFrame:
    """One row per archive, dealt by range into as many partitions as there are rows."""
    return archives.repartitionByRange(max(1, archives.count()), "archive")


def pages_round_trip(pages: DataFrame, cfg: WarcConfig | None = None) -> DataFrame:
    """Write pages as archives, normalise them and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for every row of pages, repeated rows included; an empty table gives none. Columns other than page_id, url
    and html are ignored.
    """
    made = archive_pages(pages, cfg=cfg)
    return read_archives(_each_alone(made)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
