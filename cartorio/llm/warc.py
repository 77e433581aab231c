"""WARC archives of pages: a deterministic sharded writer, and a reader that checks digests.

Pages are range-partitioned and sorted by id; a task writes its records in that order, one gzip member each,
and begins a new file when the compressed size reaches a limit. Names come from the partition and the file's
number in it, headers from the page alone, so a task that is run again writes the same bytes. A file is written
under a temporary name and moved when it is whole; the archive is what the manifest lists, and the manifest is
written last.

Of records with equal payloads the one with the largest id is the response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.llm.shared import small_batches

#: Fixed words of the format (WARC 1.1).
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

ROLL_BYTES = 32 << 20
MANIFEST = "first_id long, last_id long, records long, bytes long, sha256 string, path string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, path string"

MANIFEST_ARROW = pa.schema([("first_id", pa.int64()), ("last_id", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("path", pa.string())])
RECORD_ARROW = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("path", pa.string())]
)


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, as the format has it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, name, refers_to) of every page and payload; ``name`` is the SHA-1 in hex, refers_to is null for a response.

    Payloads under ``least_bytes`` are always responses, and so are all rows that share the largest id of their
    payload. A payload that many pages have is one partial aggregate, and a join whose large partitions may be
    split.
    """
    html = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", F.sha1(html).alias("name"), F.octet_length(html).alias("size")).distinct()
    last = named.filter(F.col("size") >= least_bytes).groupBy("name").agg(F.max("page_id").alias("last"))
    refers = F.when(F.col("last") != F.col("page_id"), F.col("last"))
    return named.join(last, "name", "left").select("page_id", "name", refers.alias("refers_to"))


def _record(page_id: int, url: str | None, payload: bytes, name: str, refers_to: int | None, date: str, copy: int) -> bytes:
    """One record. A revisit keeps the HTTP head only; length and digest of the full payload stand in its header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {name} {target} {copy}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Page-ID", str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


class _Roller:
    """Files of one task: opened under a temporary name, moved when whole."""

    def __init__(self, folder: str, limit: int):
        self.store, self.folder = filesystem(folder)
        self.limit, self.number, self.out = limit, 0, None
        context = TaskContext.get()
        self.part, self.attempt = context.partitionId(), context.taskAttemptId()
        self.store.create_dir(self.folder, recursive=True)

    def add(self, page_id: int, record: bytes) -> list[dict]:
        if self.out is None:
            self.name = f"{self.folder}/pages-{self.part:06d}-{self.number:05d}.warc.gz"
            self.out, self.hash = self.store.open_output_stream(f"{self.name}.{self.attempt}.tmp", compression=None), hashlib.sha256()
            self.entry = {"first_id": page_id, "records": 0, "bytes": 0, "path": self.name}
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.hash.update(member)
        self.entry |= {"last_id": page_id, "records": self.entry["records"] + 1, "bytes": self.entry["bytes"] + len(member)}
        return self.close() if self.entry["bytes"] >= self.limit else []

    def close(self) -> list[dict]:
        if self.out is None:
            return []
        self.out.close()
        self.store.move(f"{self.name}.{self.attempt}.tmp", self.name)
        self.out, self.number = None, self.number + 1
        return [self.entry | {"sha256": self.hash.hexdigest()}]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the records of ``pages`` (page_id, url, html) below ``folder`` and returns the manifest.

    Null html: an empty payload. Null or empty url: ``urn:page:<id>``. Null page_id sorts first. Repeated rows are
    repeated records; ties of page_id go by digest and url. Other columns are ignored. An empty table gives an
    empty manifest. A task that is run again moves the same files to the same names; unfinished
    files of lost tasks are removed once the manifest is there. ``folder`` is a
    URI, or a path, that all workers reach.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("name"))
    plan = plan_records(pages, least_bytes)
    # A page's plan comes just before its record in the same order, so one exchange does for both.
    plan = plan.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "name", "refers_to", F.lit(0).alias("kind"))
    rows = records.withColumns({"refers_to": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(plan)
    rows = rows.repartitionByRange(parts, "page_id", "name").sortWithinPartitions("page_id", "name", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, before, copy, refers_to = _Roller(f"{folder}/data", roll_bytes), None, 0, None
        for batch in small_batches(batches, "html"):
            done = []
            for page_id, url, html, name, refers, kind in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "name", "refers_to", "kind"))):
                if kind == 0:
                    refers_to = refers
                    continue
                copy = copy + 1 if (page_id, url, name) == before else 0
                before = (page_id, url, name)
                code = base64.b32encode(bytes.fromhex(name)).decode()
                done += roller.add(page_id, _record(page_id, url, (html or "").encode(), code, refers_to, date, copy))
            if done:
                yield pa.RecordBatch.from_pylist(done, MANIFEST_ARROW)
        done = roller.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, MANIFEST_ARROW)

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    store, inner = filesystem(f"{folder}/data")
    if store.get_file_info(inner).type == fs.FileType.Directory:
        for item in store.get_file_info(fs.FileSelector(inner)):
            if item.path.endswith(".tmp"):
                store.delete_file(item.path)
    return manifest


def _members(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Records of one archive, a gzip member each; one record is in memory at a time."""
    with store.open_input_stream(path, compression=None) as stream:
        data, packer, parts = stream.read(1 << 20), zlib.decompressobj(31), []
        while data:
            parts.append(packer.decompress(data))
            if packer.eof:
                yield b"".join(parts)
                data, packer, parts = packer.unused_data, zlib.decompressobj(31), []
            else:
                data = b""
            data = data or stream.read(1 << 20)


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    full = fields["WARC-Type"] == "response"
    intact = lines[0] == VERSION and fields["WARC-Block-Digest"] == f"sha1:{digest(block)}" and rest[len(block) :] == b"\r\n\r\n"
    if full:
        intact = intact and fields["WARC-Payload-Digest"] == f"sha1:{digest(payload)}" and fields["WARC-Payload-Length"] == str(len(payload))
    page, refers = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page")
    return {
        "page_id": None if page == "None" else int(page),
        "payload_bytes": len(payload) if full else int(fields["WARC-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "intact": intact,
    }


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files in ``manifest``: page_id, payload_bytes, payload_digest, record_type, refers_to, intact, path.

    Sizes and digests of responses are those of the payload read; a revisit names its own. ``intact`` is false
    where a digest, a length or the end mark is wrong. Files are read in tasks of their own; an empty manifest gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for record in _members(store, path):
                    rows.append(_parsed(record) | {"path": path})
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    # A file for each task: paths are few bytes, and would be put together otherwise.
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORD)
