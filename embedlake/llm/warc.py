"""Operator 3: WARC archives, written with revisit records and read by byte ranges.

Writing: equal payloads are found by their SHA-1 digest; the row with the smallest id gives the response
record, the others are revisits of it. Each task writes one archive of gzip members, a record each, under a
name of its own that a repeated task overwrites. Digests are grouped before anything moves; a hot payload is
one row of the group table.

Reading: archives are cut into byte ranges. A task looks for the gzip magic from its range's start, takes a
candidate for a member only if it decodes to a WARC header, and owns the records that start inside its range,
the last of which may end beyond it. After an accepted member the next one is where it ends.

Cases: null payloads are empty; null ids are written without one and are always responses; rows that repeat
the smallest id with its payload are responses each; an id that comes with several payloads has a record for
each, which refers to the first of its own payload; an empty table gives no archives and no records; other
columns are not read. Control characters in URLs are escaped. A member cut short by the end of its file, or
one that fails its checksum, is skipped and the search goes on behind its magic.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.llm._work import Workspace

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
LEVEL = 4
#: Tasks that read archives at most; beyond it a task reads several ranges, one after the other.
MAX_TASKS = 100_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. Revisits keep the HTTP header, and so the payload's length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    urn: str = "urn:x-page", date: str = "2020-01-01T00:00:00Z",
) -> list[str]:
    """Write all rows to archives in ``folder`` (a URI that all executors reach); returns the archives' names.

    Payloads of fewer than ``min_bytes`` bytes are always responses.
    """
    ws = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8") if pages.schema[payload_col].dataType.simpleString() == "string" else F.col(payload_col), F.lit(b""))
    narrow = pages.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("digest"), F.length(payload).alias("size")).where(F.col("size") >= min_bytes)
    first = ws.save(narrow.groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "first")
    refs = ws.save(narrow.join(first, "digest").where("_id > first").select("_id", "digest", F.col("first").alias("_refers_to")).distinct(), "refs")
    rows = pages.select(F.col(id_col).alias("_id"), F.sha1(payload).alias("digest"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload")).join(refs, ["_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.warc.gz"
        work, out, n, size = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}", None, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                own, url, body, refers = (batch.column(c)[k].as_py() for c in range(4))
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(work, compression=None)
                rid = f"{urn}:{'' if own is None else own}"
                url = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else rid
                member = record(rid, url, body, None if refers is None else f"{urn}:{refers}", date)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            files.move(work, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["name", "records", "bytes"])

    made = rows.select("_id", "_url", "_payload", "_refers_to").mapInArrow(run, "name string, records bigint, bytes bigint").collect()  # a row a task
    ws.drop("first", "refs")
    return sorted(r["name"] for r in made)


class _Range:
    """Bytes of a file from a position on, read in chunks."""

    def __init__(self, file, at: int):
        self.file, self.base, self.buffer = file, at, b""
        file.seek(at)

    def upto(self, at: int) -> bool:
        """Have bytes up to ``at``; False at the file's end."""
        while self.base + len(self.buffer) < at:
            more = self.file.read(CHUNK)
            if not more:
                return False
            self.buffer += more
        return True

    def drop(self, at: int) -> None:
        self.buffer, self.base = self.buffer[at - self.base :], at


def _member(view: _Range, at: int) -> tuple[bytes, int] | None:
    """Content and end of the member at ``at``, if it decodes to a whole WARC record."""
    unpack, parts, pos, checked, held = zlib.decompressobj(31), [], at, False, 0
    while not unpack.eof:
        if not view.upto(pos + 1):
            return None
        chunk = view.buffer[pos - view.base : pos - view.base + CHUNK]
        pos += len(chunk)
        try:
            got = unpack.decompress(chunk)
        except zlib.error:
            return None
        parts.append(got)
        held += len(got)
        if not checked and (held >= 7 or unpack.eof):
            if not b"".join(parts)[:7] == b"WARC/1.":
                return None
            checked = True
    return b"".join(parts), pos - len(unpack.unused_data)


def parse(content: bytes) -> dict | None:
    """Header fields (lower case), payload and payload length of a record; None if the header isn't whole."""
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {}
    for line in content[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    block = content[end + 4 : end + 4 + int(head.get("content-length", 0))]
    payload, length = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(found[1]) if found else len(payload)
    return {"head": head, "payload": None if head.get("warc-type") == "revisit" else payload, "length": length}


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in [start, end)."""
    view, at = _Range(file, start), start
    while at < end:
        view.drop(at)
        view.upto(at + CHUNK)
        found = view.buffer.find(MAGIC)
        if found < 0:
            if not view.upto(at + len(view.buffer) + 1) and len(view.buffer) < CHUNK:
                return
            at += max(1, len(view.buffer) - 2)
            continue
        at += found
        if at >= end:
            return
        view.drop(at)
        got = _member(view, at)
        own = parse(got[0]) if got else None
        if own is None:
            at += 1
            continue
        yield at, own
        at = got[1]


SCHEMA = "path string, offset bigint, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, digest_ok boolean"


def read_archives(spark: SparkSession, folder: str, split_bytes: int = 8 << 20, payload: bool = True) -> DataFrame:
    """A row per record of the ``*.warc.gz`` archives in ``folder``. ``digest_ok``: the payload has the digest (null for revisits)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []  # a row an archive; ranges are made by tasks
    if files.exists(path):
        for s in files.listStatus(path):
            name, size = s.getPath().getName(), s.getLen()
            if name.endswith(".warc.gz") and not name.startswith(".") and size:
                found.append((f"{folder.rstrip('/')}/{name}", size))
    tasks = min(MAX_TASKS, max(1, sum(-(-size // split_bytes) for _, size in found)))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    archives = spark.createDataFrame(found, "path string, size long").select("path", "size", start)
    ranges = archives.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("stop")).repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, name = _filesystem(path)
                rows, held = [], 0
                with files.open_input_file(name) as f:
                    for at, own in records_in(f, start, stop):
                        head, body = own["head"], own["payload"]
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        strip = lambda x: x.strip("<>") if x else None
                        rows.append((path, at, strip(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), digest, own["length"], strip(head.get("warc-refers-to")), None if body is None else base32_sha1(body) == digest, body))
                        held += len(body or b"") if payload else 200
                        if held > 4 << 20:
                            yield _batch(rows, payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, payload)

    return ranges.mapInArrow(run, SCHEMA + ", payload binary" * payload)


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["payload"]
    n = 10 if payload else 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:n], kinds[:n], strict=True)], names[:n])
