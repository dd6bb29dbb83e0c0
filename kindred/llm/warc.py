"""WARC archives: a writer with revisit records and a reader that splits gzip members.

An archive is a row of gzip members, one record each. A reading task gets a range of
bytes, looks for the gzip magic in it, and takes an offset for a record when what is there
inflates to a WARC version line; it owns the records that begin in its range and reads the
last one to its end, wherever that is. Inside a chain of members the next one is known,
so only the first of a range is searched for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import numbered
from kindred.staging import shared_dir, stage

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT = 8 << 20
TASK_RANGES = 8
CHUNK = 1 << 16
URN = "urn:page:"


# --- writing ---------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive ``pages (page_id, url, html)``; returns a table of ``path, bytes, records``.

    Of rows with equal payloads (UTF-8 of ``html``; null is empty) the one with the
    largest ``page_id`` (null is smallest; of equal rows, one of them) becomes a
    response, the others revisit it. Each task writes one file, under a name of its own
    attempt; only files of the table count, so lost or repeated tasks leave no records.
    ``folder`` must be one that Arrow's file systems reach (file, hdfs, s3, gs, …).
    """
    # rows are numbered on each of two reads; that the numbers agree is checked by digest
    rows = numbered(pages.select("page_id", "url", "html"), "row").select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
        "row",
    )
    known = stage(
        rows.select("page_id", "row", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")),
        "digests",
    )
    best = (
        known.groupBy("digest", "size")
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("first"))
        .where("n > 1")
        .select("digest", "size", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    revisits = stage(
        known.join(best, ["digest", "size"]).where("row <> first_row").select("row", "digest", "first_id", "first_row"),
        "revisits",
    )
    written = (
        rows.join(revisits, "row", "left")
        .select("page_id", "url", "payload", "row", "digest", "first_id", "first_row")
        .mapInArrow(
            partial(_write, folder=qualified(pages.sparkSession, folder), date=date),
            "path string, bytes bigint, records bigint",
        )
    )
    return stage(written, "archives")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the cluster's default file system has it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def _write(batches, folder: str, date: str) -> Iterator[pa.RecordBatch]:
    out, path, n, size = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
    for batch in batches:
        for page_id, url, payload, row, digest, first_id, first_row in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None:
                system, name = open_path(path)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(name, compression=None)
            if digest and hashlib.sha1(payload).hexdigest() != digest:
                raise RuntimeError("the pages changed between two reads")
            refers = None if first_row is None else record_id(first_id, first_row)
            member = _gzip(record(record_id(page_id, row), url, payload, date, refers))
            out.write(member)
            n, size = n + 1, size + len(member)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})


def record_id(page_id: int | None, row: int) -> str:
    return f"<{URN}{'' if page_id is None else page_id}:{row}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str, payload: bytes, date: str, refers: str | None) -> bytes:
    """A response, or a revisit that keeps the HTTP headers and leaves out the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if refers:
        headers += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    made = zlib.compressobj(6, wbits=31)
    return made.compress(data) + made.flush()


# --- reading ---------------------------------------------------------------------------

SCHEMA = (
    "path string, offset bigint, record_type string, record_id string, url string, date string, "
    "payload_digest string, refers_to string, payload_bytes bigint, payload binary"
)


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of ``files (path, bytes)``, one row each, read in ranges of ``split`` bytes.

    ``payload_bytes`` is the length of the full payload (of a revisit, as its HTTP headers
    tell), ``payload`` null for revisits. A response whose payload does not match its
    digest, or a member that breaks off, fails the read rather than losing a record.
    """
    return ranges(files, split).mapInArrow(partial(_read, split=split), SCHEMA)


def ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """``path, bytes, start`` of the ranges of ``files``, dealt out to as many tasks as their number asks for.

    Rows this small would be put together by their size, so the number of tasks is given: one for
    each ``TASK_RANGES``, and two for each core if there are ranges enough.
    """
    each = files.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split).cast("bigint"))).alias("start")
    )
    n = each.count()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return each.repartition(max(1, -(-n // TASK_RANGES), min(n, 2 * cores)), F.xxhash64("path", "start"))


def _read(batches, split: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    for batch in batches:
        for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
            system, name = open_path(path)
            rows: list[dict] = []
            held = 0
            with system.open_input_file(name) as file:
                for offset, data in members(file, size, start, min(start + split, size)):
                    rows.append({"path": path, "offset": offset, **parse(data)})
                    held += len(data)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the WARC records that begin in ``start`` to ``end``."""
    at, chained = start, start == 0
    while at < end:
        if not chained:
            at = _next_magic(file, at, end)
            if at < 0:
                return
        found = inflate(file, size, at, strict=chained)
        if found is None:
            at, chained = at + 1, False
            continue
        data, after = found
        yield at, data
        at, chained = after, True


def _next_magic(file, at: int, end: int) -> int:
    while at < end:
        file.seek(at)
        data = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        if (i := data.find(MAGIC)) >= 0 and at + i < end:
            return at + i
        at += CHUNK
    return -1


def inflate(file, size: int, at: int, strict: bool) -> tuple[bytes, int] | None:
    """The member at ``at`` and where it ends; None if no WARC record begins there."""
    file.seek(at)
    engine, parts, n, sure = zlib.decompressobj(wbits=31), [], at, strict
    try:
        while not engine.eof:
            chunk = file.read(CHUNK)
            if not chunk:
                raise zlib.error("the member breaks off")
            n += len(chunk)
            parts.append(engine.decompress(chunk))
            if not sure:
                head = b"".join(parts)[: len(b"WARC/")]
                if not b"WARC/".startswith(head):
                    return None
                sure = len(head) == len(b"WARC/")
    except zlib.error as error:
        if strict:
            raise ValueError(f"no record at byte {at}: {error}") from error
        return None
    data = b"".join(parts)
    if not data.startswith(b"WARC/"):
        if strict:
            raise ValueError(f"no WARC record at byte {at}")
        return None
    return data, n - len(engine.unused_data)


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(data: bytes) -> dict:
    """The fields of ``SCHEMA`` of one record."""
    fields, rest = _headers(data)
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError(f"record {fields.get('warc-record-id')} breaks off")
    http, payload = _headers(rest[:length])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = fields.get("warc-type")
    if kind == "response" and digest and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "payload_digest": digest,
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": int(http.get("content-length", len(payload))) if kind == "revisit" else len(payload),
        "payload": None if kind == "revisit" else payload,
    }


def page_of(name: str):
    """The page's id in a record id, as a column; null where it was null."""
    return F.nullif(F.regexp_extract(name, f"{URN}(-?[0-9]*):", 1), F.lit("")).cast("bigint")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
