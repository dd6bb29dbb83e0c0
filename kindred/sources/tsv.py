r"""Tab-separated text in which a backslash makes the next character literal.

There are no quotes: an escaped tab, newline or backslash is data, and so is any
other escaped character. Spark's CSV reader cannot express this, since its escape
works inside quotes only, so this is a data source of its own::

    spark.dataSource.register(EscapedTsv)
    spark.read.format("escaped_tsv").load("hdfs://…/opinions/")

A file is read in byte ranges by many tasks. Where a record ends can be told on
the spot: at a newline after an even number of backslashes. So each task finds its
first record by itself and no row is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "fields array<string>, file string, start bigint"
"""``file`` and ``start`` (byte offset) give the records' order."""

# One field up to a tab, and one escaped character.
FIELD = re.compile(rb"(?:[^\\\t]+|\\.)*", re.DOTALL)
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)

READ_BYTES = 1 << 20
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4_096


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def ends_record(line: bytes) -> bool:
    """Whether the newline after ``line`` ends the record, that is, is not escaped."""
    return (len(line) - len(line.rstrip(b"\\"))) % 2 == 0


def split_fields(record: bytes) -> list[str]:
    if b"\\" not in record:
        return record.decode("utf-8", "replace").split("\t")
    fields = []
    at = 0
    while True:
        match = FIELD.match(record, at)
        fields.append(ESCAPED.sub(rb"\1", match.group()).decode("utf-8", "replace"))
        at = match.end() + 1
        if at > len(record):
            return fields
        if record[match.end()] != 0x09:  # a lone backslash ends the file
            return fields


def read_lines(stream: pa.NativeFile) -> Iterator[bytes]:
    """Lines from the current position on, each with its newline if it has one."""
    pending = b""
    while chunk := stream.read(READ_BYTES):
        lines = (pending + chunk).split(b"\n")
        pending = lines.pop()
        for line in lines:
            yield line + b"\n"
    if pending:
        yield pending


def escaped_at(stream: pa.NativeFile, position: int) -> bool:
    """Whether the byte at ``position`` follows an odd number of backslashes.

    Any other byte leaves the escaped state, so only that run has to be read.
    """
    length = 0
    at = position
    while at > 0:
        step = min(at, 1_024)
        stream.seek(at - step)
        before = stream.read(step)
        run = len(before) - len(before.rstrip(b"\\"))
        length += run
        if run < step:
            break
        at -= step
    return length % 2 == 1


def read_records(stream: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Records that begin in ``[start, end)`` with their offset, without the newline.

    From one byte before the range everything up to a record's end belongs to the
    previous range. A record that begins in the range is read beyond its end.
    """
    skip = start > 0
    at = max(start - 1, 0)
    carry = b"\\" if escaped_at(stream, at) else b""
    stream.seek(at)
    begin, record = at, b""
    for line in read_lines(stream):
        complete = line.endswith(b"\n") and ends_record(carry + line[:-1])
        carry = b""
        at += len(line)
        if skip:
            skip, begin = not complete, at
            continue
        if begin >= end:
            return
        record += line
        if complete:
            yield begin, record[:-1]
            begin, record = at, b""
    if record and begin < end:
        yield begin, record


class EscapedTsv(DataSource):
    """Options: ``path`` (a file or folder) or ``paths`` (a JSON list), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "escaped_tsv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EscapedTsvReader(self.options)


class EscapedTsvReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options.get("paths", "null")) or [options["path"]]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        found = [part for path in self.paths for part in byte_ranges(path, self.split_bytes)]
        return found or [ByteRange("", 0, 0)]  # Spark wants at least one

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = file_system(self.paths[0])
        rows: list[tuple[list[str], int]] = []
        with system.open_input_file(partition.path) as stream:
            for begin, record in read_records(stream, partition.start, partition.end):
                rows.append((split_fields(record), begin))
                if len(rows) == BATCH_ROWS:
                    yield to_batch(rows, partition.path)
                    rows = []
        if rows:
            yield to_batch(rows, partition.path)


def byte_ranges(path: str, split_bytes: int) -> list[ByteRange]:
    system, root = file_system(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.Directory:
        files = system.get_file_info(fs.FileSelector(root, recursive=True))
    elif found.is_file:
        files = [found]
    else:
        raise FileNotFoundError(path)
    return [
        ByteRange(file.path, start, min(start + split_bytes, file.size))
        for file in sorted(files, key=lambda f: f.path)
        if file.is_file and not file.base_name.startswith(("_", "."))
        for start in range(0, file.size, split_bytes)
    ]


def to_batch(rows: list[tuple[list[str], int]], path: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([fields for fields, _ in rows], pa.list_(pa.string())),
            pa.array([path] * len(rows), pa.string()),
            pa.array([begin for _, begin in rows], pa.int64()),
        ],
        names=["fields", "file", "start"],
    )


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_escaped_tsv(
    spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Records as ``fields array<string>`` with the file and offset they come from."""
    spark.dataSource.register(EscapedTsv)
    paths = [path] if isinstance(path, str) else path
    reader = spark.read.format("escaped_tsv").option("splitBytes", split_bytes)
    return reader.option("paths", json.dumps(paths)).load()


def encode_record(fields: list[Column]) -> Column:
    """The inverse of the reader: one line of escaped, tab-separated fields."""
    return F.concat_ws(
        "\t", *[F.regexp_replace(field, r"([\\\t\n])", r"\\$1") for field in fields]
    )


def write_escaped_tsv(df: DataFrame, path: str) -> None:
    """Write the columns of ``df``, all strings, one record per row."""
    line = encode_record([F.coalesce(F.col(c), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)
