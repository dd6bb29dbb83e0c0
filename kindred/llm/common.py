"""What several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.staging import stage

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what counts as a word
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, divisor: int) -> Column:
    """CRC-32 of an id as text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def row_key(id_column: str, *content: str) -> list[Column]:
    """``_k1, _k2``: two longs that tell rows apart on every scan, whatever the partitions.

    Rows equal in id and content share a key: they are one item to the operators.
    Neither is null.
    """
    return [
        F.xxhash64(id_column).alias("_k1"),
        F.xxhash64(F.lit(7), F.col(id_column), *content).alias("_k2"),
    ]


def word_blocks(data: bytes, overlap: int, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in lists; each but the first repeats the last ``overlap`` words.

    A list covers about ``size`` bytes, so a text of any length takes bounded memory.
    ``bytes.split`` cuts at exactly the white space of ``WORD``.
    """
    if len(data) <= size:
        yield data.split()
        return
    tail: list[bytes] = []
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = tail + data[start:end].split()
        yield words
        tail = words[-overlap:] if overlap else []
        start = end


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a number in ``column`` that is the same on every read.

    The rows of files are numbered where they lie, whichever columns are read. What has
    been shuffled could come in another order, so anything but a scan is written first.
    """
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.search(r"[A-Za-z]+", line)[0] for line in plan.splitlines() if line.strip()}
    if not nodes <= {"Project", "Filter", "Relation"}:
        rows = stage(rows, "numbered")
    return rows.withColumn(column, F.monotonically_increasing_id())
