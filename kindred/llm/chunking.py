"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text and cuts where some of its bits are zero, so the
cuts hang on the last 16 bytes only and come back in step after an insertion. A chunk is
known by a 64-bit digest; all but its first occurrence (in order of document and place)
are repeats. Neighbouring repeats form a run as long as their first occurrences follow
each other too; a run is compared with the bytes around these, so that it grows to the
whole of what is repeated from that one place, and goes if that has enough whole words.
Where one run follows another, the two chunks at the seam may have come together before:
the first place where they did is compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import numbered
from kindred.staging import stage

LEAST, MOST = 16, 256  # bytes of a chunk
ZERO_BITS = 0b11111 << 11  # one cut in 32 bytes, before LEAST: chunks of about 48
MIN_WORDS = 40
"""Whole words that a repeated passage has at least."""
CONTEXT, WIDEST = 512, 4096
"""Bytes that a run may grow by at either end, and where these have no more than
``min_words`` words, of which a run needs no more; a passage has its first cut long before."""
GEAR = np.random.default_rng(42).integers(0, 1 << 16, 256, dtype=np.uint16)
WINDOW = 16


def cuts(data: bytes) -> list[int]:
    """Where the chunks of a text end; only before the first byte of a character."""
    size = len(data)
    raw = np.frombuffer(data, dtype=np.uint8)
    found: list[np.ndarray] = []
    for at in range(0, size, 1 << 20):
        begin = max(0, at - WINDOW)
        part = GEAR[raw[begin : at + (1 << 20)]]
        for step in (1, 2, 4, 8):  # sums over the last 2, 4, 8 and 16 bytes
            shifted = part.copy()
            shifted[step:] += part[:-step] << np.uint16(step)
            part = shifted
        here = np.flatnonzero((part & np.uint16(ZERO_BITS)) == 0) + begin + 1
        found.append(here[(here > at) & (here < size)])
    marks = np.concatenate(found) if found else np.zeros(0, np.int64)
    marks = marks[(raw[marks] & 0xC0) != 0x80]
    out, last = [], 0
    for mark in [*marks.tolist(), size]:
        while mark - last > MOST:
            last += MOST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if mark - last >= LEAST or mark == size:
            last = mark
            out.append(last)
    return out if size else []


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, _row, start, length, digest``: chunks of ``docs (doc_id, _row, text)``."""
    return docs.select("doc_id", "_row", "text").mapInArrow(
        _chunks, "doc_id bigint, _row bigint, start int, length int, digest bigint"
    )


def digest(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, len(whole), 512):
            batch = whole.slice(i, 512)
            starts, lengths, digests, times = [], [], [], []
            for text in batch.column(2):
                data = text.as_py()
                data = data.encode() if data else b""
                ends = cuts(data)
                begins = [0, *ends[:-1]] if ends else []
                starts += begins
                lengths += [b - a for a, b in zip(begins, ends)]
                digests += [digest(data[a:b]) for a, b in zip(begins, ends)]
                times.append(len(ends))
            rows = pa.array(np.repeat(np.arange(len(batch)), times))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).take(rows) for k in range(2)),
                    pa.array(starts, pa.int32()),
                    pa.array(lengths, pa.int32()),
                    pa.array(digests, pa.int64()),
                ],
                ["doc_id", "_row", "start", "length", "digest"],
            )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_row, ends``: per document the runs of repeated chunks, and what is around the first.

    ``docs`` as for ``chunks``. A run has two ends, ``(start, end, source, shift, after,
    first_id, length, digest, bytes)``, by start: its place in bytes, the row and how many
    bytes further on the first occurrence is, the length and digest of its first chunk,
    and the bytes before (then after) the first occurrence, which is the one with the
    smallest ``(doc_id, _row, start)``, null before all. All of a run is from one stretch
    of its source. The runs of seams are empty. A chunk in any share of all documents is
    counted by partial sums and joined as one row; no group of occurrences is collected.
    """
    parts = stage(chunks(docs), "chunks")
    known = (
        parts.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_row", "start")).alias("first"))
        .where("n > 1")
        .select("digest", F.col("first.doc_id").alias("first_id"), F.col("first._row").alias("source"), F.col("first.start").alias("_s"))
    )
    repeats = parts.join(known, "digest").where("_row <> source OR start <> _s").withColumn("shift", F.col("_s") - F.col("start"))
    by = Window.partitionBy("_row").orderBy("start")
    meets = F.lag(F.col("start") + F.col("length")).over(by) == F.col("start")
    follows = meets & (F.lag("source").over(by) == F.col("source")) & (F.lag("shift").over(by) == F.col("shift"))
    runs = stage(
        repeats.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int"))
        .withColumn("previous", F.when(meets, F.lag("digest").over(by)))
        .withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_row", "_run")
        .agg(
            F.min(F.struct("start", "length", "digest", "doc_id", "first_id", "source", "shift", "previous")).alias("head"),
            F.max(F.col("start") + F.col("length")).alias("end"),
        )
        .select("_row", "head.*", "end"),
        "runs",
    )
    met = runs.where("previous IS NOT NULL")
    seams = (
        met.groupBy("previous", "digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_row", "start")).alias("first"))
        .where("n > 1")
        .select("previous", "digest", "first")
    )
    again = (
        met.drop("first_id", "source", "shift", "end")
        .join(seams, ["previous", "digest"])
        .where("_row <> first._row OR start <> first.start")
        .select(
            "*",
            F.col("start").alias("end"),
            F.col("first.doc_id").alias("first_id"),
            F.col("first._row").alias("source"),
            (F.col("first.start") - F.col("start")).alias("shift"),
        )
    )
    columns = ["_row", "start", "end", "source", "shift", "first_id", "length", "digest"]
    each_end = (
        runs.select(*columns)
        .unionByName(again.select(*columns))
        .withColumn("after", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("at", F.when(F.col("after"), F.col("end")).otherwise(F.col("start")) + F.col("shift"))
    )
    end = F.struct("start", "end", "source", "shift", "after", "first_id", "length", "digest", "bytes")
    return (
        each_end.join(_contexts(docs, each_end, min_words), ["source", "at", "after"])
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(end)).alias("ends"))
    )


def _contexts(docs: DataFrame, ends: DataFrame, min_words: int) -> DataFrame:
    """``source, at, after, bytes``: the bytes before or after each first occurrence, once."""
    wanted = (
        ends.select(F.col("source").alias("_row"), "at", "after")
        .distinct()
        .groupBy("_row")
        .agg(F.collect_list(F.struct("at", "after")).alias("wanted"))
    )
    # with all columns, so that this and the last join of the documents share one exchange
    rows = docs.join(wanted, "_row").select(*docs.columns, "wanted")
    return rows.mapInArrow(
        partial(_around, row=docs.columns.index("_row"), text=docs.columns.index("text"), min_words=min_words),
        "source bigint, at int, after boolean, bytes binary",
    )


def around(data: bytes, at: int, after: bool, min_words: int) -> bytes:
    size = CONTEXT
    while True:
        found = data[at : at + size] if after else data[max(0, at - size) : at]
        if len(found) < size or size >= WIDEST or len(found.split()) > min_words + 1:
            return found
        size *= 2


def _around(batches, row: int, text: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, len(whole), 512):
            batch = whole.slice(i, 512)
            out = []
            columns = (batch.column(k).to_pylist() for k in (row, text, batch.num_columns - 1))
            for number, content, wanted in zip(*columns):
                data = (content or "").encode()
                for x in wanted:
                    at, after = x["at"], x["after"]
                    out.append((number, at, after, around(data, at, after, min_words)))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["source", "at", "after", "bytes"]
            )


REMOVED = T.ArrayType(
    T.StructType()
    .add("start", T.IntegerType())
    .add("length", T.IntegerType())
    .add("words", T.IntegerType())
    .add("first_id", T.LongType())
)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs (doc_id, text, …)`` without repeated passages, and ``removed``, their spans.

    Spans are in bytes of the old text, of whole words. A span is one passage of at least
    ``min_words`` words that one document has before, or several such passages that touch;
    ``first_id`` is a document that has the first of them before. Null texts stay null. A repeated row
    is a repeat like any other. A column ``removed`` is replaced.
    """
    docs = docs.drop("removed")
    # rows are numbered on each of two reads; that the numbers agree is checked by digest
    keyed = numbered(docs, "_row")
    spans = repeated_runs(keyed, min_words)
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", REMOVED)])
    return (
        keyed.join(spans, "_row", "left")
        .select(*docs.columns, "ends")
        .mapInArrow(partial(_cut, column=docs.columns.index("text"), min_words=min_words), schema)
    )


def _cut(batches, column: int, min_words: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("length", pa.int32()), ("words", pa.int32()), ("first_id", pa.int64())])
    )
    for whole in batches:
        for i in range(0, len(whole), 1024):
            batch = whole.slice(i, 1024)
            texts, removed = [], []
            for text, ends in zip(batch.column(column).to_pylist(), batch.column(-1 % batch.num_columns).to_pylist()):
                text, gone = cut(text, ends or [], min_words)
                texts.append(text)
                removed.append(gone)
            columns = list(batch.columns[:-1])
            columns[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind)], [*batch.schema.names[:-1], "removed"])


SPACES = b" \t\n\x0b\x0c\r"


def grown(data: bytes, span: dict, before: bytes, after: bytes) -> tuple[int, int]:
    """Where the repeated passage of a run begins and ends."""
    a, b = span["start"], span["end"]
    if digest(data[a : a + span["length"]]) != span["digest"]:
        raise RuntimeError("the documents changed between two reads")
    n = min(a, len(before))
    mine, theirs = (np.frombuffer(x[len(x) - n :], np.uint8) for x in (data[:a], before))
    differ = np.flatnonzero(mine != theirs)
    begin = a - n + (int(differ[-1]) + 1 if len(differ) else 0)
    n = min(len(data) - b, len(after))
    differ = np.flatnonzero(np.frombuffer(data[b : b + n], np.uint8) != np.frombuffer(after[:n], np.uint8))
    return begin, b + (int(differ[0]) if len(differ) else n)


def cut(text: str | None, ends: list[dict], min_words: int) -> tuple[str | None, list[dict]]:
    """The text without the whole words of its repeated passages, and which these are."""
    if text is None or not ends:
        return text, []
    data = text.encode()
    passages: dict[tuple[int, int], list[list]] = {}  # by where they are from
    for span, other in zip(ends[::2], ends[1::2]):
        a, b = grown(data, span, span["bytes"], other["bytes"])
        same = passages.setdefault((span["source"], span["shift"]), [])
        if same and a <= same[-1][1]:
            same[-1][1] = max(b, same[-1][1])
        else:
            same.append([a, b, span["first_id"]])
    spans: list[list] = []
    for a, b, first_id in sorted((x for same in passages.values() for x in same), key=lambda x: x[:2]):
        while 0 < a < b and data[a - 1] not in SPACES:
            a += 1
        while a < b < len(data) and data[b] not in SPACES and data[b - 1] not in SPACES:
            b -= 1
        if len(data[a:b].split()) < min_words:
            continue
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b, first_id])
    kept, gone, last = [], [], 0
    for a, b, first_id in spans:
        kept.append(data[last:a])
        gone.append({"start": a, "length": b - a, "words": len(data[a:b].split()), "first_id": first_id})
        last = b
    return b"".join([*kept, data[last:]]).decode(), gone
