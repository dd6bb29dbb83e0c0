"""Continuous import."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import imports
from kindred.plans.importing import import_files, import_opinions
from kindred.schema import KEY
from kindred.sources.store import Load, Store
from kindred.staging import write_once


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


def _trigger(every: str | None) -> dict[str, str | bool]:
    return {"processingTime": every} if every else {"availableNow": True}


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name kept in the checkpoint: a stream that lost it is another stream."""
    path = f"{checkpoint.rstrip('/')}/stream-id"
    return write_once(spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1), path).first()["id"]


def _load_of(store: Store, stream: str, batch_id: int, now_ms: int | None) -> Load:
    """The batch's load, with the time of its first attempt."""
    path = f"{store.root}/load_times/{stream}.{batch_id}"
    now = _now_ms() if now_ms is None else now_ms
    first = write_once(store.spark.range(1).select(F.lit(now).cast("bigint").alias("ms")), path).first()
    return Load(first["ms"], batch_id, f"{stream}.{batch_id}")


def import_stream(
    opinions: DataFrame,
    store: Store,
    namespace: str,
    patterns: list[str],
    checkpoint: str,
    now_ms: int | None = None,
    order: Column | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Import a stream of opinions, batch by batch.

    Ends when the input there is has been used up, or goes on with a batch ``every``
    interval. A batch is one load at ``now_ms``, by default the time of its first attempt, so
    batches and other imports are ordered by one clock. Its name is that of the stream, which
    its checkpoint keeps, and its number: other streams and imports leave it alone. A
    batch that is run again is left out if it is stored, else it replaces what there is
    of it, so nothing counts twice. ``Store.counters`` has the counters of each batch.
    """
    stream = _stream_id(store.spark, checkpoint)

    def load(batch: DataFrame, batch_id: int) -> None:
        name = _load_of(store, stream, batch_id, now_ms)
        if not store.finished("collections", name):
            import_opinions(
                batch, store, namespace, patterns, name, order=order, size="running", replace=True
            )

    return (
        opinions.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def running_sizes(opinions: DataFrame, namespace: str, patterns: list[str]) -> DataFrame:
    """Documents per collection so far; for output mode ``update`` or ``complete``."""
    documents = imports.fan_out(imports.with_text(opinions), namespace, patterns)
    return documents.groupBy(*KEY).agg(F.count("*").alias("size"))


def distinct_size_stream(
    opinions: DataFrame,
    namespace: str,
    patterns: list[str],
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Count each document of a stream once, however often and in whichever batches it comes.

    The checkpoint's state has a row for every document seen, spread by its key. A batch
    writes how many new ones each collection got to a folder of its own under ``path``; a batch that
    is run again replaces it, so nothing counts twice. ``distinct_sizes`` adds them up.
    """
    documents = imports.fan_out(imports.with_text(opinions), namespace, patterns).select(*KEY, "doc_id")

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.groupBy(*KEY).agg(F.count("*").alias("fresh"))
        fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return (
        documents.dropDuplicates([*KEY, "doc_id"])
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def distinct_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Different documents per collection that a ``distinct_size_stream`` has seen so far."""
    batches = spark.read.schema("namespace string, collection_key string, fresh bigint, batch bigint").parquet(path)
    return batches.groupBy(*KEY).agg(F.sum("fresh").alias("size"))


def import_tsv_stream(
    path: str,
    store: Store,
    namespace: str,
    patterns: list[str],
    checkpoint: str,
    now_ms: int | None = None,
    max_files: int = 1_000,
    every: str | None = None,
) -> StreamingQuery:
    """The same for escaped TSV files as they arrive in a folder.

    Spark's file source keeps track of which files are new; only their names, at
    most ``max_files`` a batch, pass through the driver, and the files themselves
    are read in byte ranges as in a batch.
    """

    stream = _stream_id(store.spark, checkpoint)

    def load(batch: DataFrame, batch_id: int) -> None:
        files = [row["path"] for row in batch.collect()]
        name = _load_of(store, stream, batch_id, now_ms)
        if files and not store.finished("collections", name):
            import_files(store.spark, files, store, namespace, patterns, name, size="running", replace=True)

    names = (
        store.spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select("path")
    )
    return (
        names.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )
