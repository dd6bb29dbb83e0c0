"""Opinions into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import imports
from kindred.schema import KEY
from kindred.sources.opinions import conform, rejects
from kindred.sources.store import Load, Store, as_load
from kindred.sources.tsv import read_escaped_tsv
from kindred.staging import stage, temporary

SIZE_MODES = ("import", "running", "distinct")


def import_opinions(
    opinions: DataFrame,
    store: Store,
    namespace: str,
    patterns: list[str],
    load: Load | int,
    modified_ms: int | None = None,
    order: Column | None = None,
    size: str = "import",
    rejected: DataFrame | None = None,
    replace: bool = False,
) -> dict[str, int]:
    """Write documents and collections of all patterns; returns the counters.

    ``load`` is the time of the import or names it in full, to be able to run it again.
    The counters come from what was written, so that tasks run twice count once; only
    discarded records take another scan, of their text, and ``rejected`` ones, which did
    not conform, are only counted. The store keeps the counters as well.

    The collections' size is the number of documents of this import (repeats
    counted), that added to the earlier size (``running``), or the number of
    different documents there are now (``distinct``).
    """
    if size not in SIZE_MODES:
        raise ValueError(f"unknown size mode: {size}")
    load = as_load(load)
    documents = imports.fan_out(imports.with_text(opinions), namespace, patterns)
    written = store.upsert_documents(documents, load, order, replace)
    sizes = written.groupBy(*KEY).agg(F.sum("copies").alias("size"))
    if size == "running":
        earlier = store.collections(before=load).select(
            *KEY, F.coalesce("size", F.lit(0)).alias("earlier")
        )
        sizes = sizes.join(earlier, KEY, "left").select(
            *KEY, (F.col("size") + F.coalesce("earlier", F.lit(0))).alias("size")
        )
    elif size == "distinct":
        touched = sizes.select(*KEY)
        now = store.documents(touched).groupBy(*KEY).agg(F.count("*").alias("size"))
        sizes = now
    totals = written.agg(F.sum("copies").alias("docs"), F.count_distinct(*KEY).alias("keys")).first()
    docs = totals["docs"] or 0
    blank = ~F.coalesce(imports.has_text(), F.lit(False))
    counters = {
        "rows_used": docs // len(patterns),
        "rows_discarded": opinions.filter(blank).count(),
        "rows_rejected": 0 if rejected is None else rejected.count(),
        "docs_created": docs,
        "collections_created": totals["keys"],
    }
    store.record_counters(load, counters)
    # last: a load whose collections are stored is complete
    modified = load.ms if modified_ms is None else modified_ms
    store.upsert_collections(sizes.withColumn("modified_ms", F.lit(modified)), load, replace)
    return counters


def import_files(
    spark: SparkSession,
    paths: str | list[str],
    store: Store,
    namespace: str,
    patterns: list[str],
    load: Load | int,
    size: str = "import",
    replace: bool = False,
) -> dict[str, int]:
    """Import escaped TSV files: ``import_opinions`` of the records with as many fields as an opinion has.

    The files are decoded once; records with more or fewer fields are counted as
    ``rows_rejected``. Of several records of a document the last one counts, by file and place.
    """
    with temporary(spark):
        records = stage(read_escaped_tsv(spark, paths), "records")
        return import_opinions(
            conform(records), store, namespace, patterns, load,
            order=F.struct("file", "start"), size=size, rejected=rejects(records), replace=replace,
        )
