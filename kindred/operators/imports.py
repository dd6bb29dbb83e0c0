"""Opinions to documents of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.keys import collection_key
from kindred.schema import KEY


def has_text() -> Column:
    return F.length("text") > 0


def with_text(opinions: DataFrame) -> DataFrame:
    """Opinions that are imported at all."""
    return opinions.filter(has_text())


def fan_out(opinions: DataFrame, namespace: str, patterns: list[str]) -> DataFrame:
    """One document per opinion and key pattern, in the collection the pattern names."""
    if not patterns:
        raise ValueError("at least one key pattern is needed")
    keys = F.explode(F.array(*[collection_key(p) for p in patterns]))
    others = [c for c in opinions.columns if c not in (*KEY, "id", "text")]
    return opinions.select(
        F.lit(namespace).alias("namespace"),
        keys.alias("collection_key"),
        F.col("id").alias("doc_id"),
        "text",
        *others,
    )


def collection_sizes(documents: DataFrame, modified_ms: int) -> DataFrame:
    """Documents of this import per collection, repeated ids counted each time."""
    return documents.groupBy(*KEY).agg(
        F.count("*").alias("size"), F.lit(modified_ms).cast("bigint").alias("modified_ms")
    )


def import_counters(opinions: DataFrame, namespace: str, patterns: list[str]) -> DataFrame:
    """One row: records used and discarded, documents and collections made from them."""
    keys = F.array(*[collection_key(p) for p in patterns])
    documents = opinions.select(
        F.lit(namespace).alias("namespace"),
        F.coalesce(has_text(), F.lit(False)).alias("used"),
        F.posexplode(keys).alias("pattern", "collection_key"),
    )
    used, first = F.col("used"), F.col("pattern") == 0
    return documents.agg(
        F.count_if(used & first).alias("rows_used"),
        F.count_if(~used & first).alias("rows_discarded"),
        F.count_if(used).alias("docs_created"),
        F.count_distinct(F.when(used, F.col("collection_key"))).alias("collections_created"),
    )


def latest_documents(documents: DataFrame, order: Column) -> DataFrame:
    """The last text per document by ``order``; documents without text do not count.

    ``copies`` tells how many rows of the input named the document.
    """
    return (
        with_text(documents)
        .groupBy(*KEY, "doc_id")
        .agg(F.max_by("text", order).alias("text"), F.count("*").alias("copies"))
    )


COMMON = ("size", "modified_ms")
PER_CONFIGURATION = ("rebuilt_ms", "processed_ms", "run")


def _set_at(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.col("load_seq"))


def _last_values(loads: DataFrame) -> DataFrame:
    """Per collection and configuration the last value of each attribute, and when it was set."""
    missing = {c: F.lit(None).cast("string") for c in ("run",) if c not in loads.columns}
    return loads.withColumns(missing).groupBy(*KEY, "configuration").agg(
        *[F.max_by(c, _set_at(c)).alias(c) for c in COMMON + PER_CONFIGURATION],
        *[F.max(_set_at(c)).alias(f"{c}_seq") for c in COMMON + PER_CONFIGURATION],
        F.max("load_seq").alias("seen_seq"),
    )


def merge_collections(loads: DataFrame) -> DataFrame:
    """Current attributes per collection out of partial updates.

    Each attribute holds its last value by ``load_seq`` that is not null, so an
    update changes only what it sets. ``state`` maps configuration names to what
    is kept for each.
    """
    entry = F.struct(
        F.col("configuration").alias("key"),
        F.struct(*PER_CONFIGURATION).alias("value"),
    )
    return _last_values(loads).groupBy(*KEY).agg(
        F.max_by("size", "size_seq").alias("size"),
        F.max_by("modified_ms", "modified_ms_seq").alias("modified_ms"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("configuration").isNotNull(), entry))
        ).alias("state"),
    )


def compact_loads(loads: DataFrame) -> DataFrame:
    """Loads that merge to the same, now and with any others: a row per attribute, and
    one for a collection as such."""
    names = COMMON + PER_CONFIGURATION
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.col(f"{name}_seq").alias("load_seq"),
                    *(F.when(F.lit(c == name), F.col(c)).alias(c) for c in names),
                )
                for name in (*names, "seen")
            )
        )
    )
    rows = _last_values(loads).select(*KEY, "configuration", each.alias("_last"))
    return rows.where("_last.load_seq IS NOT NULL").select(
        "_last.load_seq", *KEY, "_last.size", "_last.modified_ms", "configuration",
        "_last.rebuilt_ms", "_last.processed_ms", "_last.run",
    )


def state_of(configuration: str, attribute: str) -> Column:
    return F.col("state")[configuration][attribute]


def stale(collections: DataFrame, configuration: str = "DEFAULT") -> DataFrame:
    """Collections modified at or after their last rebuild, or never rebuilt."""
    rebuilt = state_of(configuration, "rebuilt_ms")
    return collections.filter(
        F.col("modified_ms").isNotNull() & (rebuilt.isNull() | (rebuilt <= F.col("modified_ms")))
    )
