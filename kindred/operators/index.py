"""Dense numbering of rows within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.staging import stage

_SLICE_BITS = 33  # monotonically_increasing_id: task number above, row number below


def dense_index(
    df: DataFrame, keys: list[str], order: list[Column], total: str | None = None
) -> DataFrame:
    """Add ``idx`` (0-based position within ``keys`` in ``order``) and ``n_rows``.

    With ``total``, that column's sum per key comes along as ``total``.

    Rows are range-partitioned and sorted, so a key of any size spreads over many
    tasks. What is added up across tasks is one row per key and task, and no key
    has more of these than there are tasks. ``order`` must have no ties.
    """
    by = [F.col(k) for k in keys] + order
    rows = stage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", _SLICE_BITS)),
        "sorted",
    )
    runs = rows.groupBy(*keys, "_slice").agg(
        F.min("_at").alias("_first"),
        F.count("*").alias("_n"),
        F.sum(total or F.lit(0)).alias("_total"),
    )
    within = Window.partitionBy(*keys)
    earlier = within.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        *keys,
        "_slice",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(within).alias("n_rows"),
        *([F.sum("_total").over(within).alias("total")] if total else []),
    )
    return (
        rows.join(stage(shifts, "shifts"), [*keys, "_slice"])
        .withColumn("idx", F.col("_at") + F.col("_shift"))
        .drop("_at", "_slice", "_shift")
    )
