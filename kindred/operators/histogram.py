"""Histograms with given left bounds; the last bucket is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Left bounds of the logarithmic buckets.
LOG_BOUNDS = (0.0, 0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0)


def linear_bounds(offset: float, width: float) -> tuple[float, ...]:
    """Eleven left bounds, ``width`` apart."""
    return tuple(offset + width * step for step in range(11))


def bucket(value: Column, bounds: tuple[float, ...] = LOG_BOUNDS) -> Column:
    """Index of the last bound not above ``value``; -1 below all of them."""
    if list(bounds) != sorted(bounds):
        raise ValueError("bounds must be ascending")
    index = F.lit(-1)
    for bound in bounds:
        index = index + (value >= F.lit(bound)).cast("int")
    return index


def histogram(
    df: DataFrame,
    value: str,
    times: str | None = None,
    bounds: tuple[float, ...] = LOG_BOUNDS,
    prior: tuple[int, ...] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """One row per bucket, empty ones included: count and share of all samples.

    A sample counts ``times`` times. Samples below the first bound are part of
    ``n`` but of no bucket; ``below`` tells how many they are. ``prior`` continues
    from earlier counts. All buckets are counted in one pass, by partial sums.
    """
    earlier = prior or (0,) * len(bounds)
    if len(earlier) != len(bounds):
        raise ValueError("prior needs one count per bucket")
    by = by or []
    weight = F.col(times).cast("bigint") if times else F.lit(1).cast("bigint")
    samples = df.filter(F.col(value).isNotNull()).select(
        *by, bucket(F.col(value), bounds).alias("_bucket"), weight.alias("_weight")
    )

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_weight"))), F.lit(0))

    at = F.col("_bucket")
    counted = samples.groupBy(*by).agg(
        F.array(
            *[total(at == i) + F.lit(earlier[i]) for i in range(len(bounds))]
        ).alias("_counts"),
        total(at < 0).alias("below"),
    )
    rows = counted.select(
        *by,
        "below",
        (F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, c: a + c) + F.col("below")).alias(
            "n"
        ),
        F.posexplode("_counts").alias("bucket_idx", "count"),
    )
    left = F.array(*[F.lit(float(b)) for b in bounds])[F.col("bucket_idx")]
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("count") / F.col("n"))
    return rows.select(
        *by, "bucket_idx", left.alias("left_bound"), "count", share.alias("portion"), "n", "below"
    )


def merge_histograms(*parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add up histograms over the same bounds."""
    by = by or []
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    summed = both.groupBy(*by, "bucket_idx", "left_bound").agg(
        *[F.sum(c).alias(c) for c in ("count", "n", "below")]
    )
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("count") / F.col("n"))
    return summed.select(
        *by, "bucket_idx", "left_bound", "count", share.alias("portion"), "n", "below"
    )


def histogram_summary(buckets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a histogram: ``max_index`` is the first of the largest buckets."""
    return buckets.groupBy(*(by or [])).agg(
        F.max("n").alias("n"),
        F.max("below").alias("below"),
        F.count("*").alias("k"),
        F.min("left_bound").alias("left"),
        F.max("left_bound").alias("right"),
        F.max_by("bucket_idx", F.struct(F.col("count"), -F.col("bucket_idx"))).alias("max_index"),
    )
