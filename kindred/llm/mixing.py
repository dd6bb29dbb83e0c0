"""Mixing sources to target weights by Pfair scheduling.

A source's documents follow each other in blocks of equal size. Block j of a source with
weight w is released at slot floor(j / w) and due by ceil((j + 1) / w); in each slot the
released block with the earliest deadline goes next. That keeps every source less than one
block away from its share of any number of slots. Weights are whole parts of their sum, so the
schedule repeats after as many slots as there are parts: one period, bounded by the
weights alone, tells the slot of every block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.llm.common import row_key
from kindred.operators.index import dense_index
from kindred.staging import stage

OTHERS = "(others)"
MAX_PARTS = 10_000
BLOCK = 1 << 16
"""Characters of a block."""


def period(spark: SparkSession, parts: dict[str, int]) -> DataFrame:
    """``source, parts, total, slots``: the slots of a source's blocks within one period."""
    total = sum(parts.values())
    if not parts or min(parts.values()) < 1 or total > MAX_PARTS:
        raise ValueError(f"weights must be positive whole numbers with a sum of at most {MAX_PARTS}")
    names = sorted(parts)
    weights = F.array(*(F.lit(parts[n]) for n in names))
    done = F.array(*(F.lit(0) for _ in names))

    def next_slot(state: Column, slot: Column) -> Column:
        # deadline and number of each source whose next block is released and in this period
        waiting = F.transform(
            state["done"],
            lambda n, i: F.when(
                (n < F.get(weights, i)) & (n * total < (slot + 1) * F.get(weights, i)),
                F.struct(F.ceil((n + 1) * total / F.get(weights, i)).alias("due"), i.alias("i")),
            ),
        )
        pick = F.array_min(waiting)["i"]
        return F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == pick, 1).otherwise(0)).alias("done"),
            F.concat(state["picks"], F.array(pick)).alias("picks"),
        )

    start = F.struct(done.alias("done"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, next_slot, lambda s: s["picks"])
    named = F.array(*(F.lit(n) for n in names))
    return (
        spark.range(1)
        .select(F.posexplode(picks).alias("slot", "i"))
        .groupBy("i")
        .agg(F.sort_array(F.collect_list("slot")).alias("slots"))
        .select(
            F.get(named, F.col("i")).alias("source"),
            F.get(weights, F.col("i")).alias("parts"),
            F.lit(total).alias("total"),
            "slots",
        )
    )


def schedule(
    docs: DataFrame, parts: dict[str, int], others: int = 0, block: int = BLOCK
) -> DataFrame:
    """A row per row of ``docs (doc_id, text, source, …)`` with its place in the mix.

    ``_k1, _k2`` (see ``row_key``), ``doc_id, source, start`` (characters of its source
    before it), ``block, slot``, and ``position``, its number in the mix. Within a source
    the order is that of ``doc_id``, null first. Sources that ``parts`` does not name, null
    among them, count as one with ``others`` parts (needed if there are any). A
    document belongs to the block it begins in; a source that has run out leaves its slots
    free, and the others keep their proportions. Nothing is dropped or repeated.
    """
    spark = docs.sparkSession
    weights = {**parts, **({OTHERS: others} if others else {})}
    group = F.coalesce(*(F.when(F.col("source") == n, F.lit(n)) for n in sorted(parts)), F.lit(OTHERS))
    if not parts:
        group = F.lit(OTHERS)
    rows = docs.select(
        *row_key("doc_id", "text", "source"),
        "doc_id",
        "source",
        group.alias("_group"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("_n"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("_k2")]
    rows = running_sum(rows, "_group", order, "_n").withColumn("block", F.floor(F.col("start") / block).cast("bigint"))
    table = F.broadcast(period(spark, weights).withColumnRenamed("source", "_group"))  # a row per weight
    if not others and rows.join(table, "_group", "left_anti").limit(1).count():
        raise ValueError("there are sources without a weight; give others some parts")
    share = F.col("parts").cast("bigint")
    placed = rows.join(table, "_group").withColumn(
        "slot",
        F.floor(F.col("block") / share).cast("bigint") * F.col("total")
        + F.element_at("slots", (F.col("block") % share + 1).cast("int")),
    )
    kept = ["_k1", "_k2", "doc_id", "source", "start", "block", "slot"]
    order = [F.col("slot"), F.col("start"), F.col("doc_id").asc_nulls_first(), F.col("_k2")]
    return dense_index(placed.select(*kept), [], order).withColumnRenamed("idx", "position").drop("n_rows")


def running_sum(rows: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``start``: the sum of ``value`` over the earlier rows of the same key.

    Like ``dense_index``: range partitions, sums within a task's run of a key, and one
    offset per run, so that no key meets in one task.
    """
    by = [F.col(key), *order]
    sorted_rows = stage(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_at", 33)),
        "runs",
    )
    within = Window.partitionBy(key, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sorted_rows.groupBy(key, "_slice")
        .agg(F.sum(value).alias("_sum"))
        .select(key, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        sorted_rows.withColumn("start", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(offsets, [key, "_slice"])
        .withColumn("start", F.col("start") + F.col("_before"))
        .drop("_at", "_slice", "_before")
    )


def mix(docs: DataFrame, parts: dict[str, int], others: int = 0, block: int = BLOCK) -> DataFrame:
    """``docs`` in the order of the mix: partitions and the rows in them follow each other.

    Written out, files by name and rows within them are in that order.
    """
    places = schedule(docs, parts, others, block).groupBy("_k1", "_k2").agg(F.min("position").alias("_position"))
    keyed = docs.select(*docs.columns, *row_key("doc_id", "text", "source"))
    return (
        keyed.join(places, ["_k1", "_k2"])
        .repartitionByRange("_position")
        .sortWithinPartitions("_position")
        .select(*docs.columns)
    )
