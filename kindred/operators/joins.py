"""Join of many rows to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.staging import stage

MAX_BROADCAST_ROWS = 100_000
MARKS = 8_192
"""Bits to a list of ``possible``."""


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    load: str | None = None,
    max_hot_keys: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of ``rows`` to ``table``, whole even when few keys hold most rows.

    ``table`` has one row per key and ``load`` tells how many of ``rows`` match it
    (or a number in proportion to that); without it they are counted, if there are more than ``max_hot_keys`` keys. The ``max_hot_keys``
    keys of the largest loads, among them all that hold more than ``1 / max_hot_keys`` of the sum,
    are broadcast under a hash of the key, so that long keys do not count, and no key
    left for the shuffle is large. A table of no more keys than that goes this way as a whole. Both
    inputs are read more than once and should be staged tables.
    """
    if load is None and table.count() > max_hot_keys:
        counts = rows.groupBy(*on).agg(F.count("*").alias("_load"))
        table, load = stage(table.join(counts, on), "counted"), "_load"
    elif load is None:
        table = table.dropna(subset=on)
    sums = table.agg(F.sum(load).alias("load"), F.count("*").alias("keys")).first() if load else None
    few = sums is None or sums["keys"] <= max_hot_keys
    is_hot = F.lit(True) if few else _largest(table, load, (sums["load"] or 0) / max_hot_keys, max_hot_keys)
    name = [F.xxhash64(*on).alias("_h1"), F.xxhash64(F.lit(1), *on).alias("_h2")]
    others = [c for c in table.columns if c not in on]
    hot = F.broadcast(table.filter(is_hot).select(*name, *others))  # max_hot_keys rows at most
    named = rows.select(*on, *(c for c in rows.columns if c not in on), *name)
    hot_rows = named.join(hot, ["_h1", "_h2"]).drop("_h1", "_h2")
    if few:
        return hot_rows.drop("_load")
    keys = hot.select("_h1", "_h2")
    cold_rows = named.join(F.broadcast(keys), ["_h1", "_h2"], "left_anti").drop("_h1", "_h2")
    joined = hot_rows.unionByName(cold_rows.join(table.filter(~is_hot), on))
    return joined.drop("_load")


def possible(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those that ``keys`` have no match for; all that have one stay.

    What is broadcast is a bit for each hash of a key, in lists of 8,192: 16 bits a key, at most 64 MB in all.
    """
    most = 16 * keys.count() // MARKS
    lists = 1 << min(16, max(0, most).bit_length())
    # three parts of the hash: the list, the word of it and the bit of the word
    hashed = F.xxhash64(*on)
    place = {
        "_list": hashed.bitwiseAND(F.lit(lists - 1)),
        "_word": F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(MARKS // 64 - 1)).cast("int"),
        "_bit": F.shiftrightunsigned(hashed, 50).bitwiseAND(F.lit(63)).cast("int"),
    }
    marks = keys.select(*(column.alias(name) for name, column in place.items()))
    words = marks.groupBy("_list", "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_marks"))
    held = words.groupBy("_list").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_marks"))).alias("_held"))
    filled = F.expr(f"transform(sequence(0, {MARKS // 64 - 1}), i -> coalesce(_held[i], 0L))")
    table = F.broadcast(held.select(F.col("_list"), filled.alias("_marks")))
    marked = rows.withColumns(place).join(table, "_list").where("shiftright(get(_marks, _word), _bit) & 1 = 1")
    return marked.select(*rows.columns)


def _largest(table: DataFrame, load: str, share: float, most: int) -> Column:
    """Whether a key is one of the largest: more than ``share``, which ``most`` keys can hold, or as many steps
    of the sixteenth part of a power of two below as there is room for."""
    step = F.floor(16 * F.log2(F.when(F.col(load) > 0, F.col(load))))
    sizes = table.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).where("step IS NOT NULL")
    lowest, room = None, most
    for row in sizes.orderBy(F.desc("step")).collect():  # 16 rows for each binary digit of a load
        room -= row["keys"]
        if room < 0:
            break
        lowest = row["step"]
    large = F.col(load) > share
    return F.coalesce(large if lowest is None else large | (step >= lowest), F.lit(False))
