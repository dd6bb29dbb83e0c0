"""Near-duplicate vectors by Euclidean p-stable hashing, verified by exact cosine.

Vectors are scaled to length one, where a cosine of c is a distance of sqrt(2 - 2c). A
table hashes them by ``HASHES`` Gaussian projections, shifted, divided by ``WIDTH`` and
rounded down; all of them together are the bucket. At a cosine of exactly 0.95 a pair
shares a bucket of one table with probability 0.07 and of one of 64 tables with 0.99; at
0.97 with 0.9999, at 0.98 with 1 - 1e-6. No bucket is capped: large ones are dealt out in
tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.simhash import forest
from kindred.staging import stage

TABLES, HASHES, WIDTH = 64, 12, 1.26
TILE = 1024
"""Vectors of one bucket that one side of a comparison takes."""


def near_duplicates(rows: DataFrame, threshold: float = 0.95, tables: int = TABLES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``rows (vec_id, embedding, …)``.

    Vectors link if their cosine in double precision is ``threshold`` or more. Equal
    vectors are compared once and count each. Null and zero vectors and those with null
    or non-finite components link with nothing, nor do vectors of different lengths.
    ``component_id`` is the smallest ``vec_id`` reachable, null only where all ids
    reached are null; ``kept`` is true for the rows with that id, false for a null id.
    """
    whole = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    valid = F.coalesce(whole & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(valid, F.col("embedding")).alias("embedding"))
    groups = stage(
        rows.where("embedding IS NOT NULL")
        .groupBy("embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    found = stage(_links(groups, threshold, tables), "links")
    n_links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    named = stage(
        groups.join(roots, "node", "left")
        .join(n_links.withColumnRenamed("a", "node"), "node", "left")
        .select(
            "embedding",
            "first_id",
            F.coalesce("root", "node").alias("root"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        ),
        "named",
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = (
        rows.where("embedding IS NOT NULL")
        .join(named.join(least, "root").drop("root", "first_id"), "embedding")
        .select("vec_id", "n_links", "component_id")
    )
    alone = rows.where("embedding IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def _links(groups: DataFrame, threshold: float, tables: int) -> DataFrame:
    """``(a, b)`` that connect what links connect, and ``(a, null, n)``: linked copies found."""
    keys = stage(
        groups.select("node", "embedding").mapInArrow(
            partial(_hash, tables=tables), "node bigint, t int, bucket bigint"
        ),
        "buckets",
    )
    shared = (
        keys.groupBy("t", "bucket")
        .count()
        .where("count > 1")
        .select("t", "bucket", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    members = (
        keys.join(shared, ["t", "bucket"])
        .withColumn("own", own)
        .withColumn("other", other)
        .select(
            "node",
            "t",
            F.xxhash64("t", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
            F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2).alias("side"),
        )
    )
    return (
        members.join(groups.select("node", "copies", "embedding"), "node")
        .repartition("block")
        .sortWithinPartitions("block")
        .select("block", "side", "t", "node", "copies", "embedding")
        .mapInArrow(partial(_compare, threshold=threshold, tables=tables), "a bigint, b bigint, n bigint")
    )


@cache
def _projections(size: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng([20, size])
    return made.standard_normal((size, tables * HASHES)), made.uniform(0, WIDTH, tables * HASHES)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors in double precision, for each length of vector in turn."""
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        part = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        part = part.astype(np.float64).reshape(len(at), size)
        part = part / np.abs(part).max(axis=1, keepdims=True)  # no overflow in the squares
        yield at, part / np.sqrt((part * part).sum(axis=1, keepdims=True))


def _buckets(unit: np.ndarray, tables: int) -> np.ndarray:
    """One long per vector and table."""
    rays, shifts = _projections(unit.shape[1], tables)
    cells = np.floor((unit @ rays + shifts) / WIDTH).astype(np.int64).reshape(len(unit), tables, HASHES)
    out = np.full((len(unit), tables), unit.shape[1], dtype=np.uint64)
    for i in range(HASHES):
        out = (out ^ cells[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _hash(batches, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            nodes = part.column(0).to_numpy(zero_copy_only=False)
            for at, unit in _matrices(part.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(nodes[at], tables)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                        pa.array(_buckets(unit, tables).reshape(-1)),
                    ],
                    ["node", "t", "bucket"],
                )


def _compare(batches, threshold: float, tables: int) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        blocks = rows.column(0).to_numpy()
        cut = int(np.searchsorted(blocks, blocks[-1])) if len(blocks) else 0
        if cut:
            yield _linked(rows.slice(0, cut), threshold, tables)
        rest = rows.slice(cut)
    if rest is not None and len(rest):
        yield _linked(rest, threshold, tables)


def _linked(rows: pa.Table, threshold: float, tables: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    block, side, t, node, copies = (rows.column(i).to_numpy() for i in range(5))
    vectors = rows.column(5).chunk(0)
    tied: list[tuple[np.ndarray, np.ndarray]] = []
    seen = np.zeros(len(node), dtype=np.int64)
    starts = np.r_[0, np.flatnonzero(np.diff(block)) + 1]
    for start, end in zip(starts, np.r_[starts[1:], len(block)]):
        for at, unit in _matrices(vectors.slice(start, end - start)):
            at = at + start
            x, y = (np.flatnonzero(side[at] != k) for k in (1, 0))
            same = len(x) == len(y) == len(at)
            cosine = unit[x] @ unit[y].T
            i, j = np.nonzero(cosine >= threshold)
            i, j = x[i], y[j]
            far = i < j if same else i != j
            i, j = i[far], j[far]
            if not len(i):
                continue
            # a pair counts in the first table that has it in one bucket
            keys = _buckets(unit, tables)[:, : t[start]]
            new = np.ones(len(i), dtype=bool)
            for k in range(t[start]):
                new &= keys[i, k] != keys[j, k]
            i, j = at[i[new]], at[j[new]]
            np.add.at(seen, i, copies[j])
            np.add.at(seen, j, copies[i])
            if len(i):
                tied.append(forest(node[i], node[j]))
    a, b = (np.concatenate(x) for x in zip(*tied)) if tied else (np.zeros(0, np.int64),) * 2
    counted = np.flatnonzero(seen)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[a, node[counted]], pa.int64()),
            pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(counted), pa.int64())]),
            pa.array(np.r_[np.zeros(len(a), np.int64), seen[counted]], pa.int64()),
        ],
        ["a", "b", "n"],
    )
