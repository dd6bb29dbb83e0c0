"""Near-duplicates by SimHash: fingerprints a few bits apart, found in a grid of bit counts.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits.
The Manhattan distance of two such vectors is never more than the number of
differing bits, so it is a lower bound to join by. The segments are dealt into bands;
of ``(radius + 1) / 2`` bands, rounded up, at least one has a distance of 0 or 1 for
each pair within ``radius``. A band's counts are a cell of a grid: a fingerprint
stays in its own cell and looks into that cell and those one step up in one
coordinate, which meets every such pair, and the differing bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import row_key, word_blocks
from kindred.llm.components import components
from kindred.staging import stage

SEED = 42
SEGMENTS = 32  # of two bits each
CELL_HOMES = 512
"""A cell with more fingerprints than this is dealt out over several groups."""


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """``docs`` with ``fp`` in place of ``text``: one 64-bit fingerprint per lane, as longs.

    A-Z are lower-cased, shingles count as often as they occur; a text with fewer
    words than a shingle is one shingle, one without words (null, empty, blank) has
    fingerprint zero. The first lane has the plain XXH64 of the shingles, further
    lanes mix it again. A bit is 1 if set in over half of the shingles.
    """
    rest = [c for c in docs.columns if c not in ("text", "fp")]
    docs = docs.select(*rest, "text")
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("fp", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(partial(_fingerprints, shingle=shingle, lanes=lanes), schema)


def _fingerprints(batches, shingle: int, lanes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprint(x.as_py(), shingle, lanes) for x in batch.column(batch.num_columns - 1)]
        values = np.array(out, dtype=np.uint64).reshape(-1, lanes).view(np.int64)
        offsets = np.arange(0, len(out) * lanes + 1, lanes, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))],
            [*batch.schema.names[:-1], "fp"],
        )


def fingerprint(text: str | None, shingle: int, lanes: int) -> list[int]:
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total = np.zeros((lanes, 64), dtype=np.int64), 0
    for words in word_blocks((text or "").encode().lower(), shingle - 1):
        if len(words) >= shingle:
            hashes = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))]
        elif words and not total:
            hashes = [digest(join(words), SEED)]
        else:
            continue
        total += len(hashes)
        mixed = np.array(hashes, dtype=np.uint64)
        for lane in range(lanes):
            for at in range(0, len(mixed), 1 << 14):
                part = mixed[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones[lane] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
    bits = (2 * ones > total).astype(np.uint8)
    return [int(x) for x in np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)]


def segment_counts(fingerprint: Column) -> Column:
    """The 32 bit counts, each in two bits of a long."""
    low = fingerprint.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(fingerprint, 1).bitwiseAND(F.lit(0x5555555555555555))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, lanes: int = 1) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs (doc_id, text, …)``.

    Fingerprints link if they differ in at most ``radius`` bits in some lane.
    ``component_id`` is the smallest ``doc_id`` reachable over links (null if all ids
    reached are null). Copies share a fingerprint and are compared once; repeated rows stay
    repeated. Other columns are ignored. An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs.select("doc_id", "text"), shingle, lanes), "fingerprints")
    named = _components(rows, F.min("doc_id"), radius, lanes)
    return rows.join(named, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 5, lanes: int = 3) -> DataFrame:
    """The row with the smallest ``doc_id`` (null before all) of each component of ``docs``.

    Columns are those of ``docs``. Of rows equal in id and text one stays.
    """
    key = ["_k1", "_k2"]
    keyed = docs.select(*docs.columns, *row_key("doc_id", "text"))
    rows = stage(fingerprints(keyed.select("doc_id", *key, "text"), shingle, lanes), "fingerprints")
    firsts = _components(rows, F.min(F.struct("doc_id", *key)), radius, lanes)
    kept = firsts.select("first.*").select(*key).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def _components(rows: DataFrame, least: Column, radius: int, lanes: int) -> DataFrame:
    """``fp, first``: for each fingerprint the least of what its component's rows hold."""
    groups = stage(
        rows.groupBy("fp")
        .agg(least.alias("first"))
        .withColumn("node", F.xxhash64("fp") if lanes > 1 else F.col("fp")[0]),
        "groups",
    )
    roots = components(links(groups, radius, lanes))
    named = stage(
        groups.join(roots, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root")),
        "named",
    )
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    return named.select("fp", "root").join(firsts, "root").select("fp", "first")


def links(groups: DataFrame, radius: int, lanes: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what the links connect, of ``groups (node, fp)``.

    Pairs are compared in blocks of bounded size and never written out: a block
    gives a spanning forest of its links.
    """
    n_bands = (radius + 2) // 2
    seg = [SEGMENTS * i // n_bands for i in range(n_bands + 1)]
    lane = F.posexplode("fp").alias("lane", "word")
    counted = groups.select("node", lane).withColumn("c", segment_counts(F.col("word")))
    at_home = F.array(
        *(F.struct(F.lit(b).alias("band"), _cell(F.col("c"), lo, hi).alias("cell"))
          for b, (lo, hi) in enumerate(zip(seg, seg[1:])))
    )
    homes = counted.select("node", "word", "lane", F.inline(at_home)).withColumn("home", F.lit(True))
    # one step up in segment i, where its count is not yet 2
    steps = [
        F.when(
            F.shiftright("c", 2 * i).bitwiseAND(F.lit(3)) < 2,
            F.struct(F.lit(b).alias("band"), (_cell(F.col("c"), lo, hi) + F.lit(1 << 2 * (i - lo))).alias("cell")),
        )
        for b, (lo, hi) in enumerate(zip(seg, seg[1:]))
        for i in range(lo, hi)
    ]
    looks = counted.select("node", "word", "lane", F.inline(F.concat(at_home, F.array_compact(F.array(*steps)))))
    key = ["lane", "band", "cell"]
    crowded = homes.groupBy(*key).count().where(F.col("count") > CELL_HOMES)
    width = max(hi - lo for lo, hi in zip(seg, seg[1:]))
    around = crowded.select(
        "lane",
        "band",
        "count",
        F.explode(F.array("cell", *(F.col("cell") + F.lit(1 << 2 * i) for i in range(width)))).alias("cell"),
    )
    # homes of a cell, and of those that look into it: both bound the groups to deal
    tiles = stage(
        around.groupBy(*key)
        .agg(F.sum("count").alias("n_looks"))
        .join(crowded, key, "left")
        .select(
            *key,
            F.ceil(F.coalesce("count", F.lit(1)) / CELL_HOMES).cast("int").alias("home_tiles"),
            (F.ceil(F.col("n_looks") / (16 * CELL_HOMES)) + 1).cast("int").alias("look_tiles"),
        ),
        "tiles",
    )
    dealt = (
        homes.unionByName(looks.withColumn("home", F.lit(False)))
        .join(tiles, key, "left")
        .withColumn("_all_h", F.sequence(F.lit(0), F.coalesce("home_tiles", F.lit(1)) - 1))
        .withColumn("_all_l", F.sequence(F.lit(0), F.coalesce("look_tiles", F.lit(1)) - 1))
        .withColumn("_h", F.array(F.pmod(F.xxhash64("node"), F.size("_all_h")).cast("int")))
        .withColumn("_l", F.array(F.pmod(F.xxhash64("node"), F.size("_all_l")).cast("int")))
        .withColumn("_h", F.explode(F.when(F.col("home"), F.col("_h")).otherwise(F.col("_all_h"))))
        .withColumn("_l", F.explode(F.when(F.col("home"), F.col("_all_l")).otherwise(F.col("_l"))))
        .select(F.xxhash64(*key, "_h", "_l").alias("block"), "home", "node", *(["word"] if lanes > 1 else []))
    )
    return (
        dealt.repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(partial(_compare, radius=radius), "a bigint, b bigint")
    )


def _cell(counts: Column, lo: int, hi: int) -> Column:
    width = 2 * (hi - lo)
    return F.shiftrightunsigned(counts, 2 * lo).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _compare(batches, radius: int) -> Iterator[pa.RecordBatch]:
    rest: list[np.ndarray] | None = None
    for batch in batches:
        node = batch.column(2).to_numpy(zero_copy_only=False)
        word = batch.column(3).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else node
        rows = [
            batch.column(0).to_numpy(zero_copy_only=False),
            batch.column(1).to_numpy(zero_copy_only=False).astype(bool),
            node,
            word.view(np.uint64),
        ]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        # the last block may go on in the next batch
        cut = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        rest = [x[cut:] for x in rows]
        yield _edges([x[:cut] for x in rows], radius)
    if rest is not None:
        yield _edges(rest, radius)


def _edges(rows: list[np.ndarray], radius: int) -> pa.RecordBatch:
    block, home, node, word = rows
    ends = np.flatnonzero(np.diff(block)) + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts, ends = np.r_[0, ends], np.r_[ends, len(block)]
    # blocks in which someone looks at someone else
    n_home = np.add.reduceat(home.astype(np.int64), starts) if len(block) else np.zeros(0)
    for i in np.flatnonzero((n_home > 0) & (ends - starts > 2)):
        part = slice(starts[i], ends[i])
        h = home[part]
        mine, theirs = word[part][h], word[part][~h]
        a, b = node[part][h], node[part][~h]
        for at in range(0, len(b), 2048):
            near = np.bitwise_count(mine[:, None] ^ theirs[None, at : at + 2048]) <= radius
            x, y = np.nonzero(near)
            x, y = a[x], b[at : at + 2048][y]
            if len(different := np.flatnonzero(x != y)):
                found.append(forest(x[different], y[different]))
    if not found:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    a, b = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of a small graph to the smallest one of its component."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[u], root[v])
        np.minimum.at(least, root[v], root[u])
        least = np.minimum(least, least[least])
        new = least[root]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]
