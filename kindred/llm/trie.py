"""A prefix trie of conversations, out of sorted sequences and their common prefixes.

Conversations are sorted by their sequences of turns; ``lcp`` is how many turns one has in
common with the one before. The conversations that begin with the first ``d`` turns of one of them lie
next to it: from the nearest place to the left with ``lcp < d`` up to the nearest to the right. Every
candidate prefix searches both ends for itself, by binary search in a sparse table of
range minima; there is no stack and no order in which prefixes have to come.

The sorted conversations are dealt into blocks with a sparse table each. A second one, over
the blocks' minima, tells the block of a left end that lies before the own block; there
are at most ``MAX_BLOCKS`` of these, whatever the number of conversations. A prefix that
ends at the last place with ``lcp < d`` of a block is named by that block, so that blocks agree on
it without asking each other, and their counts are summed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.tiles import ranges
from kindred.operators.index import dense_index
from kindred.operators.joins import lookup
from kindred.staging import stage

BLOCK = 512
MAX_BLOCKS = 1 << 18
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Trie:
    """``nodes``: a row per prefix: ``node, depth`` name it, ``parent`` (with depth less one) the one
    above; the members are ``n_convs`` conversations from ``first_rank`` on, of which the
    first ``n_ends`` are the prefix itself. ``members``: ``conv_id``, its ``rank`` and the node it ends at."""

    nodes: DataFrame
    members: DataFrame


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k has at i the least of the 2**k values from i on."""
    levels = [values]
    while (half := 1 << (len(levels) - 1)) * 2 <= len(values):
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def left_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to ``at`` with a value below ``depth``, -1 if there is none."""
    end = at + 1
    for k in reversed(range(len(levels))):
        start = end - (1 << k)
        skip = (start >= 0) & (levels[k][np.maximum(start, 0)] >= depth)
        end = np.where(skip, start, end)
    return end - 1


def right_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place after ``at`` with a value below ``depth``, the number of values if there is none."""
    start, n = at + 1, len(levels[0])
    for k in reversed(range(len(levels))):
        end = start + (1 << k)
        skip = (end <= n) & (levels[k][np.minimum(start, len(levels[k]) - 1)] >= depth)
        start = np.where(skip, end, start)
    return start


def common_prefixes(keys: pa.ListArray) -> np.ndarray:
    """How many elements each list shares with the one before; elements are 16 bytes."""
    length = np.diff(keys.offsets.to_numpy()).astype(np.int64)
    values = keys.flatten()
    words = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint64).reshape(-1, 2)
    start = length.cumsum() - length
    both = np.minimum(length[:-1], length[1:])
    here, row = ranges(start[1:], both), np.repeat(np.arange(len(both)), both)
    place = here - np.repeat(start[1:], both)
    same = (words[here] == words[np.repeat(start[:-1], both) + place]).all(axis=1)
    out = both.copy()
    np.minimum.at(out, row[~same], place[~same])
    return out


# --- tasks -----------------------------------------------------------------------------------

RANKS = "block bigint, rank bigint, conv_id bigint, n_turns bigint, lcp bigint, is_leaf boolean, sums array<bigint>"


def _ranks(block: int, group: pa.Table, size: int) -> pa.Table:
    """The rows of a block with their common prefixes; its neighbours' next rows come along."""
    group = group.sort_by("idx").combine_chunks()
    rank = group["idx"].to_numpy()
    keys = group["key"].combine_chunks()
    lcp = common_prefixes(keys)
    before = np.r_[-1, lcp]  # of a first row without one before it
    after = np.r_[lcp, -1]
    chars = group["chars"].combine_chunks()
    n_turns = np.diff(keys.offsets.to_numpy()).astype(np.int64)
    offsets = np.r_[0, (n_turns + 1).cumsum()]
    # 0 and the running sums of each row: the sum so far less what it was at the row's start
    steps = np.zeros(offsets[-1], np.int64)
    steps[np.delete(np.arange(offsets[-1]), offsets[:-1])] = chars.flatten().to_numpy()
    sums = steps.cumsum()
    sums -= np.repeat(sums[offsets[:-1]], n_turns + 1)
    made = pa.table(
        {
            "block": pa.array(np.full(len(rank), block)),
            "rank": pa.array(rank),
            "conv_id": group["conv_id"],
            "n_turns": pa.array(n_turns),
            "lcp": pa.array(before),
            "is_leaf": pa.array(after < n_turns),
            "sums": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums)),
        }
    )
    return made.filter(pa.array(rank // size == block))


PARTS = (
    "node bigint, depth bigint, parent bigint, first_rank bigint, n_convs bigint, conv_id bigint, "
    "n_leaves bigint, n_ends bigint, saved_tokens bigint"
)


def _names(
    block: int, rank: np.ndarray, lcp: np.ndarray, row: np.ndarray, depth: np.ndarray, minima: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Name of the node of each candidate (row, depth), and its left end in the block, -1 if before.

    Even names are twice a rank, for nodes that end within the block they begin in; odd ones
    tell the block that has the left end.
    """
    levels, outer = sparse_table(lcp), sparse_table(minima)
    left, right = left_end(levels, row, depth), right_end(levels, row, depth)
    far = left_end(outer, np.full(len(row), block - 1), depth)
    return np.where(left < 0, 2 * far + 1, np.where(right < len(lcp), 2 * rank[left], 2 * block + 1)), left


def _parts(block: int, group: pa.Table, minima: np.ndarray) -> pa.Table:
    """What a block's conversations add to each prefix they begin with.

    A member saves the characters it shares with the one before it, as far as these
    belong to the subtree; that is each node's text for all its members but one.
    """
    group = group.sort_by("rank").combine_chunks()
    rank, lcp, n_turns, conv = (group[c].to_numpy() for c in ("rank", "lcp", "n_turns", "conv_id"))
    leaf = group["is_leaf"].to_numpy()
    sums = group["sums"].combine_chunks().flatten().to_numpy()
    start = (n_turns + 1).cumsum() - (n_turns + 1)
    row = np.repeat(np.arange(len(rank)), n_turns + 1)
    depth = np.arange(len(row)) - start[row]
    name, left = _names(block, rank, lcp, row, depth, minima)
    shared = sums[start[row] + np.maximum(np.maximum(lcp[row], depth - 1), 0)]
    saved = shared - sums[start[row] + np.maximum(depth - 1, 0)]
    parent = np.where(depth > 0, np.r_[-1, name[:-1]], -1)
    order = np.lexsort((depth, name))
    name, depth = name[order], depth[order]
    new = np.flatnonzero(np.r_[True, (np.diff(name) != 0) | (np.diff(depth) != 0)])
    row, left = row[order], left[order]
    return pa.table(
        {
            "node": name[new],
            "depth": depth[new],
            "parent": parent[order][new],
            "first_rank": np.minimum.reduceat(np.where(left < 0, NONE, rank[left]), new),
            "n_convs": np.diff(np.r_[new, len(name)]),
            "conv_id": np.minimum.reduceat(conv[row], new),
            "n_leaves": np.add.reduceat(leaf[row].astype(np.int64), new),
            "n_ends": np.add.reduceat((n_turns[row] == depth).astype(np.int64), new),
            "saved_tokens": np.add.reduceat(saved[order], new),
        }
    )


MEMBERS = "conv_id bigint, rank bigint, node bigint, depth bigint"


def _members(block: int, group: pa.Table, minima: np.ndarray) -> pa.Table:
    """The node that each conversation ends at."""
    group = group.sort_by("rank").combine_chunks()
    rank, lcp, n_turns = (group[c].to_numpy() for c in ("rank", "lcp", "n_turns"))
    name, _ = _names(block, rank, lcp, np.arange(len(rank)), n_turns, minima)
    return pa.table({"conv_id": group["conv_id"], "rank": rank, "node": name, "depth": n_turns})


# --- tables ----------------------------------------------------------------------------------


def sequences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, key, chars`` of each of ``conversations (conv_id)``: its turns' digests and lengths.

    ``turns (conv_id, pos, digest, n_chars)``. A row holds 24 bytes for each turn of its
    conversation, no text.
    """
    turn = F.struct("pos", "digest", "n_chars")
    empty = conversations.select("conv_id", F.lit(None).cast("struct<pos: bigint, digest: binary, n_chars: bigint>").alias("turn"))
    every = turns.select("conv_id", turn.alias("turn")).unionByName(empty)
    grouped = every.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.col("turns.digest").alias("key"), F.col("turns.n_chars").alias("chars"))


def turn_digest() -> list:
    """``digest, n_chars`` of a turn: 16 bytes of its role and text, and the text's code points."""
    name = F.concat(F.length("role"), F.lit(":"), "role", "text")
    return [F.unhex(F.md5(name)).alias("digest"), F.length("text").cast("bigint").alias("n_chars")]


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of ``conversations (conv_id)`` with their ``turns (conv_id, pos, role, text)``.

    Conversation ids are neither null nor repeated, and a conversation's positions are different, as
    ``conversations.in_order`` gives them; null roles and texts have to be filled. One without turns ends at
    the root. Turns are the same if role and text are. Of a node's members the smallest id is ``conv_id``;
    ``n_leaves`` counts the childless nodes of its subtree and ``saved_tokens`` sums over
    the subtree each node's last text in code points, once for every member but one.
    No conversations have no nodes, not even a root. Other columns are ignored.
    """
    rows = sequences(turns.select("conv_id", "pos", *turn_digest()), conversations)
    placed = stage(dense_index(rows, [], [F.col("key"), F.col("conv_id")]), "placed")
    n_rows = placed.count()
    size = max(block, -(-n_rows // MAX_BLOCKS))
    own, last = F.expr(f"idx div {size}"), F.col("idx") % size
    blocks = F.array(own, F.when((last == 0) & (F.col("idx") > 0), own - 1), F.when(last == size - 1, own + 1))
    spread = placed.withColumn("block", F.explode(F.array_compact(blocks)))
    ranks = stage(
        spread.groupBy("block").applyInArrow(lambda k, g: _ranks(k[0].as_py(), g, size), RANKS), "ranks"
    )
    # at most MAX_BLOCKS numbers
    least = {r["block"]: r["least"] for r in ranks.groupBy("block").agg(F.min("lcp").alias("least")).collect()}
    minima = np.array([least[b] for b in range(len(least))], dtype=np.int32)
    found = stage(ranks.groupBy("block").applyInArrow(lambda k, g: _parts(k[0].as_py(), g, minima), PARTS), "parts")
    members = ranks.drop("sums", "is_leaf").groupBy("block").applyInArrow(lambda k, g: _members(k[0].as_py(), g, minima), MEMBERS)
    is_open = F.col("node") % 2 == 1
    least_of, sum_of = ("parent", "first_rank", "conv_id"), ("n_convs", "n_leaves", "n_ends", "saved_tokens")
    joined = found.where(is_open).groupBy("node", "depth").agg(
        *(F.min(c).alias(c) for c in least_of), *(F.sum(c).alias(c) for c in sum_of)
    )
    nodes = stage(found.where(~is_open).unionByName(joined), "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"))
    counted = stage(nodes.join(below.agg(F.count("*").alias("n_children")), ["node", "depth"], "left"), "counted")
    parents = counted.where("n_children > 0").select(
        F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("_n"),
    )
    # the root may be the parent of most nodes
    lower = lookup(counted.where("depth > 0"), parents, ["parent", "depth"], "_n").drop("_n")
    whole = lower.unionByName(counted.where("depth = 0"), allowMissingColumns=True)
    return Trie(
        whole.select(
            "node", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "conv_id", "parent_conv_id",
            "first_rank", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves",
            "n_ends", "saved_tokens",
        ),
        members,
    )
