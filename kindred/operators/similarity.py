"""Similar pairs within blocks of a collection.

A block is ``Params.block_size`` consecutive documents; only documents of one
block are compared, so the work grows with the number of documents, not its
square. Without a size a block is a whole collection, and the work does grow so. Within a block the inverted-index self join is done tile against tile:
Spark ships each pair of panels, runs of tiles, to one task, which sums the weight
products in place and gives back only what passes the threshold. A join on the term would
shuffle a row for each term of each pair instead. A vector is shipped once for every
panel of its block, so panels are as large as a task may hold, however small the tiles are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import tiles
from kindred.functions.compact import COMPACT
from kindred.operators import vectors
from kindred.operators.index import dense_index
from kindred.params import Params, to_nano
from kindred.schema import KEY
from kindred.staging import stage

BLOCK = [*KEY, "block_id"]

MAX_BROADCAST_ROWS = 100_000
WHOLE = 2**62
"""More documents than a collection has."""
PANEL_TERMS = 20_000_000
"""Terms that a panel's tiles may have."""
PANEL_TILES = 4_096
"""Tiles to a panel where the tiles themselves are compared: the square is what a task gives back."""
CHUNK = 256
"""Positions whose tiles are told by one row, and rows of a file whose positions are."""
MAX_BROADCAST_PLACES = 32_768
"""Lists of positions that are broadcast, of 10 bytes a document: 84 MB."""


def assign_blocks(
    docs: DataFrame, order: list[Column], params: Params = Params()
) -> DataFrame:
    """Vectors with ``block_id``, ``pos`` within the block, ``block_docs``, ``tile`` and ``n_tiles``.

    ``terms`` are numbers from here on. Vectors stay in the files that hold them (see ``vectors.stored``): only
    ids and lengths are sorted, and what comes back to the vectors are lists of numbers by file. Blocks
    and tiles come from small tables beside them.
    """
    size = params.block_size
    read = vectors.stored(vectors.coded(vectors.eligible(docs, params)))
    ids = read.withColumn("n_terms", vectors.n_terms(read)).drop("terms", "weights", COMPACT)
    numbered = dense_index(ids, KEY, order)
    # not a plain 0 where blocks have no size: the optimizer drops constants from groupings, but not from the spread
    block = F.expr(f"idx div {size or WHOLE}")
    at = (F.col("idx") - block * (size or 0)).cast("int")
    cuts = stage(tile_cuts(numbered.withColumn("block_id", block).withColumn("pos", at), params), "cuts")
    begun = F.size(F.filter("firsts", lambda first: first <= F.col("pos")))
    few = cuts.count() <= MAX_BROADCAST_ROWS
    places = stage(_places(numbered), "places")
    few_places = places.count() <= MAX_BROADCAST_PLACES
    found = F.get("numbers", F.array_position("rows", F.col("_row")).cast("int") - 1)
    tiled = (
        read.select("*", *_place())
        .join(F.broadcast(places) if few_places else places, ["_file", "_part"])
        .withColumn("idx", found)
        .where("idx IS NOT NULL")
        .drop("_file", "_part", "_row", "rows", "numbers")
        .withColumn("block_id", block)
        .withColumn("pos", at)
        .withColumn("chunk", F.expr(f"pos div {CHUNK}"))
        .join(F.broadcast(cuts) if few else cuts, [*BLOCK, "chunk"])
        .withColumn("tile", F.col("first_tile") + begun)
        .drop("idx", "chunk", "first_tile", "firsts")
    )
    return tiled if few and few_places else stage(tiled, "blocked")


def _place() -> list[Column]:
    """Where a stored row is: file, part of ``CHUNK`` rows and row of the part."""
    row = F.col(f"{vectors.STORED}.row")
    return [
        F.col(f"{vectors.STORED}.file").alias("_file"),
        F.expr(f"{vectors.STORED}.row div {CHUNK}").alias("_part"),
        (row % CHUNK).cast("smallint").alias("_row"),
    ]


def _places(numbered: DataFrame) -> DataFrame:
    """``rows`` and their ``numbers``, a list for each part of a file."""
    lists = numbered.select("idx", *_place()).groupBy("_file", "_part")
    rows = lists.agg(F.collect_list(F.struct("_row", "idx")).alias("entries"))
    return rows.select("_file", "_part", F.col("entries._row").alias("rows"), F.col("entries.idx").alias("numbers"))


def tile_cuts(blocked: DataFrame, params: Params) -> DataFrame:
    """Where tiles begin, cut at running sums of terms.

    A row per ``CHUNK`` positions of a block: ``first_tile``, the tile of the first of them, ``firsts``, at which
    of the others a tile begins, ``n_tiles`` and ``block_docs`` of the block. A document counts as its terms, but as no less than a
    tile's share of ``Params.tile_docs`` and no more than a whole tile. So a tile has at most ``tile_docs`` documents, and
    at most ``tile_terms`` terms without the last of them, however their lengths are mixed. Only lengths
    are brought together, of one chunk at a time; of a block, a sum per chunk.
    """
    least = -(-params.tile_terms // params.tile_docs)
    cost = F.least(F.greatest(F.col("n_terms"), F.lit(least)), F.lit(params.tile_terms)).cast("bigint")
    chunk = F.expr(f"pos div {CHUNK}").alias("chunk")
    costs = blocked.select(*BLOCK, chunk, "pos", cost.alias("cost"))
    of_block = Window.partitionBy(*BLOCK)
    earlier = of_block.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        costs.groupBy(*BLOCK, "chunk")
        .agg(F.sum("cost").alias("total"), F.max("pos").alias("last"), F.max_by("cost", "pos").alias("last_cost"))
        .withColumn("begun", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
        .withColumn("last_tile", F.expr(f"(begun + total - last_cost) div {params.tile_terms}").cast("int"))
        .select(
            *BLOCK,
            "chunk",
            "begun",
            (F.max("last_tile").over(of_block) + 1).alias("n_tiles"),
            (F.max("last").over(of_block) + 1).alias("block_docs"),
        )
    )
    in_order = Window.partitionBy(*BLOCK, "chunk").orderBy("pos")
    before = F.sum("cost").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # no document counts as more than a tile, so there is no number without a tile
    return (
        costs.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(sums, [*BLOCK, "chunk"])
        .withColumn("tile", F.expr(f"(begun + before) div {params.tile_terms}").cast("int"))
        .withColumn("begins", F.col("tile") != F.lag("tile").over(in_order))
        .groupBy(*BLOCK, "chunk", "n_tiles", "block_docs")
        .agg(F.min("tile").alias("first_tile"), F.collect_list(F.when(F.col("begins"), F.col("pos"))).alias("firsts"))
    )


def at_positions(blocked: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors of the documents ``docs (…, pos)`` of the blocks.

    What is brought to the vectors are lists of positions, so that the vectors themselves stay where they are.
    """
    chunk = F.expr(f"pos div {CHUNK}")
    lists = stage(
        docs.groupBy(*BLOCK, chunk.alias("chunk")).agg(F.collect_set("pos").alias("picked")), "positions"
    )
    few = lists.count() <= MAX_BROADCAST_ROWS
    met = blocked.withColumn("chunk", chunk).join(F.broadcast(lists) if few else lists, [*BLOCK, "chunk"])
    return met.where(F.array_contains("picked", F.col("pos"))).drop("chunk", "picked")


def tile_bounds(blocked: DataFrame) -> DataFrame:
    """``low, high, bound`` for each two tiles of a block: no similarity between them is larger.

    The sum over their common terms of the products of the greatest weights that a document
    of either has. Vectors are brought together as bytes, or else the tiles' terms with these weights.
    """
    cut = blocked.where("n_tiles > 1")
    if COMPACT in blocked.columns:
        # vectors as bytes are a fraction of their tiles' terms and weights: tasks make these themselves
        rows, firsts = cut, cut.where("pos = 0")
        lengths = rows.groupBy(*BLOCK, "tile").agg(F.sum(vectors.n_terms(rows)).alias("n_terms"))
    else:
        rows = _greatest_weights(cut)
        firsts, lengths = rows.where("tile = 0"), rows.select(F.size("terms").alias("n_terms"))
    longest = lengths.agg(F.max("n_terms")).first()[0] or 1
    size = max(1, min(PANEL_TILES, PANEL_TERMS // longest))
    pairs = _spread(rows, size)
    n_tasks = _tasks(firsts, size)

    def bound(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        *block, first, last = key
        low, high, found = tiles.bounds_of_panels(group, first.as_py(), last.as_py())
        columns = {name: pa.repeat(value, len(low)) for name, value in zip(BLOCK, block)}
        # a tile without terms is in no pair
        at = np.full(high[-1] - high[0] + 1, -1)
        at[high - high[0]] = np.arange(len(high))
        whole, missing = found[:, at], np.broadcast_to(at < 0, (len(low), len(at)))
        offsets = pa.array(np.arange(len(low) + 1) * len(at), pa.int32())
        listed = pa.ListArray.from_arrays(offsets, pa.array(whole.ravel(), mask=missing.ravel()))
        first = pa.repeat(pa.scalar(int(high[0]), pa.int32()), len(low))
        return pa.table({**columns, "low": low, "first": first, "bounds": listed})

    group_key = [*BLOCK, "low", "high"]
    keys = "namespace string, collection_key string, block_id bigint"
    found = pairs.repartition(n_tasks, *group_key).groupBy(*group_key)
    rows = found.applyInArrow(bound, f"{keys}, low int, first int, bounds array<double>")
    return (
        rows.select(*BLOCK, "low", "first", F.posexplode("bounds").alias("at", "bound"))
        .select(*BLOCK, "low", (F.col("first") + F.col("at")).alias("high"), "bound")
        .where("low < high AND bound IS NOT NULL")
    )


def _greatest_weights(blocked: DataFrame) -> DataFrame:
    """A row per tile with its terms and the greatest weight of each, as if it were a document."""
    entry = F.inline(F.arrays_zip("terms", F.transform("weights", F.abs).alias("weights")))
    n = int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # vectors are brought together by tile before they are taken apart: both groupings take no further exchange
    top = (
        blocked.select(*BLOCK, "tile", "n_tiles", "terms", "weights")
        .repartition(n, *BLOCK, "tile")
        .select(*BLOCK, "tile", "n_tiles", entry)
        .groupBy(*BLOCK, "tile", "n_tiles", "terms")
        .agg(F.max("weights").alias("top"))
        .groupBy(*BLOCK, "tile", "n_tiles")
        .agg(F.collect_list("terms").alias("terms"), F.collect_list("top").alias("weights"))
    )
    return stage(top, "tops").withColumn("pos", F.col("tile"))


def skipped_tiles(blocked: DataFrame, params: Params = Params()) -> DataFrame:
    """Pairs of tiles that have no similar documents, told by their bound."""
    # sums differ in their last digits with the order of terms
    return tile_bounds(blocked).where(F.col("bound") * F.lit(1e9) < to_nano(params.min_similarity) - 1)


def _spread(rows: DataFrame, size: int) -> DataFrame:
    """Each row once for every panel of ``size`` tiles in its block, with the pair of panels it is for."""
    numbered = rows.withColumn("panel", F.expr(f"CAST(tile div {size} AS INT)"))
    others = F.sequence(F.lit(0), F.expr(f"CAST((n_tiles - 1) div {size} AS INT)"))
    spread = numbered.select("*", F.explode(others).alias("other"))
    low, high = F.least("panel", "other").alias("low"), F.greatest("panel", "other").alias("high")
    vector = [COMPACT] if COMPACT in rows.columns else ["terms", "weights"]
    return spread.select(*BLOCK, low, high, "panel", "tile", "pos", *vector)


def _panels(blocked: DataFrame) -> int:
    """Tiles to a panel: as many as a task may hold, fewer if that leaves cores idle.

    No block is cut into more than four panels for the sake of cores.
    """
    blocks = blocked.filter(F.col("pos") == 0).groupBy("n_tiles").agg(F.count("*").alias("blocks")).collect()
    most = max((row["n_tiles"] for row in blocks), default=1)
    # terms that tiles have, not those they may have: small tiles are cut by documents
    lengths = blocked.groupBy(*BLOCK, "tile").agg(F.sum(vectors.n_terms(blocked)).alias("n_terms"))
    longest = lengths.agg(F.max("n_terms")).first()[0] or 1
    size = max(1, min(most, PANEL_TERMS // longest))
    wanted = 2 * blocked.sparkSession.sparkContext.defaultParallelism

    def groups() -> int:
        sides = ((-(-row["n_tiles"] // size), row["blocks"]) for row in blocks)
        return sum(blocks * side * (side + 1) // 2 for side, blocks in sides)

    while size > 1 and -(-most // size) < 4 and groups() < wanted:
        size = -(-size // 2)
    return size


def _tasks(firsts: DataFrame, size: int) -> int:
    """Shuffle partitions for pairs of panels of ``size`` tiles, whose CPU cost the planner cannot see;
    ``firsts`` has a row per block."""
    side = F.expr(f"(n_tiles - 1) div {size} + 1")
    groups = firsts.agg(F.sum(side * (side + 1) / 2)).first()[0] or 1
    usual = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(1, min(3 * groups, max(4 * usual, groups // 8))))


def _score(
    blocked: DataFrame, params: Params, kernel: Callable[..., dict[str, np.ndarray]], columns: str
) -> DataFrame:
    group_key = [*BLOCK, "low", "high"]
    min_nano = to_nano(params.min_similarity)

    def score(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        *block, low, high = key
        lefts, rights, n_terms = tiles.read_panels(group, low.as_py(), high.as_py())
        found = kernel(lefts, rights, n_terms, min_nano)
        n = len(next(iter(found.values())))
        constant = {name: pa.repeat(value, n) for name, value in zip([*BLOCK, "low"], [*block, low])}
        made = {**constant, **{k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in found.items()}}
        return pa.table({name: made[name] for name in names})

    keys = "namespace string, collection_key string, block_id bigint, low int"
    names = [*BLOCK, "low", *(c.split()[0] for c in columns.split(", "))]
    size = _panels(blocked)
    n_tasks = _tasks(blocked.filter(F.col("pos") == 0), size)
    pairs = _spread(blocked, size)
    return pairs.repartition(n_tasks, *group_key).groupBy(*group_key).applyInArrow(score, f"{keys}, {columns}")


def similar_pairs(blocked: DataFrame, params: Params = Params()) -> DataFrame:
    """All pairs ``a < b`` (positions) of a block with at least the minimum similarity."""
    return _score(blocked, params, tiles.pairs_of_panels, "a int, b int, sim_nano bigint").drop("low")


def document_scores(blocked: DataFrame, params: Params = Params()) -> DataFrame:
    """Centricity and leader of each document that has a similar partner.

    Sums up inside the tile tasks, so that the pairs, quadratic in the block size,
    are never shuffled: one row per document and pair of panels is.

    * centricity: sum of the similarities of all pairs the document is in;
    * leader: among similar earlier documents the most similar one (the last of
      these on ties) if it reaches the reassign threshold, else the first one.
    """
    partial = _score(
        blocked,
        params,
        tiles.scores_of_panels,
        "pos int, centricity_nano bigint, best_nano bigint, best_pos int, first_nano bigint, first_pos int",
    )
    totals = partial.groupBy(*BLOCK, "pos").agg(
        F.sum("centricity_nano").alias("centricity_nano"),
        F.max(F.struct("best_nano", "best_pos")).alias("best"),
        F.min(F.when(F.col("first_nano") > 0, F.struct("first_pos", "first_nano"))).alias("first"),
    )
    led = F.col("first").isNotNull()
    by_best = F.col("best.best_nano") >= to_nano(params.reassign_similarity)
    return totals.select(
        *BLOCK,
        "pos",
        "centricity_nano",
        F.when(led, F.when(by_best, F.col("best.best_pos")).otherwise(F.col("first.first_pos"))).alias("leader_pos"),
        F.when(led, F.when(by_best, F.col("best.best_nano")).otherwise(F.col("first.first_nano"))).alias("leader_nano"),
    )


def scored_documents(blocked: DataFrame, params: Params = Params()) -> DataFrame:
    """All documents of the blocks with their scores, null for those without a partner."""
    scores = document_scores(blocked, params)
    ids = blocked.drop("terms", "weights", COMPACT, "block_docs", "tile", "n_tiles", vectors.STORED)
    return stage(ids.join(scores, [*BLOCK, "pos"], "left"), "scored")


def reassignments(blocked: DataFrame, params: Params = Params()) -> DataFrame:
    """Per document with a leader, how often a later leader took over from an earlier one.

    One takes over that reaches the reassign threshold and all before it. A panel tells, for
    each document, the values that do so within the panel, as a staircase: how often each
    occurred. Staircases join in the order of panels: of each those steps stay that reach the
    greatest value so far. Exchanged is a row per document and panel, never a pair.
    """
    threshold = to_nano(params.reassign_similarity)
    stairs = _score(
        blocked,
        params,
        partial(tiles.stairs_of_panels, threshold=threshold),
        "b int, first_nano bigint, most_nano bigint, steps array<bigint>, counts array<bigint>",
    )
    earlier = Window.partitionBy(*BLOCK, "b").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.max("most_nano").over(earlier)
    reached = F.aggregate(
        F.arrays_zip("steps", "counts"),
        F.lit(0).cast("bigint"),
        lambda n, x: n + F.when(x["steps"] >= F.coalesce("so_far", F.lit(0)), x["counts"]).otherwise(0),
    )
    # the very first leader takes over from none
    first = (F.col("so_far").isNull() & (F.col("first_nano") >= threshold)).cast("bigint")
    return (
        stairs.withColumn("so_far", so_far)
        .select(*BLOCK, "b", (reached - first).alias("took_over"))
        .groupBy(*BLOCK, "b")
        .agg(F.sum("took_over").alias("reassigned"))
    )
