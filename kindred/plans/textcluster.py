"""Vectors to clusters, every collection at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.compact import COMPACT
from kindred.operators import forest, merge, similarity
from kindred.operators.similarity import BLOCK
from kindred.operators.vectors import STORED
from kindred.params import Params
from kindred.schema import KEY
from kindred.staging import stage


@dataclass(frozen=True)
class Pass:
    """One clustering pass: the vectors by block and what became of each document."""

    blocked: DataFrame
    assigned: DataFrame

    @property
    def members(self) -> DataFrame:
        return forest.members(self.assigned)

    def vectors_of(self, docs: DataFrame) -> DataFrame:
        """Vectors of some of the pass's documents, given by block and position."""
        picked = similarity.at_positions(self.blocked, docs)
        others = [c for c in (COMPACT, STORED) if c in picked.columns]
        return picked.select(*KEY, "doc_id", F.col("terms").alias("term_ids"), "weights", *others)


def run_pass(vectors: DataFrame, order: str, params: Params) -> Pass:
    blocked = similarity.assign_blocks(vectors, [F.col(order)], params)
    scored = similarity.scored_documents(blocked, params)
    return Pass(blocked, forest.cluster_pass(scored, in_rounds=params.block_size is None))


def pass_metrics(done: Pass, name: str, params: Params) -> DataFrame:
    """``pass, documents, used, splices, reassigned``: one row.

    Documents compared, those with a similar partner, how often a cluster joined
    another one, and how often a later leader took over. The last takes the scoring of
    all tiles once more; nothing of it grows beyond a row per document and tile.
    """
    used = F.col("centricity_nano").isNotNull()
    counts = done.assigned.agg(
        F.count("*").alias("documents"), F.count_if(used).alias("used"),
        F.count_if(F.col("is_inner")).alias("splices"),
    )
    moved = similarity.reassignments(done.blocked, params).agg(F.coalesce(F.sum("reassigned"), F.lit(0)).alias("reassigned"))
    return counts.select(F.lit(name).alias("pass"), "*").crossJoin(moved)


@dataclass(frozen=True)
class Clustering:
    blocks: Pass
    rest: Pass
    clusters: DataFrame
    meta: Pass
    merged: DataFrame

    def metrics(self, params: Params) -> DataFrame:
        """``pass_metrics`` of the three passes; ``params`` are those of the clustering."""
        named = {"blocks": self.blocks, "rest": self.rest, "medoids": self.meta}
        rows = [pass_metrics(done, name, params) for name, done in named.items()]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])


def block_and_rest(vectors: DataFrame, params: Params = Params()) -> tuple[Pass, Pass]:
    """Cluster each block, then together all documents that found no partner."""
    blocks = run_pass(vectors, "doc_id", params)
    leftover = blocks.vectors_of(forest.rest(blocks.assigned))
    return blocks, run_pass(leftover, "doc_id", params)


def textcluster(vectors: DataFrame, params: Params = Params()) -> Clustering:
    """Blocks, rest, then the medoids of both among themselves."""
    blocks, rest = block_and_rest(vectors, params)
    clusters = merge.stage1(blocks.members, rest.members)
    meta = run_pass(_medoid_vectors(clusters, blocks, rest), "place", params)
    merged = merge.merge_clusters(clusters, meta.members, params)
    return Clustering(blocks, rest, clusters, meta, stage(merged, "merged"))


def _medoid_vectors(clusters: DataFrame, *passes: Pass) -> DataFrame:
    """Vectors of all medoids with what places them in the list of clusters."""
    medoids = merge.medoids(clusters)
    parts = [
        similarity.at_positions(each.blocked, medoids.filter(F.col("pass") == number))
        .select(*BLOCK, "pos", "terms", "weights")
        .withColumn("pass", F.lit(number))
        .join(medoids.filter(F.col("pass") == number), [*BLOCK, "pos", "pass"])
        for number, each in enumerate(passes)
    ]
    return parts[0].unionByName(parts[1]).select(
        *KEY,
        "doc_id",
        F.col("terms").alias("term_ids"),
        "weights",
        F.struct(
            F.col("pass"),
            F.col("block_id"),
            F.col("medoid_centricity").alias("centricity"),
            (-F.col("pos")).alias("minus_pos"),
        ).alias("place"),
    )
