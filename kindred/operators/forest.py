"""Leader edges to clusters.

Inputs are the scored documents of ``similarity.scored_documents``; a document's
rank is its centricity, the earlier one winning ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.joins import lookup
from kindred.operators.similarity import BLOCK
from kindred.staging import stage


def used(scored: DataFrame) -> DataFrame:
    """Documents with at least one similar partner."""
    return scored.filter(F.col("centricity_nano").isNotNull())


def rest(scored: DataFrame) -> DataFrame:
    """Documents without any similar partner; they get another pass together."""
    return scored.filter(F.col("centricity_nano").isNull())


def _rank(centricity: Column, pos: Column) -> Column:
    return F.struct(centricity, -pos)


def medoid_rank(scored: DataFrame) -> DataFrame:
    """Place of each used document in its block, the least central first."""
    order = Window.partitionBy(*BLOCK).orderBy("centricity_nano", F.desc("pos"))
    return used(scored).withColumn("rank", F.row_number().over(order))


def directed_edges(scored: DataFrame) -> DataFrame:
    """At most one edge per document, from ``pos`` up to the better ranked ``parent_pos``.

    A leader edge that runs downhill is turned around. Where several are turned
    onto one document, the best ranked candidate becomes its parent, in place of
    its own leader; a document whose edge was turned has no parent from it.
    """
    docs = used(scored)
    leaders = docs.select(
        *BLOCK,
        F.col("pos").alias("leader_pos"),
        F.col("centricity_nano").alias("leader_centricity"),
    )
    edges = docs.filter(F.col("leader_pos").isNotNull()).join(leaders, [*BLOCK, "leader_pos"])
    own = _rank(F.col("centricity_nano"), F.col("pos"))
    up = _rank(F.col("leader_centricity"), F.col("leader_pos")) > own
    turned = F.struct(
        (~up).alias("turned"), F.col("centricity_nano").alias("c"), (-F.col("pos")).alias("p")
    )
    return (
        edges.select(
            *BLOCK,
            F.when(up, F.col("pos")).otherwise(F.col("leader_pos")).alias("child"),
            F.when(up, F.col("leader_pos")).otherwise(F.col("pos")).alias("parent"),
            "leader_nano",
            turned.alias("claim"),
        )
        .groupBy(*BLOCK, F.col("child").alias("pos"))
        .agg(F.max_by(F.struct("parent", "leader_nano"), "claim").alias("won"))
        .select(
            *BLOCK,
            "pos",
            F.col("won.parent").alias("parent_pos"),
            F.col("won.leader_nano").alias("parent_nano"),
        )
    )


def assign_medoids(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """Follow the edges to the root: adds the medoid's position, id and centricity.

    Documents outside any cluster get nulls. One group is one block, so at most
    ``Params.block_size`` rows of ids; the vectors are not part of it.
    """
    rows = scored.join(edges, [*BLOCK, "pos"], "left")
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("medoid_pos", T.IntegerType()),
            T.StructField("medoid_id", scored.schema["doc_id"].dataType),
            T.StructField("medoid_centricity", T.LongType()),
            T.StructField("is_inner", T.BooleanType()),
        ]
    )

    def follow(group: pa.Table) -> pa.Table:
        pos = group["pos"].to_numpy()
        parent_pos = group["parent_pos"].to_numpy(zero_copy_only=False)
        has_parent = group["parent_pos"].is_valid().to_numpy()
        order = pos.argsort()
        root = np.arange(len(pos))
        at = np.searchsorted(pos[order], parent_pos[has_parent].astype(pos.dtype))
        root[has_parent] = order[at]
        has_child = np.zeros(len(pos), bool)
        has_child[root[has_parent]] = True
        while not np.array_equal(root[root], root):
            root = root[root]
        outside = ~(has_parent | has_child)
        medoid = pa.array(root, mask=outside)
        for name, source in (
            ("medoid_pos", "pos"),
            ("medoid_id", "doc_id"),
            ("medoid_centricity", "centricity_nano"),
        ):
            group = group.append_column(name, group[source].take(medoid))
        return group.append_column("is_inner", pa.array(has_parent & has_child))

    return rows.groupBy(*BLOCK).applyInArrow(follow, schema)


def roots(edges: DataFrame) -> DataFrame:
    """``pos, root_pos`` of every document on an edge, for blocks of any size.

    Rounds of pointer doubling over staged tables: every pointer goes on to where its
    target points, so as many rounds do as the deepest chain has binary digits, and one
    more that finds nothing to move. Targets with many followers are looked up as hot keys:
    no round gathers a cluster or a block in one task. Edges go up in rank, so
    there are no cycles.
    """
    at = edges.select(*BLOCK, "pos", F.col("parent_pos").alias("root_pos"))
    tops = edges.select(*BLOCK, F.col("parent_pos").alias("pos")).distinct().join(at, [*BLOCK, "pos"], "left_anti")
    pointers = stage(at.unionByName(tops.withColumn("root_pos", F.col("pos"))), "pointers")
    while True:
        target = pointers.select(*BLOCK, F.col("pos").alias("root_pos"), F.col("root_pos").alias("next_pos"))
        hops = stage(lookup(pointers, target, [*BLOCK, "root_pos"]), "hops")
        if hops.where("next_pos <> root_pos").isEmpty():
            return pointers
        pointers = hops.select(*BLOCK, "pos", F.col("next_pos").alias("root_pos"))


def assign_medoids_in_rounds(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``assign_medoids``, without a group per block: see ``roots``."""
    medoids = scored.select(
        *BLOCK, F.col("pos").alias("root_pos"), F.col("doc_id").alias("medoid_id"),
        F.col("centricity_nano").alias("medoid_centricity"),
    )
    at = roots(edges)
    heads = stage(medoids.join(at.where("pos = root_pos").select(*BLOCK, "root_pos"), [*BLOCK, "root_pos"]), "medoids")
    clustered = lookup(at, heads, [*BLOCK, "root_pos"]).withColumnRenamed("root_pos", "medoid_pos")
    followed = edges.select(*BLOCK, F.col("parent_pos").alias("pos"), F.lit(True).alias("_followed")).distinct()
    rows = scored.join(edges, [*BLOCK, "pos"], "left").join(clustered, [*BLOCK, "pos"], "left")
    is_inner = F.col("parent_pos").isNotNull() & F.col("_followed").isNotNull()
    return rows.join(followed, [*BLOCK, "pos"], "left").withColumn("is_inner", is_inner).drop("_followed")


def cluster_pass(scored: DataFrame, in_rounds: bool = False) -> DataFrame:
    """All documents of the blocks, with parent and medoid where they have one.

    ``in_rounds`` follows the edges across tasks, for blocks whose ids are too many for one.
    """
    if not in_rounds:
        return stage(assign_medoids(scored, directed_edges(scored)), "assigned")
    edges = stage(directed_edges(scored), "edges")
    return stage(assign_medoids_in_rounds(scored, edges), "assigned")


def members(assigned: DataFrame) -> DataFrame:
    """Documents in a cluster, the medoid included with similarity 1."""
    is_medoid = F.col("pos") == F.col("medoid_pos")
    return assigned.filter(F.col("medoid_pos").isNotNull()).select(
        *BLOCK,
        "medoid_pos",
        "medoid_id",
        "medoid_centricity",
        "pos",
        "doc_id",
        F.when(is_medoid, F.lit(1.0))
        .otherwise(F.col("parent_nano") / F.lit(1e9))
        .alias("similarity"),
        is_medoid.alias("is_medoid"),
    )


def unassigned(assigned: DataFrame) -> DataFrame:
    """Documents in no cluster and why: no partner at all, or their edge was turned
    around and lost to a better candidate."""
    reason = F.when(F.col("centricity_nano").isNull(), "rest").otherwise("outranked")
    return assigned.filter(F.col("medoid_pos").isNull()).select(
        *BLOCK, "doc_id", reason.alias("reason")
    )


def splices(assigned: DataFrame) -> DataFrame:
    """Per block, how often a document with followers joined another one."""
    return assigned.groupBy(*BLOCK).agg(
        F.sum(F.col("is_inner").cast("bigint")).alias("splices")
    )
