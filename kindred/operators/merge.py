"""Clusters of several passes to one clustering per collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.index import dense_index
from kindred.operators.joins import lookup
from kindred.operators.vectors import long_form
from kindred.params import Params
from kindred.schema import KEY
from kindred.staging import stage


def stage1(block_members: DataFrame, rest_members: DataFrame) -> DataFrame:
    """Clusters of the block pass and of the pass over the rest, in one table."""
    return block_members.withColumn("pass", F.lit(0)).unionByName(
        rest_members.withColumn("pass", F.lit(1))
    )


def list_order() -> list[Column]:
    """Order of the clusters of a collection: pass, block, then the least central
    medoid first and the later one first on ties."""
    return [
        F.asc("pass"),
        F.asc("block_id"),
        F.asc("medoid_centricity"),
        F.desc("medoid_pos"),
    ]


def medoids(clusters: DataFrame) -> DataFrame:
    """Medoids with what places them in the list of clusters."""
    return clusters.filter("is_medoid").select(
        *KEY, "pass", "block_id", "medoid_centricity", "pos", "doc_id"
    )


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Members per cluster, its medoid not counted."""
    return clusters.groupBy(
        *KEY, "pass", "block_id", "medoid_id", "medoid_centricity", "medoid_pos"
    ).agg(F.count_if(~F.col("is_medoid")).alias("size"))


def ranked_clusters(clusters: DataFrame, by: str = "centricity") -> DataFrame:
    """Clusters with their 1-based ``rank`` in the collection's list.

    ``by="centricity"`` is the list order of the passes, ``by="size"`` puts the
    largest first.
    """
    if by not in ("centricity", "size"):
        raise ValueError(f"unknown order: {by}")
    order = list_order() if by == "centricity" else [F.desc("size"), *list_order()]
    numbered = dense_index(cluster_sizes(clusters), KEY, order)
    return numbered.withColumn("rank", F.col("idx") + 1).drop("idx", "n_rows")


def merge_clusters(
    clusters: DataFrame, meta_members: DataFrame, params: Params = Params()
) -> DataFrame:
    """Replace clusters by the meta-clusters that their medoids form.

    A meta-cluster takes over its medoid's members, the other medoids (with their
    similarity in the meta-clustering) and the members of these. Similarities stay
    those to the direct parent. Clusters in no meta-cluster stay as they are; with
    ``drop_unmerged`` they are lost, except where the collection has just one.
    """
    meta = meta_members.select(
        *KEY,
        F.col("doc_id").alias("medoid_id"),
        F.col("medoid_id").alias("meta_id"),
        F.col("similarity").alias("meta_similarity"),
    )
    if params.drop_unmerged:
        # decided at the medoids: members of a collection never meet under its key alone
        heads = clusters.filter("is_medoid").groupBy(*KEY)
        single = heads.agg(F.count("*").alias("heads"), F.min("doc_id").alias("medoid_id"))
        single = single.filter("heads = 1").drop("heads")
        meta = meta.unionByName(single, allowMissingColumns=True)
    joined = clusters.join(meta, [*KEY, "medoid_id"], "inner" if params.drop_unmerged else "left")
    label = F.coalesce("meta_id", "medoid_id")
    substitute = F.col("is_medoid") & (label != F.col("medoid_id"))
    return joined.select(
        *KEY,
        label.alias("label"),
        "doc_id",
        F.when(substitute, F.col("meta_similarity"))
        .otherwise(F.col("similarity"))
        .alias("similarity"),
        (F.col("is_medoid") & ~substitute).alias("is_medoid"),
    )


def similarity_to_medoid(merged: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add ``medoid_similarity``: members compared with their own medoid.

    The stored similarity is that to the direct parent, which the merge may have
    put under another medoid. Only (medoid, member) pairs are computed; a medoid's
    terms are looked up by its members' terms, however many members there are.
    """
    labelled = merged.select(*KEY, "label", "doc_id", "is_medoid")
    # vectors are joined before they are taken apart: the keys do not travel with every term
    terms = stage(long_form(vectors.join(labelled, [*KEY, "doc_id"]), "label", "is_medoid"), "member-terms")
    name = "term_id" if "term_id" in terms.columns else "term"
    size = labelled.groupBy(*KEY, "label").agg(F.count("*").alias("n_members"))
    heads = (
        terms.filter("is_medoid")
        .select(*KEY, "label", name, F.col("weight").alias("medoid_weight"))
        .join(size, [*KEY, "label"])
    )
    shared = lookup(terms, stage(heads, "medoid-terms"), [*KEY, "label", name], "n_members")
    sums = shared.groupBy(*KEY, "label", "doc_id").agg(
        F.sum(F.col("weight") * F.col("medoid_weight")).alias("s")
    )
    similar = F.rint(F.coalesce("s", F.lit(0.0)) * F.lit(1e9)) / F.lit(1e9)
    return merged.join(sums, [*KEY, "label", "doc_id"], "left").select(
        *merged.columns,
        F.when(F.col("is_medoid"), F.lit(1.0)).otherwise(similar).alias("medoid_similarity"),
    )
