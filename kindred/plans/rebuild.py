"""Rebuild jobs: export, vectorise, cluster, store, activate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import keys
from kindred.operators import histogram, imports
from kindred.params import Params
from kindred.plans.textcluster import textcluster
from kindred.plans.vectorize import vectorize
from kindred.schema import KEY
from kindred.sources.store import Store
from kindred.staging import stage, temporary


@dataclass(frozen=True)
class Rebuilt:
    """Documents exported, the number of members in clusters of each size class
    (``histogram.LOG_BOUNDS``) and, if asked for, ``textcluster.pass_metrics`` by pass."""

    exported: int
    size_counts: list[int]
    metrics: dict[str, dict[str, int]] = field(default_factory=dict)


def export_documents(documents: DataFrame, path: str) -> int:
    """Write the documents as they are, without a shuffle; an existing export is
    replaced. Returns the number of rows, which the written footers tell."""
    documents.write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.schema(documents.schema).parquet(path).count()


def _rebuild(
    store: Store, documents: DataFrame, collections: DataFrame, ts: int, run: str, params: Params, metrics: bool
) -> Rebuilt:
    run_dir = f"{store.root}/runs/{ts}/{run}"
    export = f"{run_dir}/export_documents"
    exported = export_documents(documents.select(*KEY, "doc_id", "text"), export)
    texts = store.spark.read.schema(documents.schema).parquet(export)
    with temporary(store.spark):
        vectors = vectorize(texts, params, f"{run_dir}/vectorize").vectors
        done = textcluster(vectors, params)
        store.write_clusters(done.merged, ts, run)
        rows = done.metrics(params).collect() if metrics else []  # one a pass
    store.activate_rebuild(collections, ts, run)
    told = {r["pass"]: {k: v for k, v in r.asDict().items() if k != "pass"} for r in rows}
    return Rebuilt(exported, _size_counts(store, ts, run), told)


def _size_counts(store: Store, ts: int, run: str) -> list[int]:
    members = store.cluster_members([(ts, run)])
    sizes = members.groupBy(*KEY, "label").agg(F.count_if(~F.col("is_medoid")).alias("size"))
    buckets = histogram.histogram(sizes, "size", times="size").orderBy("bucket_idx")
    return [row["count"] for row in buckets.collect()]


def rebuild(
    store: Store, namespace: str, collection_key: str, ts: int, params: Params = Params(), metrics: bool = False
) -> Rebuilt:
    """Rebuild one collection. A step that fails ends it before the activation."""
    name = store.spark.range(1).select(
        F.lit(namespace).alias("namespace"), F.lit(collection_key).alias("collection_key")
    )
    run = name.select(keys.run_id(*[F.col(k) for k in KEY])).first()[0]
    documents = store.scan_documents(namespace, collection_key)
    return _rebuild(store, documents, name, ts, run, params, metrics)


def rebuild_all(store: Store, ts: int, params: Params = Params(), metrics: bool = False) -> Rebuilt:
    """Rebuild every stale collection, all in one plan."""
    stale = stage(imports.stale(store.collections()).select(*KEY), "stale")
    documents = store.documents(stale).select(*KEY, "doc_id", "text")
    return _rebuild(store, documents, stale, ts, "all", params, metrics)
