"""Column layout of the tables."""

from pyspark.sql import types as T

KEY = ["namespace", "collection_key"]
"""Columns that name a collection; they lead every join and group key."""

OPINION_FIELDS = [
    "id", "timestamp", "type", "product", "version", "platform",
    "locale", "manufacturer", "device", "url", "text",
]

OPINIONS = T.StructType([T.StructField(f, T.StringType()) for f in OPINION_FIELDS])

LOAD_SEQ = "struct<ms: bigint, step: bigint, id: string>"
"""When and by whom something was written; the greatest one is current."""

DOCUMENT_LOADS = (
    f"load_seq {LOAD_SEQ}, namespace string, collection_key string, doc_id string, "
    "text string, copies bigint"
)
"""One row per document and load; the highest ``load_seq`` holds the current text."""

COLLECTION_LOADS = (
    f"load_seq {LOAD_SEQ}, namespace string, collection_key string, size bigint, "
    "modified_ms bigint, configuration string, rebuilt_ms bigint, processed_ms bigint, run string"
)
"""Partial updates; null means "not written by this load"."""

CLUSTER_MEMBERS = (
    "rebuild_ms bigint, run string, namespace string, collection_key string, "
    "label string, doc_id string, similarity double, is_medoid boolean"
)

DEFAULT_CONFIGURATION = "DEFAULT"
