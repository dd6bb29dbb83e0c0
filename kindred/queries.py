"""Named queries over the test tables, one per operator; see ``kindred.oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import keys
from kindred.operators import collocations as grams
from kindred.operators import forest, histogram, imports, merge, similarity, vectors
from kindred.operators.joins import lookup
from kindred.params import MAX_BLOCK_SIZE, Params
from kindred.plans.importing import import_files, import_opinions
from kindred.plans.rebuild import export_documents, rebuild, rebuild_all
from kindred.plans.textcluster import (
    Clustering,
    Pass,
    block_and_rest,
    run_pass,
    textcluster,
)
from kindred.plans.vectorize import Vectorized, read_dictionary, read_vectors, unpack, vectorize
from kindred.schema import KEY, OPINION_FIELDS
from kindred.sources.opinions import conform, read_opinions, rejects
from kindred.sources.store import Load, Store
from kindred.sources.tsv import write_escaped_tsv
from kindred.staging import shared_dir, stage
from kindred.streaming.imports import (
    distinct_size_stream,
    distinct_sizes,
    import_stream,
    import_tsv_stream,
    running_sizes,
)

NAMESPACE = "demo"
PATTERNS = ["$LOCALE", "$PRODUCT:$LOCALE", "$TYPE-$LOCALE"]
NOW_MS = 1_700_000_000_000
ONE_BLOCK = Params()
WITHOUT_BLOCKS = Params(block_size=MAX_BLOCK_SIZE)
WHOLE = Params(block_size=None)
CLOSE = Params(block_size=None, min_similarity=0.3)
SMALL_BLOCKS = Params(block_size=250)
"""Several blocks per collection, hence a rest pass and a merge worth the name."""


# Inputs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in one collection per language."""
    return table(spark, sf, "documents").select(
        F.lit(NAMESPACE).alias("namespace"), F.col("lang").alias("collection_key"), "doc_id", "text"
    )


def opinions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and conversation turns as opinions; texts marked toxic are withheld."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    texts = table(spark, sf, "documents").join(labels, "doc_id", "left")
    given = {
        "id": F.col("doc_id").cast("string"),
        "type": F.lit("document"),
        "product": F.col("source"),
        "locale": F.col("lang"),
        "text": F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("text")),
    }
    turns = table(spark, sf, "conversations")
    said = {
        "id": F.concat_ws(":", "conv_id", "turn"),
        "type": F.col("role"),
        "product": F.lit("chat"),
        "locale": F.lit("any"),
        "text": F.col("text"),
    }
    return _as_opinions(texts, given).unionByName(_as_opinions(turns, said))


def _as_opinions(df: DataFrame, given: dict) -> DataFrame:
    return df.select(*[given.get(f, F.lit("")).alias(f) for f in OPINION_FIELDS])


def plain_opinions(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as opinions."""
    return _as_opinions(
        table(spark, sf, "documents"),
        {
            "id": F.col("doc_id").cast("string"),
            "type": F.lit("document"),
            "product": F.col("source"),
            "locale": F.col("lang"),
            "text": F.col("text"),
        },
    )


def event_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Events as partial updates of one collection per user; each type of event sets
    other attributes."""

    def when(kind: str, column: str) -> F.Column:
        return F.when(F.col("event_type") == kind, F.col(column))

    of_configuration = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("load_seq"),
        F.lit(NAMESPACE).alias("namespace"),
        F.col("user_id").cast("string").alias("collection_key"),
        F.floor(when("view", "value")).alias("size"),
        when("click", "event_id").alias("modified_ms"),
        F.when(of_configuration, F.lit("DEFAULT")).alias("configuration"),
        when("purchase", "event_id").alias("rebuilt_ms"),
        when("signup", "event_id").alias("processed_ms"),
    )


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


CLAMPED = Params(min_support=1, min_df=2_000, max_df_percent=100.0, min_df_mode="clamp")


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as documents, by role."""
    return table(spark, sf, "conversations").select(
        F.col("role").alias("collection_key"), F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"
    )


def as_opinions(rows: DataFrame) -> DataFrame:
    """Documents as opinions whose locale is their collection."""
    known = {"id": F.col("doc_id").cast("string"), "locale": F.col("collection_key"), "text": F.col("text")}
    return rows.select(*(known.get(f, F.lit("")).alias(f) for f in OPINION_FIELDS))


def stream_into(store: Store, rows: DataFrame, name: str, now_ms: int) -> None:
    source = f"{store.root}/incoming-{name}"
    rows.write.parquet(source)
    schema = ", ".join(f"{f} string" for f in OPINION_FIELDS)
    stream = store.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    import_stream(
        stream, store, name, ["$LOCALE"], f"{store.root}/progress-{name}", now_ms=now_ms
    ).awaitTermination()


def with_sizes(store: Store) -> DataFrame:
    """Documents of a store with what their collection says."""
    state = store.collections().select(*KEY, "size", "modified_ms")
    return store.documents().select(*KEY, "doc_id", "text").join(state, KEY)


def flat_state(collections: DataFrame) -> DataFrame:
    return collections.select(
        *KEY,
        "size",
        "modified_ms",
        imports.state_of("DEFAULT", "rebuilt_ms").alias("rebuilt_ms"),
        imports.state_of("DEFAULT", "processed_ms").alias("processed_ms"),
    )


# Import


def tsv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    write_escaped_tsv(plain_opinions(spark, sf), path)
    return read_opinions(spark, path).select("id", "type", "product", "locale", "text")


def conform_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n").alias("fields")
    return conform(table(spark, sf, "documents").select("doc_id", lines))


def collection_keys(spark: SparkSession, sf: str) -> DataFrame:
    pattern = "$PRODUCT:$VERSION-$TYPE/$LOCALE."
    return opinions(spark, sf).select("id", keys.collection_key(pattern).alias("collection_key"))


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = imports.with_text(opinions(spark, sf))
    return imports.fan_out(rows, NAMESPACE, PATTERNS).select(*KEY, "doc_id", "text")


def collection_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return imports.collection_sizes(fan_out(spark, sf), NOW_MS)


def import_counters(spark: SparkSession, sf: str) -> DataFrame:
    return imports.import_counters(opinions(spark, sf), NAMESPACE, PATTERNS)


def latest_documents(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        F.lit(NAMESPACE).alias("namespace"),
        F.lit("chat").alias("collection_key"),
        F.col("conv_id").alias("doc_id"),
        "turn",
        "text",
    )
    return imports.latest_documents(turns, F.col("turn"))


def imported_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The store after a batch import: its current documents."""
    store = new_store(spark)
    import_opinions(opinions(spark, sf), store, NAMESPACE, PATTERNS, NOW_MS)
    return store.documents().select(*KEY, "doc_id", "text")


def streamed_collections(spark: SparkSession, sf: str) -> DataFrame:
    """The store after a continuous import: its collections."""
    store = new_store(spark)
    source = f"{store.root}/incoming"
    opinions(spark, sf).write.parquet(source)
    schema = ", ".join(f"{f} string" for f in OPINION_FIELDS)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = import_stream(
        stream, store, NAMESPACE, PATTERNS, f"{store.root}/progress", now_ms=NOW_MS
    )
    query.awaitTermination()
    return store.collections().select(*KEY, "size", "modified_ms")


def running_collection_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes that a streaming aggregation arrives at."""
    root = f"{shared_dir(spark)}/sizes-{uuid.uuid4().hex}"
    opinions(spark, sf).write.parquet(f"{root}/incoming")
    schema = ", ".join(f"{f} string" for f in OPINION_FIELDS)
    stream = spark.readStream.schema(schema).parquet(f"{root}/incoming")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/sizes")

    query = (
        running_sizes(stream, NAMESPACE, PATTERNS)
        .writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/sizes")


# Store


def running_distinct_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """All opinions twice in a first run of a stream, some of them once more after a restart."""
    folder = f"{shared_dir(spark)}/distinct-{uuid.uuid4().hex}"
    rows = opinions(spark, sf)
    again = rows.filter("length(id) % 2 = 0").withColumn("text", F.concat("text", F.lit(".")))
    schema = ", ".join(f"{f} string" for f in OPINION_FIELDS)
    for number, more in enumerate(([rows, rows], [again])):
        for i, part in enumerate(more):
            part.write.parquet(f"{folder}/in/part={number}{i}")
        # two batches, of whatever number of files there are
        files = len(spark.read.schema(schema).parquet(f"{folder}/in/part={number}*").inputFiles())
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(2, -(-files // 2)))
        stream = stream.parquet(f"{folder}/in/*")
        distinct_size_stream(
            stream, NAMESPACE, PATTERNS, f"{folder}/sizes", f"{folder}/progress"
        ).awaitTermination()
    return distinct_sizes(spark, f"{folder}/sizes")


def scan_collection(spark: SparkSession, sf: str) -> DataFrame:
    store = new_store(spark)
    store.upsert_documents(documents(spark, sf), NOW_MS)
    return store.scan_documents(NAMESPACE, "en")


def export(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    export_documents(documents(spark, sf), path)
    return spark.read.parquet(path)


def collections_merge(spark: SparkSession, sf: str) -> DataFrame:
    return flat_state(imports.merge_collections(event_loads(spark, sf)))


def collection_state(spark: SparkSession, sf: str) -> DataFrame:
    """Collections read back after one load per type of event."""
    store = new_store(spark)
    loads = event_loads(spark, sf)
    updates = {"view": "size", "click": "modified_ms", "purchase": "rebuilt_ms", "signup": "processed_ms"}
    for step, (kind, column) in enumerate(updates.items()):
        rows = loads.filter(F.col(column).isNotNull())
        last = rows.groupBy(*KEY).agg(F.max_by(column, "load_seq").alias(column))
        if kind in ("purchase", "signup"):
            last = last.withColumn("configuration", F.lit("DEFAULT"))
        store.upsert_collections(last, Load(NOW_MS, step, kind))
        if kind == "click":
            store.compact_collections()
    store.compact_collections()
    store.remove_folded()
    return flat_state(store.collections())


def imports_of_two_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """Two imports at the same time into one store, and one of them tried again."""
    store = new_store(spark)
    for namespace, rows in (("texts", documents(spark, sf)), ("talks", talks(spark, sf))):
        import_opinions(as_opinions(rows), store, namespace, ["$LOCALE"], NOW_MS)
    again = Load(NOW_MS, 1, "again")
    for _ in range(2):
        import_opinions(as_opinions(talks(spark, sf)), store, "talks", ["$LOCALE"], again, size="running", replace=True)
    return with_sizes(store)


def two_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams with checkpoints of their own into one store."""
    store = new_store(spark)
    for name, rows in (("texts", documents(spark, sf)), ("talks", talks(spark, sf))):
        stream_into(store, as_opinions(rows), name, NOW_MS)
    return with_sizes(store)


def stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch, its compaction, and a stream with newer texts of half of the documents."""
    store = new_store(spark)
    rows = as_opinions(documents(spark, sf))
    import_opinions(rows, store, "texts", ["$LOCALE"], NOW_MS)
    store.compact_documents()
    store.compact_collections()
    newer = rows.filter("CAST(id AS BIGINT) % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    stream_into(store, newer, "texts", NOW_MS + 5)
    return with_sizes(store)


def export_counter(spark: SparkSession, sf: str) -> DataFrame:
    """What an export of each collection's table counts."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    n = export_documents(documents(spark, sf), path)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("exported"))


def _files_of_all_lengths(spark: SparkSession, sf: str, folder: str) -> None:
    """Opinions as records of 11 fields, and the same with 10 and with 12."""
    bare = opinions(spark, sf).select(*OPINION_FIELDS)
    write_escaped_tsv(bare, f"{folder}/whole")
    write_escaped_tsv(bare.drop("url"), f"{folder}/short")
    write_escaped_tsv(bare.withColumn("more", F.xxhash64("id").cast("string")), f"{folder}/long")


def import_counters_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that an import of files has stored."""
    store = new_store(spark)
    _files_of_all_lengths(spark, sf, f"{store.root}/incoming")
    folders = [f"{store.root}/incoming/{name}" for name in ("whole", "short", "long")]
    import_files(spark, folders, store, NAMESPACE, PATTERNS, NOW_MS)
    return store.counters().drop("load")


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a continuous import of escaped files with records of 10, 11 and 12 fields."""
    store = new_store(spark)
    _files_of_all_lengths(spark, sf, f"{store.root}/incoming")
    import_tsv_stream(
        f"{store.root}/incoming/*", store, NAMESPACE, PATTERNS, f"{store.root}/progress", now_ms=NOW_MS
    ).awaitTermination()
    sums = ("rows_used", "rows_discarded", "rows_rejected", "docs_created")
    return store.counters().agg(*(F.sum(c).alias(c) for c in sums))


def null_field_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of records with null fields."""
    rows = opinions(spark, sf).withColumn("product", F.when(F.col("product") != "chat", F.col("product")))
    return imports.fan_out(imports.with_text(rows), NAMESPACE, ["$PRODUCT-$LOCALE"]).select(*KEY, "doc_id")


def lookup_hot_and_cold(spark: SparkSession, sf: str) -> DataFrame:
    """A join on long keys of which few are hot."""
    rows = documents(spark, sf).select(F.concat(F.lit("k" * 300), "collection_key").alias("key"), "doc_id")
    some = rows.filter("doc_id % 50 = 0").select(F.concat("key", F.col("doc_id").cast("string")).alias("key"), "doc_id")
    rows = rows.unionByName(some)
    table_ = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    return lookup(rows, table_, ["key"], max_hot_keys=4)


def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    store = new_store(spark)
    store.upsert_documents(documents(spark, sf), NOW_MS)
    return store.list_documents(NAMESPACE, "de")


def rejected_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n").alias("fields")
    found = rejects(table(spark, sf, "documents").select("doc_id", lines))
    return found.select("doc_id", F.col("n_fields").cast("bigint").alias("n_fields"))


def rebuild_twice(spark: SparkSession, sf: str) -> DataFrame:
    """One collection rebuilt by itself and, at the same time, with all others: members count once."""
    store = new_store(spark)
    import_opinions(plain_opinions(spark, sf), store, NAMESPACE, ["$LOCALE"], NOW_MS)
    rebuild(store, NAMESPACE, "en", NOW_MS, SMALL_BLOCKS)
    rebuild_all(store, NOW_MS, SMALL_BLOCKS)
    return store.active_clusters()


def dictionary_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.dictionary(vectors.term_frequency(documents(spark, sf)), CLAMPED)


def tfidf_clamped(spark: SparkSession, sf: str) -> DataFrame:
    terms = stage(vectors.term_frequency(documents(spark, sf)), "tf")
    weighted = vectors.tfidf_weights(terms, stage(vectors.dictionary(terms, CLAMPED), "dictionary"))
    return weighted.select(*KEY, "doc_id", "term", F.round("weight", 6).alias("weight"))


def stale_collections(spark: SparkSession, sf: str) -> DataFrame:
    return flat_state(imports.stale(imports.merge_collections(event_loads(spark, sf))))


def active_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """What is current after an earlier rebuild and a full one."""
    store = new_store(spark)
    opinions_by_language = plain_opinions(spark, sf)
    import_opinions(opinions_by_language, store, NAMESPACE, ["$LOCALE"], NOW_MS)
    everything = store.documents()
    first = everything.groupBy(*KEY).agg(F.min("doc_id").alias("label"))
    earlier = everything.join(first, KEY).select(
        *KEY,
        "label",
        "doc_id",
        F.lit(1.0).alias("similarity"),
        (F.col("doc_id") == F.col("label")).alias("is_medoid"),
    )
    store.write_clusters(earlier, NOW_MS - 1, "all")
    store.activate_rebuild(first, NOW_MS - 1, "all")
    rebuild_all(store, NOW_MS + 1, SMALL_BLOCKS)
    return store.active_clusters()


def storage_keys(spark: SparkSession, sf: str) -> DataFrame:
    ns, ck = F.col("namespace"), F.col("collection_key")
    stamp, label = F.lit(NOW_MS), F.col("doc_id").cast("string")
    columns = [
        keys.collection_row_key(ns, ck).alias("collection"),
        keys.document_prefix(ns, ck).alias("document_prefix"),
    ]
    for scheme in ("simple", "reverse_parts"):
        columns += [
            keys.document_row_key(ns, ck, F.col("doc_id"), scheme).alias(f"document_{scheme}"),
            keys.cluster_row_key(ns, ck, stamp, label, scheme).alias(f"cluster_{scheme}"),
            keys.cluster_prefix(ns, ck, stamp, scheme).alias(f"cluster_prefix_{scheme}"),
        ]
    return documents(spark, sf).select("doc_id", *columns)


def run_slugs(spark: SparkSession, sf: str) -> DataFrame:
    ns, ck = F.col("namespace"), F.col("collection_key")
    return fan_out(spark, sf).select(
        *KEY, keys.run_path("runs", F.lit(NOW_MS), ns, ck, "vectorize").alias("path")
    ).distinct()


# Vectorise


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.tokenize(documents(spark, sf))


def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.term_frequency(documents(spark, sf)).drop("leads")


def _vectorized(spark: SparkSession, sf: str, params: Params = ONE_BLOCK) -> Vectorized:
    return vectorize(documents(spark, sf), params)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    freq = vectors.term_frequency(documents(spark, sf))
    return vectors.dictionary(stage(freq, "tf"))


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    freq = vectors.term_frequency(documents(spark, sf))
    freq = stage(freq, "tf")
    weighted = vectors.tfidf_weights(freq, stage(vectors.dictionary(freq), "dictionary"))
    return weighted.withColumn("weight", F.round("weight", 6))


def tfidf_normalized(spark: SparkSession, sf: str) -> DataFrame:
    made = _vectorized(spark, sf)
    rows = vectors.spelled(vectors.long_form(made.vectors), made.dictionary)
    return rows.select(*KEY, "doc_id", "term", F.round("weight", 6).alias("weight"))


def vectors_exported(spark: SparkSession, sf: str) -> DataFrame:
    """What a run has left, read as sparse vectors and taken apart."""
    run_dir = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    vectorize(documents(spark, sf), ONE_BLOCK, run_dir)
    found = read_vectors(spark, run_dir)
    rows = vectors.spelled(vectors.long_form(unpack(found)), read_dictionary(spark, run_dir))
    return rows.select(*KEY, "doc_id", "term", F.round("weight", 6).alias("weight"))


def eligible_docs(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.eligible(_vectorized(spark, sf).vectors).select(
        *KEY, "doc_id", F.size("term_ids").alias("n_terms")
    )


PHRASES = Params(max_ngram=3, min_support=3, min_df=2, min_llr=20.0)


def _grams(spark: SparkSession, sf: str) -> DataFrame:
    found = grams.gram_frequency(documents(spark, sf), PHRASES.max_ngram)
    return stage(found, "gram-frequency", compression="zstd")


def collocations(spark: SparkSession, sf: str) -> DataFrame:
    found = grams.collocations(_grams(spark, sf), PHRASES)
    return found.select(*KEY, "n", "head", "tail", "count", F.round("llr", 4).alias("llr"))


def term_freq_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of terms and of runs of two and three that go together."""
    counts = vectors.term_frequency(documents(spark, sf))
    return grams.with_collocations(counts, _grams(spark, sf), PHRASES).drop("leads")


def dictionary_with_phrases(spark: SparkSession, sf: str) -> DataFrame:
    found = _vectorized(spark, sf, PHRASES).dictionary
    return found.select(*KEY, "term", "cf", "df", "n_docs")


# Cluster


def _blocked(spark: SparkSession, sf: str, params: Params) -> DataFrame:
    order = [F.col("doc_id")]
    return similarity.assign_blocks(_vectorized(spark, sf).vectors, order, params)


def _scored(spark: SparkSession, sf: str, params: Params = ONE_BLOCK) -> DataFrame:
    return similarity.scored_documents(_blocked(spark, sf, params), params)


def _pass(spark: SparkSession, sf: str, params: Params) -> Pass:
    return run_pass(_vectorized(spark, sf).vectors, "doc_id", params)


def _clustering(spark: SparkSession, sf: str, params: Params = SMALL_BLOCKS) -> Clustering:
    return textcluster(_vectorized(spark, sf).vectors, params)


def _stage1(spark: SparkSession, sf: str) -> DataFrame:
    blocks, rest = block_and_rest(_vectorized(spark, sf).vectors, SMALL_BLOCKS)
    return merge.stage1(blocks.members, rest.members)


def doc_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocked = _blocked(spark, sf, SMALL_BLOCKS)
    return blocked.select(*KEY, "doc_id", "block_id", "pos", "block_docs")


def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_pairs(_blocked(spark, sf, ONE_BLOCK), ONE_BLOCK)


def centricity(spark: SparkSession, sf: str) -> DataFrame:
    return forest.used(_scored(spark, sf, WHOLE)).select(*KEY, "doc_id", "centricity_nano")


def leaders(spark: SparkSession, sf: str) -> DataFrame:
    led = _scored(spark, sf, WHOLE).filter(F.col("leader_pos").isNotNull())
    return led.select(*KEY, "doc_id", "leader_pos", "leader_nano")


def reassignments(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.reassignments(_blocked(spark, sf, ONE_BLOCK), ONE_BLOCK)


CUT = Params(tile_docs=64, tile_terms=500)
"""Many tiles to a block, with documents longer than a tile among others."""


def reassignments_in_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.reassignments(_blocked(spark, sf, CUT), CUT)


def tile_sizes(spark: SparkSession, sf: str) -> DataFrame:
    blocked = _blocked(spark, sf, CUT)
    return blocked.groupBy(*similarity.BLOCK, "tile").agg(
        F.min("pos").alias("first"), F.count("*").alias("n_docs"), F.sum(vectors.n_terms(blocked)).alias("n_terms")
    )


def tile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """All languages in one collection, language after language: tiles of two have little in common."""
    rows = documents(spark, sf)
    name = F.concat_ws("-", "collection_key", "doc_id")
    together = rows.withColumns({"doc_id": name, "collection_key": F.lit("all")})
    vecs = vectorize(together, CUT).vectors
    bounds = similarity.tile_bounds(similarity.assign_blocks(vecs, [F.col("doc_id")], CUT))
    skipped = F.col("bound") < CUT.min_similarity
    return bounds.select(*similarity.BLOCK, "low", "high", F.round("bound", 6).alias("bound"), skipped.alias("skipped"))


def medoid_rank(spark: SparkSession, sf: str) -> DataFrame:
    return forest.medoid_rank(_scored(spark, sf)).select(*KEY, "doc_id", "rank")


def directed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return forest.directed_edges(_scored(spark, sf))


def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of one pass over undivided collections."""
    return _pass(spark, sf, WHOLE).members.select(
        *KEY, F.col("medoid_id").alias("label"), "doc_id", "similarity", "is_medoid"
    )


def clusters_in_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The same with many tiles to a block."""
    return _pass(spark, sf, Params(tile_docs=64)).members.select(
        *KEY, F.col("medoid_id").alias("label"), "doc_id", "similarity", "is_medoid"
    )


def clusters_without_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole collections compared, and the edges followed across tasks."""
    assigned = forest.cluster_pass(_scored(spark, sf, WITHOUT_BLOCKS), in_rounds=True)
    return forest.members(assigned).select(
        *KEY, F.col("medoid_id").alias("label"), "doc_id", "similarity", "is_medoid"
    )


def near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The same at the reassign threshold, where only close texts are grouped."""
    return _pass(spark, sf, CLOSE).members.select(
        *KEY, F.col("medoid_id").alias("label"), "doc_id", "similarity", "is_medoid"
    )


def unassigned(spark: SparkSession, sf: str) -> DataFrame:
    return forest.unassigned(_pass(spark, sf, WHOLE).assigned)


def splices(spark: SparkSession, sf: str) -> DataFrame:
    return forest.splices(_pass(spark, sf, SMALL_BLOCKS).assigned)


def rest_documents(spark: SparkSession, sf: str) -> DataFrame:
    return forest.rest(_scored(spark, sf, SMALL_BLOCKS)).select(*KEY, "block_id", "doc_id")


def rest_clusters(spark: SparkSession, sf: str) -> DataFrame:
    _, rest = block_and_rest(_vectorized(spark, sf).vectors, SMALL_BLOCKS)
    return rest.members.select(*KEY, "medoid_id", "doc_id", "similarity")


def stage1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _stage1(spark, sf).select(
        *KEY, "pass", "block_id", "medoid_id", "doc_id", "similarity", "is_medoid"
    )


def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = merge.cluster_sizes(_stage1(spark, sf))
    return sizes.select(*KEY, "pass", "block_id", "medoid_id", "size")


def clusters_ranked(spark: SparkSession, sf: str) -> DataFrame:
    ranked = merge.ranked_clusters(_stage1(spark, sf))
    return ranked.select(*KEY, "medoid_id", "size", "rank")


def merged_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clustering(spark, sf).merged


def clusters_by_size(spark: SparkSession, sf: str) -> DataFrame:
    ranked = merge.ranked_clusters(_stage1(spark, sf), by="size")
    return ranked.select(*KEY, "medoid_id", "size", "rank")


def medoid_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Members of merged clusters with their similarity to the medoid."""
    vecs = _vectorized(spark, sf).vectors
    merged = textcluster(vecs, SMALL_BLOCKS).merged
    return merge.similarity_to_medoid(merged, vecs)


def rebuild_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the passes of a clustering counted."""
    return _clustering(spark, sf).metrics(SMALL_BLOCKS)


def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that tell merged clusters from all else."""
    made = _vectorized(spark, sf)
    merged = textcluster(made.vectors, SMALL_BLOCKS).merged
    return grams.contrasting_terms(merged, made.vectors, made.dictionary)


def merged_only(spark: SparkSession, sf: str) -> DataFrame:
    """Without the clusters that the merge leaves alone."""
    params = Params(block_size=SMALL_BLOCKS.block_size, drop_unmerged=True)
    return _clustering(spark, sf, params).merged


def cluster_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    sizes = merge.cluster_sizes(_stage1(spark, sf))
    return histogram.histogram(sizes, "size", times="size", by=KEY)


# Histograms

LINEAR = histogram.linear_bounds(5.0, 10.0)
CUSTOM = (1.0, 2.5, 20.0, 50.0)
PRIOR = (4, 0, 2, 1)


def histogram_log(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.histogram(table(spark, sf, "events"), "value", by=["event_type"])


def histogram_linear(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.histogram(table(spark, sf, "events"), "value", bounds=LINEAR)


def histogram_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events weighted by user number, continuing from earlier counts."""
    events = table(spark, sf, "events")
    return histogram.histogram(events, "value", times="user_id", bounds=CUSTOM, prior=PRIOR)


def histogram_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of two tables, added up."""
    values = table(spark, sf, "events").select("value")
    lengths = table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("value"))
    return histogram.merge_histograms(
        histogram.histogram(values, "value"), histogram.histogram(lengths, "value")
    )


def histogram_summary(spark: SparkSession, sf: str) -> DataFrame:
    buckets = histogram.histogram(
        table(spark, sf, "events"), "value", bounds=LINEAR, by=["event_type"]
    )
    return histogram.histogram_summary(buckets, by=["event_type"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tsv_roundtrip,
        conform_rows,
        collection_keys,
        fan_out,
        collection_sizes,
        import_counters,
        import_counters_of_files,
        export_counter,
        latest_documents,
        imported_documents,
        streamed_collections,
        running_collection_sizes,
        running_distinct_sizes,
        scan_collection,
        collections_merge,
        collection_state,
        imports_of_two_namespaces,
        two_streams,
        stream_after_batch,
        stream_counters,
        null_field_keys,
        lookup_hot_and_cold,
        list_documents,
        rejected_records,
        stale_collections,
        active_clusters,
        rebuild_twice,
        storage_keys,
        run_slugs,
        tokens,
        term_freq,
        collocations,
        term_freq_bigrams,
        dictionary_with_phrases,
        dictionary,
        dictionary_clamped,
        tfidf_weights,
        tfidf_clamped,
        tfidf_normalized,
        vectors_exported,
        eligible_docs,
        doc_blocks,
        similar_pairs,
        centricity,
        leaders,
        reassignments,
        reassignments_in_tiles,
        tile_sizes,
        tile_bounds,
        medoid_rank,
        directed_edges,
        cluster_members,
        clusters_in_tiles,
        clusters_without_blocks,
        near_copies,
        unassigned,
        splices,
        rest_documents,
        rest_clusters,
        stage1_clusters,
        cluster_sizes,
        clusters_ranked,
        clusters_by_size,
        merged_clusters,
        merged_only,
        cluster_labels,
        rebuild_metrics,
        medoid_similarities,
        cluster_size_histogram,
        histogram_log,
        histogram_linear,
        histogram_custom,
        histogram_merged,
        histogram_summary,
    )
} | {"export_documents": export}
