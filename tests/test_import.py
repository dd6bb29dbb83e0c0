import os
import shutil

import pytest
from pyspark.sql import functions as F

from kindred.functions.keys import collection_key, document_row_key
from kindred.operators import imports
from kindred.plans.importing import import_opinions
from kindred.schema import OPINION_FIELDS
from kindred.sources.store import Load, Store
from kindred.sources.tsv import write_escaped_tsv
from kindred.streaming.imports import distinct_size_stream, distinct_sizes, import_stream, import_tsv_stream

SCHEMA = ", ".join(f"{f} string" for f in OPINION_FIELDS)


def opinion(**given):
    return tuple(given.get(f, "") for f in OPINION_FIELDS)


@pytest.fixture
def opinions(spark):
    return spark.createDataFrame(
        [
            opinion(id="1", product="firefox", version="4.0b12", platform="mac", type="issue", text="a"),
            opinion(id="2", product="firefox", version="4.0b12", platform="mac", type="praise", text="b"),
            opinion(id="3", product="firefox", type="issue", text=""),
            opinion(id="2", product="firefox", version="4.0b12", platform="mac", type="praise", text="c"),
        ],
        SCHEMA,
    )


def test_template(opinions):
    def key(pattern):
        return opinions.select(collection_key(pattern)).first()[0]

    assert key("$PRODUCT:$VERSION-$PLATFORM-$TYPE") == "firefox:4.0b12-mac-issue"
    assert key("in $PRODUCT!") == "in firefox!"
    for bad in ("$NOPE", "$product", "none", ""):
        with pytest.raises(ValueError):
            collection_key(bad)


def test_row_keys(spark):
    row = spark.range(1).select(
        document_row_key(F.lit("n"), F.lit("c"), F.lit("123"), "reverse_parts")
    )
    assert row.first()[0] == "n/c/321"
    with pytest.raises(ValueError):
        document_row_key(F.lit("n"), F.lit("c"), F.lit("1"), "other")


def test_batch_import(opinions, store):
    patterns = ["$PRODUCT", "$PRODUCT-$TYPE"]
    numbered = opinions.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    counters = import_opinions(numbered, store, "ns", patterns, 100, order=F.col("at"))
    assert counters == {
        "rows_used": 3,
        "rows_discarded": 1,
        "rows_rejected": 0,
        "docs_created": 6,
        "collections_created": 3,
    }
    counted = imports.import_counters(opinions, "ns", patterns).first().asDict()
    assert counted | {"rows_rejected": 0} == counters
    kept = store.counters().drop("load").collect()
    assert [r.asDict() for r in kept] == [counters]
    texts = {
        (r["collection_key"], r["doc_id"]): r["text"] for r in store.documents().collect()
    }
    assert texts == {
        ("firefox", "1"): "a",
        ("firefox", "2"): "c",
        ("firefox-issue", "1"): "a",
        ("firefox-praise", "2"): "c",
    }
    sizes = {r["collection_key"]: r["size"] for r in store.collections().collect()}
    assert sizes == {"firefox": 3, "firefox-issue": 1, "firefox-praise": 2}


def test_size_modes(opinions, store):
    def size():
        return store.collections().filter("collection_key = 'firefox'").first()["size"]

    import_opinions(opinions, store, "ns", ["$PRODUCT"], 100)
    assert size() == 3
    again = Load(200, id="again")
    import_opinions(opinions, store, "ns", ["$PRODUCT"], again, size="running")
    assert size() == 6
    with pytest.raises(ValueError):
        import_opinions(opinions, store, "ns", ["$PRODUCT"], again, size="running")
    import_opinions(opinions, store, "ns", ["$PRODUCT"], again, size="running", replace=True)
    assert size() == 6
    import_opinions(opinions, store, "ns", ["$PRODUCT"], 300, size="distinct")
    assert size() == 2


def test_streams_equal_batch(spark, opinions, store, tmp_path):
    from kindred.sources.store import Store

    patterns = ["$PRODUCT", "$TYPE"]
    unique = opinions.dropDuplicates(["id"])
    import_opinions(unique, store, "ns", patterns, 100)
    unique.repartition(3).write.parquet(str(tmp_path / "in"))
    write_escaped_tsv(unique.repartition(3), str(tmp_path / "tsv"))

    streamed = Store(spark, str(tmp_path / "streamed"))
    stream = (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    import_stream(
        stream, streamed, "ns", patterns, str(tmp_path / "progress"), 100
    ).awaitTermination()

    from_tsv = Store(spark, str(tmp_path / "from_tsv"))
    import_tsv_stream(
        str(tmp_path / "tsv"), from_tsv, "ns", patterns, str(tmp_path / "progress2"), 100,
        max_files=1,
    ).awaitTermination()

    def content(s):
        docs = s.documents().drop("load_seq").collect()
        sizes = s.collections().select("collection_key", "size", "modified_ms").collect()
        return sorted(map(tuple, docs)), sorted(map(tuple, sizes))

    assert content(streamed) == content(store)
    assert content(from_tsv) == content(store)


def test_partial_update_and_stale(spark, store):
    def update(rows, schema, seq):
        key = "namespace string, collection_key string, "
        store.upsert_collections(spark.createDataFrame(rows, key + schema), seq)

    update([("n", "kept", 3, 5)], "size bigint, modified_ms bigint", 1)
    update([("n", "kept", 9)], "modified_ms bigint", 2)
    row = store.collections().first()
    assert (row["size"], row["modified_ms"], row["state"]) == (3, 9, {})

    cases = [(None, None), (5, None), (5, 4), (5, 5), (5, 6)]
    rows = [("m", str(i), m, "DEFAULT", r) for i, (m, r) in enumerate(cases)]
    update(rows, "modified_ms bigint, configuration string, rebuilt_ms bigint", 3)
    found = imports.stale(store.collections().filter("namespace = 'm'"))
    assert sorted(r["collection_key"] for r in found.collect()) == ["1", "2", "3"]

    before = sorted(store.collections().collect())
    store.compact_collections()
    assert sorted(store.collections().collect()) == before
    update([("n", "kept", 4)], "size bigint", 4)
    row = store.collections().filter("namespace = 'n'").first()
    assert (row["size"], row["modified_ms"]) == (4, 9)


def test_loads_and_compaction(spark, store):
    def load(rows, seq):
        docs = spark.createDataFrame(
            [("n/1", *r) for r in rows],
            "namespace string, collection_key string, doc_id string, text string",
        )
        store.upsert_documents(docs, seq)

    def texts():
        return {(r[1], r[2]): r[3] for r in store.documents().collect()}

    assert texts() == {}
    load([("4.0", "1", "old"), ("4.0", "2", "two"), ("", "3", "")], 1)
    load([("4.0", "1", "new")], 2)
    load([("4.0", "1", "new")], 2)
    assert texts() == {("4.0", "1"): "new", ("4.0", "2"): "two"}
    store.compact_documents()
    assert texts() == {("4.0", "1"): "new", ("4.0", "2"): "two"}
    plan = store.scan_documents("n/1", "4.0")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(collection_key,4.0)" in plan
    load([("4.0", "1", "late"), ("4.0", "2", "late")], 0)  # older than what the base has
    load([("4.0", "1", "new")], 2)
    assert texts() == {("4.0", "1"): "new", ("4.0", "2"): "two"}
    store.compact_documents()
    store.remove_folded()
    assert len(store._list(f"{store.root}/documents")) == 1
    load([("4.0", "1", "newest")], 3)
    assert texts() == {("4.0", "1"): "newest", ("4.0", "2"): "two"}
    assert [r[1] for r in store.list_documents("n/1", "4.0").collect()] == ["newest", "two"]


def test_equal_times_have_a_winner_and_nobody_is_overwritten(spark, store):
    def load(text, name):
        docs = spark.createDataFrame(
            [("n", "c", "1", text), ("n", "c", name, text)],
            "namespace string, collection_key string, doc_id string, text string",
        )
        store.upsert_documents(docs, Load(5, id=name))

    load("second", "b")
    load("first", "a")
    assert {r.doc_id: r.text for r in store.documents().collect()} == {"1": "second", "a": "first", "b": "second"}
    with pytest.raises(ValueError):
        load("third", "b")
    with pytest.raises(ValueError):
        Load(5, id="no/slash")


def test_only_listed_collections_are_read_before_texts_meet(spark, store):
    docs = spark.createDataFrame(
        [("n", f"c{i % 5}", str(i), "text") for i in range(40)],
        "namespace string, collection_key string, doc_id string, text string",
    )
    store.upsert_documents(docs, 1)
    store.upsert_documents(docs, 2)
    only = spark.createDataFrame([("n", "c3")], "namespace string, collection_key string")
    found = store.documents(only)
    assert {r.collection_key for r in found.collect()} == {"c3"} and found.count() == 8
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")  # the join is below


def test_a_lost_checkpoint_is_another_stream(spark, opinions, store, tmp_path):
    unique = opinions.dropDuplicates(["id"])
    unique.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name in ("one", "two"):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        import_stream(stream, store, "ns", ["$PRODUCT"], str(tmp_path / name), 100).awaitTermination()
    assert len(store._list(f"{store.root}/documents")) == 2
    assert store.counters().count() == 2


def test_a_stream_goes_on_after_a_crash(spark, opinions, store, tmp_path):
    """Folders that a crash left without their rows, and collections without their counters' turn."""
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    opinions.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(opinions.schema).parquet(source)

    def half_written(path):
        os.makedirs(path)
        open(f"{path}/.part-00000.crc", "w").close()

    half_written(f"{progress}/stream-id")
    import_stream(stream, store, "n", ["$LOCALE"], progress, now_ms=7).awaitTermination()
    counted = store.counters().collect()
    assert len(counted) == 1
    batch = next(p for p in os.listdir(f"{store.root}/load_times") if p.endswith(".0"))

    # the same batch again: begun, neither its time nor its collections were finished
    shutil.rmtree(f"{store.root}/load_times/{batch}")
    half_written(f"{store.root}/load_times/{batch}")
    folder = next(p for p in os.listdir(f"{store.root}/collections") if p.startswith("load="))
    os.remove(f"{store.root}/collections/{folder}/_SUCCESS")
    before = store.documents().count()
    shutil.rmtree(f"{progress}/commits")
    import_stream(stream, store, "n", ["$LOCALE"], progress, now_ms=7).awaitTermination()
    assert store.documents().count() == before
    assert store.counters().collect() == counted
    assert store.collections().agg({"size": "sum"}).first()[0] == counted[0]["docs_created"]


def test_counters_come_before_collections(opinions, store, monkeypatch):
    """A crash at the collections leaves a load that is not finished, with counters."""

    def crash(*_):
        raise RuntimeError("crash")

    load = Load(5, 0, "a")
    with monkeypatch.context() as patch:
        patch.setattr(Store, "upsert_collections", crash)
        with pytest.raises(RuntimeError):
            import_opinions(opinions, store, "n", ["$LOCALE"], load)
    assert not store.finished("collections", load) and store.counters().count() == 1
    found = import_opinions(opinions, store, "n", ["$LOCALE"], load, replace=True)
    assert [r["docs_created"] for r in store.counters().collect()] == [found["docs_created"]]


def test_distinct_sizes_over_batches_and_a_restart(spark, opinions, tmp_path):
    source, sizes, progress = (str(tmp_path / n) for n in ("in", "sizes", "progress"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        distinct_size_stream(stream, "n", ["$PRODUCT", "$TYPE"], sizes, progress).awaitTermination()
        return {r["collection_key"]: r["size"] for r in distinct_sizes(spark, sizes).collect()}

    opinions.coalesce(1).write.mode("append").parquet(source)
    opinions.coalesce(1).write.mode("append").parquet(source)
    assert run() == {"firefox": 2, "issue": 1, "praise": 1}
    new = spark.createDataFrame([opinion(id="9", product="firefox", type="issue", text="x")], SCHEMA)
    opinions.unionByName(new).coalesce(1).write.mode("append").parquet(source)
    assert run() == {"firefox": 3, "issue": 2, "praise": 1}
    # the last batch again: it replaces what it wrote
    commits = sorted((p for p in os.listdir(f"{progress}/commits") if p.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{progress}/commits/{name}")
    assert run() == {"firefox": 3, "issue": 2, "praise": 1}
