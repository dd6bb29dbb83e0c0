import duckdb
import pytest
from conftest import SF

import corpus_pipeline
from check import TABLES, TYPES, rows
from kindred.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4": {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
        "sequence_id": "bigint", "offset": "bigint",
    },
    "op5": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    "op9": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10": {
        "page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string",
        "refers_to": "bigint",
    },
    "op12": {
        "doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string",
    },
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    relation = duck.sql(ORACLE[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert types == {f.name: TYPES[f.dataType.simpleString()] for f in result.schema.fields}
    assert rows(result.toPandas()) == rows(relation.df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys() - {"pipeline"}))
def test_query_covers_its_table(spark, name):
    result = QUERIES[name](spark, SF)
    types = dict(result.dtypes)
    for column, kind in COLUMNS.get(name.split("_")[0], {}).items():
        assert types[column] == kind
    tables = {"vec_id": "embeddings", "doc_id": "documents", "conv_id": "conversations"}
    key = next(k for k in tables if k in types)
    source = spark.read.parquet(f"{SF}/{tables[key]}.parquet").select(key).distinct()
    assert result.select(key).distinct().count() == source.count()


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and QUERIES["pipeline"] is corpus_pipeline.run


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, function in corpus_pipeline.STAGES:
        function(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    for table in tables[1:-1]:
        assert table.columns == columns
    before, ruled, single, cut, mixed, packed = tables
    assert 0 < ruled.count() < before.count() and ruled.subtract(before).count() == 0
    assert 0 < single.count() <= ruled.count() and single.subtract(ruled).count() == 0
    assert single.select("text").distinct().count() == single.count()
    assert cut.where("n_chars <> length(text)").count() == 0
    assert cut.join(single.select("doc_id", "n_chars").withColumnRenamed("n_chars", "n"), "doc_id").where("n_chars > n").count() == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, cut.collect()))
    assert packed.select("doc_id").distinct().count() == mixed.count()
    most = packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert most <= 1024


def test_stages_take_documents_with_nulls_and_no_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, good, "en", "src0", 3), (1, good, "en", "src0", 3), (None, good[::-1], None, None, None), (4, None, None, "x", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, function in corpus_pipeline.STAGES:
        function(spark, docs, SF).collect()
        assert function(spark, docs.limit(0), SF).count() == 0
