"""Documents to vectors, every collection at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import compact, text
from kindred.functions.compact import COMPACT
from kindred.operators import collocations, vectors
from kindred.params import Params
from kindred.schema import KEY
from kindred.staging import stage


@dataclass(frozen=True)
class Vectorized:
    term_freq: DataFrame
    dictionary: DataFrame
    vectors: DataFrame


def vectorize(
    docs: DataFrame,
    params: Params = Params(),
    run_dir: str | None = None,
    analyzer: vectors.Analyzer = text.words,
    stop_words: tuple[str, ...] = text.STOP_WORDS,
) -> Vectorized:
    """Term frequencies, dictionary and TF-IDF vectors, each a stored table.

    With ``Params.max_ngram`` above 1 collocations are terms as well.
    """
    counts = vectors.term_frequency(docs, analyzer, stop_words)
    if params.max_ngram > 1:
        grams = collocations.gram_frequency(docs, params.max_ngram, analyzer, stop_words)
        grams = stage(grams, "gram-frequency", compression="zstd")
        counts = collocations.with_collocations(counts, grams, params)
    term_freq = stage(counts, "tf-vectors", run_dir)
    terms = stage(vectors.number_terms(vectors.dictionary(term_freq, params)), "dictionary", run_dir)
    weighted = vectors.tfidf_weights(term_freq, terms)
    made = stage(pack(vectors.vectors(weighted), terms), "tfidf-vectors", run_dir)
    return Vectorized(term_freq, terms, unpack(vectors.located(made), COMPACT, vectors.STORED))


def pack(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` with ``vector``, laid out as a sparse vector, in place of numbers and weights, and the same as bytes.

    Its size is that of the largest dictionary among the collections of ``terms``. The bytes are what passes exchange.
    """
    size = 1 + (terms.agg(F.max("term_id")).first()[0] or 0)
    entries = [F.col("term_ids").alias("indices"), F.col("weights").alias("values")]
    layout = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), *entries)
    rows = docs.select(*KEY, "doc_id", layout.alias("vector"), "dfs", "tfs", "n_docs", "norm")
    kept = [*KEY, "doc_id", "vector"]

    def add_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = compact.encode(batch["vector"].field("indices"), batch["dfs"], batch["tfs"])
            n_terms = pc.list_value_length(batch["dfs"])
            columns = {"terms": terms, "n_terms": n_terms, "n_docs": batch["n_docs"], "norm": batch["norm"]}
            made = pa.StructArray.from_arrays([*columns.values()], [*columns])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), made], [*kept, COMPACT])

    fields = [*rows.select(*kept).schema, T.StructField(COMPACT, T.StructType.fromDDL(compact.SCHEMA))]
    return rows.mapInArrow(add_bytes, T.StructType(fields))


def unpack(docs: DataFrame, *others: str) -> DataFrame:
    """``term_ids`` and ``weights`` of ``docs (…, vector)``, whichever way the column was read. ``others`` are kept."""
    vector = F.col("vector")
    if isinstance(docs.schema["vector"].dataType, VectorUDT):
        vector = F.unwrap_udt(vector)
    return docs.select(*KEY, "doc_id", vector["indices"].alias("term_ids"), vector["values"].alias("weights"), *others)


def read_vectors(spark: SparkSession, run_dir: str) -> DataFrame:
    """``namespace, collection_key, doc_id, vector`` that an earlier run has left.

    Vectors are stored in the layout of Spark's own sparse vectors and read as such, so
    that its learning algorithms take them as they are. ``read_dictionary`` tells the terms.
    """
    path = f"{run_dir}/tfidf-vectors"
    stored = spark.read.parquet(path).schema
    fields = [T.StructField("vector", VectorUDT()) if f.name == "vector" else f for f in stored if f.name != COMPACT]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_dictionary(spark: SparkSession, run_dir: str) -> DataFrame:
    """The terms of an earlier run with their numbers and counts."""
    return spark.read.parquet(f"{run_dir}/dictionary")
