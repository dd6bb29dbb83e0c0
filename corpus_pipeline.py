"""From raw documents to packed sequences: five operators, each table written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import chunking, mixing, packing, quality, simhash
from kindred.staging import stage

MIX = {"src0": 20, "src1": 15, "src2": 10, "src3": 5}
MIX_OTHERS = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the default policy."""
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; two fingerprints of five-word shingles, five bits apart.

    Five bits estimate a similarity well above 0.8, so what links is alike; see the README
    for how many pairs of 0.8 and more do.
    """
    return simhash.keep_one(docs, shingle=5, radius=5, lanes=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but their first document; so does a text all repeated."""
    cut = chunking.deduplicate(docs)
    changed = F.size("removed") > 0
    left = F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0
    return cut.where(~changed | left).select(
        *(
            F.when(changed, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns
        )
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt out in the order of the mix."""
    return mixing.mix(docs, MIX, MIX_OTHERS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 tokens; each stretch of the mix is packed for itself."""
    import public_tokenizers

    order = ["_file", "_row"]
    if not docs.inputFiles():
        docs = stage(docs, "documents")  # only files have an order
    docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=order)
    digests = stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.place(digests, order=[*map(F.col, order), F.col("piece")]).drop(*order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


ORACLE_SQL = None  # fingerprints, gear hashes and token ids are beyond SQL
