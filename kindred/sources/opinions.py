"""Raw opinion records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.schema import OPINION_FIELDS
from kindred.sources.tsv import SPLIT_BYTES, read_escaped_tsv


def conform(records: DataFrame) -> DataFrame:
    """Records with exactly one field per opinion column, named by position.

    Columns other than ``fields`` are kept.
    """
    others = [c for c in records.columns if c != "fields"]
    named = [F.col("fields")[i].alias(name) for i, name in enumerate(OPINION_FIELDS)]
    return records.filter(F.size("fields") == len(OPINION_FIELDS)).select(*named, *others)


def rejects(records: DataFrame) -> DataFrame:
    """Records that ``conform`` leaves out, with their number of fields."""
    size = F.size("fields")
    return records.filter(size != len(OPINION_FIELDS)).withColumn("n_fields", size)


def read_opinions(
    spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Opinions of files or folders, with ``file`` and ``start`` as their order."""
    return conform(read_escaped_tsv(spark, path, split_bytes))
