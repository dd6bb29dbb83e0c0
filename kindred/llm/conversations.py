"""Conversations: turns in order, whatever the length of a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.index import dense_index

CONVERSATION = ["_conv", "_named"]
"""Key of a conversation without nulls: the id (0 for null) and whether there is one."""


def conversation_key() -> list[Column]:
    named = F.col("conv_id").isNotNull()
    return [F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("_conv"), named.alias("_named")]


def conversation_id() -> Column:
    """The id that ``conversation_key`` was made of."""
    return F.when(F.col("_named"), F.col("_conv")).alias("conv_id")


def in_order(turns: DataFrame, fill: str = "") -> DataFrame:
    """``_conv, _named, pos, n_rows, turn, role, text`` of ``turns (conv_id, turn, role, text, …)``.

    ``pos`` counts a conversation's rows from 0 in the order of turn (null first), role and
    text; rows equal in all of these are alike, so their order does not matter. Null roles
    and texts become ``fill``. Rows of a null ``conv_id`` are one conversation. A
    conversation is numbered by range partitions and never meets in one task. Other columns
    are ignored.
    """
    filled = [F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in ("role", "text")]
    rows = turns.select(*conversation_key(), F.col("turn").cast("bigint").alias("turn"), *filled)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return dense_index(rows, CONVERSATION, order).withColumnRenamed("idx", "pos")


def digests(rows: DataFrame, key: list[str], order: list[str], value: str, glue: str) -> DataFrame:
    """``key, sha256``: of the ``value`` of a key's rows in ``order``, joined with ``glue``.

    A digest is made of one stream, so the rows of a key pass through one task, one by one
    and without being held together.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), "sha256 string"])
    return (
        rows.select(*key, *order, value)
        .repartition(*key)
        .sortWithinPartitions(*key, *order)
        .mapInArrow(partial(_digests, n_keys=len(key), names=[*key, "sha256"], glue=glue.encode()), schema)
    )


def _digests(batches, n_keys: int, names: list[str], glue: bytes) -> Iterator[pa.RecordBatch]:
    open_: tuple | None = None
    digest = hashlib.sha256()
    for batch in batches:
        types = [*batch.schema.types[:n_keys], pa.string()]
        done = []
        values = batch.column(batch.num_columns - 1).to_pylist()
        for key, text in zip(zip(*(c.to_pylist() for c in batch.columns[:n_keys])), values):
            if key == open_:
                digest.update(glue)
            else:
                if open_ is not None:
                    done.append((*open_, digest.hexdigest()))
                open_, digest = key, hashlib.sha256()
            digest.update(text.encode())
        yield _batch(done, types, names)
    if open_ is not None:
        yield _batch([(*open_, digest.hexdigest())], types, names)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
