"""Best-fit packing of tokenised documents into sequences under several capacities.

A piece of a document demands a vector (tokens, one document, attention cost = its
tokens squared) of a sequence, which has capacities for each. Pieces are taken by
falling length; of all sequences with room in every dimension, the one with the least
weighted norm of what would be left (``select="norm"``) or with the greatest weighted
dot product of demand and room (``"dot"``) takes it.
"""

from __future__ import annotations

import json
import math
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.operators.index import dense_index
from kindred.staging import stage

SHARD = 16_384
"""Pieces packed with each other; every piece is in one shard, whatever their number."""


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    select: str = "norm"

    def __post_init__(self) -> None:
        if min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError("capacities must be positive")
        if self.select not in ("norm", "dot"):
            raise ValueError(f"unknown way to select: {self.select}")

    @property
    def piece(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.attention))


class Encoder:
    """Token ids of texts as little-endian 32-bit integers, as ``tokenizers`` gives them for the file.

    A byte-level BPE whose tokens are numbered in the order of their merges is run by
    ``tiktoken``, which merges by the number of the token that comes out: the same ids in
    a third of the time. Any other tokeniser runs as it is. Names of added tokens in a text are these tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.fast = _byte_bpe(config)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [array("I", x.ids).tobytes() for x in encoded]
        return [self.fast.encode_to_numpy(x, allowed_special="all").tobytes() for x in texts]


# fixed values: how a byte-level BPE cuts texts, and the bytes that its vocabulary shows as they are
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_bpe(config: dict) -> tiktoken.Encoding | None:
    """The tokeniser of a file, if it is a plain byte-level BPE."""
    model, cut, added = config["model"], config.get("pre_tokenizer") or {}, config.get("added_tokens") or []
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        and not config.get("normalizer")
        and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    hidden = [b for b in range(256) if b not in SHOWN]
    byte = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}
    names = {t["content"]: t["id"] for t in added}
    tokens = {t: i for t, i in model["vocab"].items() if t not in names}
    merged = [tokens.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    in_order = None not in merged and merged == sorted(merged) and len(merged) == len(tokens) - 256
    if not in_order or not all(c in byte for t in tokens for c in t):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items()}
    return tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=names)


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    longest: int = 1024,
    keep: list[str] | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of ``docs (doc_id, text, …)``.

    A document is its text's ids and ``end_id``; a null text is empty. One longer than
    ``longest`` is cut so that only its first piece is shorter. ``ids`` are the piece's
    tokens as little-endian 32-bit integers. Without ``end_id`` an empty text has no piece.
    The columns ``keep`` come along with each piece.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(keep or []))
    schema = T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long")
    schema = schema.add("length", "long").add("ids", "binary")
    return docs.mapInArrow(
        partial(_pieces, tokenizer=tokenizer, end_id=end_id, longest=longest),
        T.StructType([*schema.fields, *docs.schema.fields[2:]]),
    )


def _pieces(batches, tokenizer: str, end_id: int | None, longest: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer).encode
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            found = encode([x or "" for x in part.column(1).to_pylist()])
            n = (np.fromiter(map(len, found), np.int64, len(found)) + len(end)) // 4
            pieces = -(-n // longest)
            own = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(own)) - np.repeat(pieces.cumsum() - pieces, pieces)
            first = (n - (pieces - 1) * longest)[own]
            start = np.where(piece == 0, 0, first + (piece - 1) * longest)
            length = np.where(piece == 0, first, longest)
            # a batch's ids lie one after another, so pieces are where they are
            offsets = np.r_[0, 4 * length.cumsum()].astype(np.int64)
            ids = pa.Array.from_buffers(
                pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(end.join([*found, b""]))]
            )
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(take), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    ids.cast(pa.binary()), *(c.take(take) for c in part.columns[2:]),
                ],
                ["doc_id", "piece", "start", "length", "ids", *part.schema.names[2:]],
            )


def place(pieces: DataFrame, capacity: Capacity = Capacity(), order: list[Column] | None = None) -> DataFrame:
    """``pieces (length, …)`` with ``sequence_id`` and ``offset``; read more than once: pass a table.

    Pieces that fill a sequence alone are placed without a shuffle. The others are dealt
    into shards of about ``SHARD``, by the position in ``order`` (without ties) so that a
    shard is a stretch of it and numbers of sequences rise along it, else at random.
    """
    spark = pieces.sparkSession
    alone = F.col("length") >= capacity.piece if capacity.documents > 1 else F.lit(True)
    if order is None:
        numbered = pieces.withColumn("_at", F.monotonically_increasing_id())
        n_shards = math.ceil(max(1, numbered.where(~alone).count()) / SHARD)
        numbered = numbered.withColumn("_shard", F.pmod(F.xxhash64("_at"), F.lit(n_shards)))
    else:
        numbered = dense_index(pieces, [], order).withColumnRenamed("idx", "_at").drop("n_rows")
        numbered = numbered.withColumn("_shard", F.floor(F.col("_at") / SHARD).cast("bigint"))
    # odd numbers, next to the even ones of the same stretch if there is an order
    own = F.col("_at") if order is None else F.shiftleft("_shard", 16) + F.col("_at") % SHARD
    whole = numbered.where(alone).select(
        *pieces.columns,
        (2 * own + 1).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    rest = numbered.where(~alone).drop("_at")
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return _best_fit(rows, capacity)

    packed = rest.groupBy("_shard").applyInPandas(fit, schema)
    return spark.createDataFrame([], schema).unionByName(whole).unionByName(packed)


def _best_fit(rows: pd.DataFrame, capacity: Capacity) -> pd.DataFrame:
    lengths = rows["length"].to_numpy()
    # ties in an order that does not hang on how rows arrived
    keys = [rows[c].to_numpy() for c in ("piece", "doc_id") if c in rows and not rows[c].isna().any()]
    sequence, offset = best_fit(lengths, capacity, np.lexsort([*keys, -lengths]))
    shard = int(rows["_shard"].iloc[0])
    return rows.drop(columns="_shard").assign(sequence_id=(shard << 17) + 2 * sequence, offset=offset)


def best_fit(lengths: np.ndarray, capacity: Capacity, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: no bin goes beyond a capacity, none is empty."""
    size = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weights = np.array(capacity.weights) / size**2
    order = np.argsort(-lengths, kind="stable") if order is None else order
    least = lengths.min() if len(lengths) else 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.empty((3, 1024))
    number = np.empty(1024, np.int64)  # of the open bins
    n_open = n_bins = 0
    for i in order:
        length = lengths[i]
        demand = np.array([length, 1, length * length], dtype=np.float64)
        left = room[:, :n_open] - demand[:, None]
        if capacity.select == "norm":
            cost = weights @ (left * left)
        else:
            cost = -((weights * demand) @ room[:, :n_open])
        cost[(left < 0).any(axis=0)] = np.inf
        at = int(np.argmin(cost)) if n_open else -1
        if at < 0 or cost[at] == np.inf:
            if n_open == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                number = np.concatenate([number, np.empty_like(number)])
            at, n_open = n_open, n_open + 1
            room[:, at], number[at] = size, n_bins
            n_bins += 1
        bins[i], offsets[i] = number[at], capacity.tokens - int(room[0, at])
        room[:, at] -= demand
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least * least:
            n_open -= 1  # nothing fits in any more
            room[:, at], number[at] = room[:, n_open], number[n_open]
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    capacity: Capacity = Capacity(),
) -> DataFrame:
    """Tokenise and place: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    Null texts are empty documents; null ids and repeated rows are packed like any other
    row; other columns are ignored; an empty table gives an empty result.
    """
    pieces = stage(token_pieces(docs, tokenizer, end_id, capacity.piece), "pieces")
    return place(pieces, capacity)
