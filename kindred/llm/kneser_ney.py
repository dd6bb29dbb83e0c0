"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is of bytes (``ORDER`` of them, spaces collapsed), one per language, trained on
trusted texts. Counts, continuation counts, contexts and discounts are tables that grow
with the corpus and are joined by n-gram; none is broadcast or collected. Texts are
taken in chunks, so many rows of a file each; a chunk's distinct n-grams are looked up
once, and their probabilities are shelved by chunk, where the task that reads the texts
again opens them. No text is exchanged, only a row per distinct n-gram of a chunk. A
document is kept if its mean log-perplexity is within a quantile of the trusted ones of
its language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shelf import Shelf, shelve
from kindred.operators.joins import lookup
from kindred.staging import stage

ORDER = 5
CHUNK_ROWS = 8192
HELD = 2 << 20  # n-grams a task holds before it counts them
QUANTILE = 0.995
SLACK = 0.05
NO_LANGUAGE = "und"
SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]+")
BEGIN = b"\x02" * (ORDER - 1)


def grams(text: bytes, head: bytes = b"") -> np.ndarray:
    """The n-gram that ends at each byte of ``text``, the first byte in the highest place.

    ``head`` are the bytes before, as far as there are any.
    """
    raw = np.frombuffer((BEGIN + head)[-len(BEGIN) :] + text, dtype=np.uint8).astype(np.int64)
    code = np.zeros(len(text), dtype=np.int64)
    for k in range(ORDER):
        code = (code << 8) | raw[k : k + len(text)]
    return code


def windows(text: bytes, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The n-grams of a text, about ``size`` at a time."""
    for at in range(0, len(text), size):
        head = text[max(0, at - ORDER + 1) : at]
        yield grams(text[at : at + size], head)


def _texts(batches, trusted: Shelf) -> Iterator[tuple[int, str, bytes, bool]]:
    """``chunk, lang, text, trusted`` of rows ``chunk, at, lang, text``, in their order."""
    now, good = None, frozenset()
    for whole in batches:
        for i in range(0, len(whole), 1024):
            columns = (c.to_pylist() for c in whole.slice(i, 1024).columns)
            for chunk, at, lang, text in zip(*columns):
                if chunk != now:
                    met = trusted.rows(chunk)
                    now, good = chunk, frozenset(() if met is None else met.column("at").to_pylist())
                yield chunk, lang, SPACE.sub(b" ", (text or "").encode()).strip(), at in good


class Tally:
    """Distinct n-grams of a chunk by language, and how often trusted texts have them."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, bool], list[np.ndarray]] = {}
        self.size = 0
        self.every: dict[str, np.ndarray] = {}
        self.trusted: dict[str, pd.Series] = {}

    def add(self, lang: str, text: bytes, trusted: bool) -> None:
        for codes in windows(text):
            self.held.setdefault((lang, trusted), []).append(codes)
            self.size += len(codes)
            if self.size >= HELD:
                self.fold()

    def fold(self) -> None:
        for (lang, trusted), held in self.held.items():
            codes = np.concatenate(held)
            if trusted:
                counts = pd.Series(codes).value_counts(sort=False)
                self.trusted[lang] = self.trusted[lang].add(counts, fill_value=0) if lang in self.trusted else counts
            else:
                self.every[lang] = pd.unique(np.concatenate([self.every.get(lang, codes[:0]), pd.unique(codes)]))
        self.held, self.size = {}, 0

    def batches(self, chunk: int) -> Iterator[pa.RecordBatch]:
        self.fold()
        none = pd.Series(np.zeros(0, np.int64), index=np.zeros(0, np.int64))
        for lang in self.every.keys() | self.trusted.keys():
            trusted = self.trusted.get(lang, none)
            n = trusted.reindex(pd.Index(self.every.get(lang, none.to_numpy())).union(trusted.index), fill_value=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), chunk)),
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32))),
                    pa.array(n.index.to_numpy(np.int64)),
                    pa.array(n.to_numpy().astype(np.int64)),
                ],
                ["chunk", "lang", "gram", "n"],
            )


def _count(batches, trusted: Shelf) -> Iterator[pa.RecordBatch]:
    now, tally = None, Tally()
    for chunk, lang, text, good in _texts(batches, trusted):
        if chunk != now:
            yield from tally.batches(now)
            now, tally = chunk, Tally()
        tally.add(lang, text, good)
    yield from tally.batches(now)


def _by_language(found: pa.Table | None) -> dict[str, tuple[pd.Index, np.ndarray]]:
    """The distinct n-grams of each language and their probabilities; repeats are equal."""
    if found is None:
        return {}
    lang = found.column("lang").combine_chunks().dictionary_encode()
    at, gram, log_p = lang.indices.to_numpy(), found.column("gram").to_numpy(), found.column("log_p").to_numpy()
    out = {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        own = np.flatnonzero(at == i)
        codes, first = np.unique(gram[own], return_index=True)
        out[name] = pd.Index(codes), log_p[own][first].astype(np.float64)
    return out


def _score(batches, trusted: Shelf, found: Shelf) -> Iterator[pa.RecordBatch]:
    now, known = None, {}
    for batch in batches:
        ids, rest = batch.column(0), batch.select(range(1, batch.num_columns))
        out: list[tuple] = []
        for chunk, lang, text, good in _texts([rest], trusted):
            if chunk != now:
                now, known = chunk, _by_language(found.rows(chunk))
            total = 0.0
            for codes in windows(text):
                index, value = known.get(lang, (pd.Index([], dtype=np.int64), np.zeros(0)))
                place = index.get_indexer(codes)
                if (place < 0).any():
                    raise RuntimeError("a text changed between two reads of the documents")
                total -= value[place].sum()
            out.append((lang, good, len(text), total / max(len(text), 1)))
        columns = [*zip(*out)] or [()] * 4
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "lang", "trusted", "n_bytes", "log_perplexity"],
        )


# --- the model -------------------------------------------------------------------------


def _suffix(gram: Column, size: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def discounts(counts: DataFrame) -> DataFrame:
    """``lang, order, d``: the three discounts of ``counts (lang, order, gram, c)``.

    From how many n-grams have a count of 1 to 4; where one of these is missing the
    estimate is undefined and 0.5, 1 and 1.5 stand in.
    """
    met = counts.groupBy("lang", "order").agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    estimate = [
        F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(float(i)))
        for i in (1, 2, 3)
    ]
    defined = reduce(Column.__and__, (F.col(f"n{i}") > 0 for i in range(1, 5)))
    return met.select(
        "lang", "order", F.when(defined, F.array(*estimate)).otherwise(F.array(*map(F.lit, (0.5, 1.0, 1.5)))).alias("d")
    )


def model(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of one model per language from ``counted (lang, gram, n)`` of full length.

    ``(lang, order, gram, share)`` with the discounted share of an n-gram in its context,
    and ``(lang, order, gram, left)`` with the probability a context leaves to the shorter
    one. Orders below the highest count distinct bytes before, not occurrences.
    """
    order = counted.select("lang", F.lit(ORDER).alias("order"), "gram", F.col("n").alias("c"))
    orders = [order]
    for size in range(ORDER - 1, 0, -1):
        order = (
            orders[-1]
            .groupBy("lang", _suffix(F.col("gram"), size).alias("gram"))
            .agg(F.count("*").alias("c"))
            .select("lang", F.lit(size).alias("order"), "gram", "c")
        )
        orders.append(order)
    counts = stage(reduce(DataFrame.unionByName, orders), "counts")
    context = F.shiftright("gram", 8).alias("context")
    contexts = counts.groupBy("lang", "order", context).agg(
        F.sum("c").alias("total"), *(F.count_if(k).alias(f"f{i}") for i, k in enumerate((F.col("c") == 1, F.col("c") == 2, F.col("c") > 2)))
    )
    rates = stage(discounts(counts), "discounts")
    take = F.element_at("d", F.least(F.lit(3), F.col("c")).cast("int"))
    totals = counts.withColumn("context", context).join(
        contexts.select("lang", "order", "context", "total"), ["lang", "order", "context"]
    )
    shares = (
        lookup(totals, rates, ["lang", "order"])
        .select("lang", "order", "gram", (F.greatest(F.col("c") - take, F.lit(0.0)) / F.col("total")).alias("share"))
    )
    left = lookup(contexts, rates, ["lang", "order"]).select(
        "lang", "order", F.col("context").alias("gram"),
        ((F.col("d")[0] * F.col("f0") + F.col("d")[1] * F.col("f1") + F.col("d")[2] * F.col("f2")) / F.col("total")).alias("left"),
    )
    return stage(shares, "shares"), stage(left, "left")


def log_probabilities(wanted: DataFrame, shares: DataFrame, left: DataFrame) -> DataFrame:
    """``wanted (lang, gram)`` with ``log_p``: interpolated over all orders, down to uniform."""
    out, p = wanted, F.lit(1.0 / 256)
    for size in range(1, ORDER + 1):
        one = shares.where(F.col("order") == size).select("lang", F.col("gram").alias("_g"), "share")
        two = left.where(F.col("order") == size).select("lang", F.col("gram").alias("_c"), "left")
        out = (
            out.withColumn("_g", _suffix(F.col("gram"), size))
            .withColumn("_c", F.shiftright("_g", 8))
            .join(one, ["lang", "_g"], "left")
            .join(two, ["lang", "_c"], "left")
            .withColumn("_p", F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * p)
            .select("lang", "gram", F.col("_p"))
        )
        p = F.col("_p")
    return out.select("lang", "gram", F.log("_p").cast("float").alias("log_p"))


def _located(docs: DataFrame) -> DataFrame:
    """``doc_id, chunk, at, lang, text``: where the row lies in its file, on every read.

    A chunk is ``CHUNK_ROWS`` rows of a file, however tasks cut it. Two chunks of the same
    hash share what is looked up, no more. Rows that do not come from parquet files are
    written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select(*(docs[c] for c in ("doc_id", "lang", "text")), place["file_path"].alias("file"), place["row_index"].alias("row"))
    except AnalysisException:
        rows = stage(docs.select("doc_id", "lang", "text"), "documents")
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select(
        "doc_id", F.xxhash64("file", F.floor(F.col("row") / CHUNK_ROWS)).alias("chunk"),
        F.xxhash64("file", "row").alias("at"), F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text",
    )


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """A row for each of ``docs (doc_id, text, lang, …)`` with its perplexity and the verdict.

    ``trusted (doc_id)`` names the documents to train on; null names none. Columns:
    ``doc_id, lang, n_bytes, log_perplexity`` (per byte, rounded to six places),
    ``threshold`` and ``kept``; others are left out. A null language is the language
    ``und``. Texts without words have log-perplexity 0 and are kept; so is a language
    without trusted text, whose threshold is null. Repeated rows stay repeated.
    """
    rows = _located(docs)
    read = rows.select("chunk", "at", "lang", "text")
    names = trusted.select("doc_id").distinct()
    chosen = stage(rows.select("doc_id", "chunk", "at").join(names, "doc_id", "left_semi").select(F.col("chunk").alias("key"), "at"), "trusted")
    chosen = shelve(chosen, chosen.select(F.count_distinct("key")).first()[0])
    met = stage(read.mapInArrow(partial(_count, trusted=chosen), "chunk bigint, lang string, gram bigint, n bigint"), "grams")
    shares, left = model(met.where("n > 0").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    wanted = met.select("lang", "gram").distinct()
    known = stage(log_probabilities(wanted, shares, left), "log_probabilities")
    looked_up = met.select(F.col("chunk").alias("key"), "lang", "gram").join(known, ["lang", "gram"])
    found = shelve(looked_up.select("key", "lang", "gram", "log_p"), met.select(F.count_distinct("chunk")).first()[0])
    scored = stage(
        rows.select("doc_id", *read.columns).mapInArrow(
            partial(_score, trusted=chosen, found=found),
            T.StructType([rows.schema["doc_id"]])
            .add("lang", "string").add("trusted", "boolean").add("n_bytes", "long").add("log_perplexity", "double"),
        ),
        "scored",
    )
    # rounded, so that the exact quantile keeps a bounded number of distinct values
    measured = F.when(F.col("trusted") & (F.col("n_bytes") > 0), F.round("log_perplexity", 4))
    limits = scored.groupBy("lang").agg((F.percentile(measured, F.lit(quantile)) + slack).alias("threshold"))
    return lookup(scored, stage(limits, "limits"), ["lang"]).select(
        "doc_id", "lang", "n_bytes", F.round("log_perplexity", 6).alias("log_perplexity"), "threshold",
        F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"),
    )
