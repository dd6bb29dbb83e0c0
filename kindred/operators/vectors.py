"""Documents to weighted terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text, weights
from kindred.functions.compact import COMPACT
from kindred.operators.index import dense_index
from kindred.operators.joins import lookup
from kindred.params import Params
from kindred.schema import KEY
from kindred.staging import stage

Analyzer = Callable[[Column], Column]

DOCUMENT = "_document"
"""Hash of a document's keys, while its rows are in one task."""

HOT_TERMS = 400_000
"""Terms whose numbers are broadcast, of 48 bytes: 19 MB."""

STORED = "stored_at"
"""File and row of a stored table in which a vector lies."""


def by_document(docs: DataFrame, times: int = 1) -> DataFrame:
    """Rows spread by document; what groups them by ``DOCUMENT`` and more takes no further exchange.

    The keys themselves would not do: the optimizer drops one that is a constant from groupings, but not
    from the spread, and the two no longer match. Texts become many rows after the spread, so small
    partitions are not joined to large ones: there are ``times`` as many as is usual.
    """
    n = times * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.withColumn(DOCUMENT, F.xxhash64(*KEY, "doc_id")).repartition(n, DOCUMENT)


def tokenize(
    docs: DataFrame,
    analyzer: Analyzer = text.words,
    stop_words: tuple[str, ...] = text.STOP_WORDS,
) -> DataFrame:
    """One row per kept term occurrence; ``place`` counts them within the document."""
    terms = text.without(analyzer(F.col("text")), stop_words)
    spread = [DOCUMENT] if DOCUMENT in docs.columns else []
    return docs.select(*KEY, "doc_id", *spread, F.posexplode(terms).alias("place", "term"))


def term_frequency(
    docs: DataFrame,
    analyzer: Analyzer = text.words,
    stop_words: tuple[str, ...] = text.STOP_WORDS,
) -> DataFrame:
    """Count per document and term. ``leads`` is 1 on one row of each document.

    The texts are spread by document first: the counts then need no exchange of
    their own, which would carry the keys with each term, many times the text.
    """
    tokens = tokenize(by_document(docs), analyzer, stop_words)
    counts = tokens.groupBy(*KEY, "doc_id", DOCUMENT, "term").agg(
        F.count("*").alias("tf"),
        F.max((F.col("place") == 0).cast("int")).alias("leads"),
    )
    return counts.drop(DOCUMENT)


def corpus_frequency(term_freq: DataFrame) -> DataFrame:
    """Occurrences ``cf`` and documents ``df`` per term, before any bound."""
    return term_freq.groupBy(*KEY, "term").agg(
        F.sum("tf").alias("cf"), F.count("*").alias("df"), F.sum("leads").alias("leads")
    )


def collection_docs(corpus: DataFrame) -> DataFrame:
    """Documents per collection (those with a term), without a distinct count."""
    return corpus.groupBy(*KEY).agg(
        F.sum("leads").alias("n_docs"), F.count("*").alias("n_terms")
    )


def dictionary(term_freq: DataFrame, params: Params = Params()) -> DataFrame:
    """Terms within the support and document frequency bounds."""
    corpus = stage(corpus_frequency(term_freq), "corpus")
    n_docs = stage(collection_docs(corpus), "collection-docs")
    terms = corpus.drop("leads").filter(F.col("cf") >= params.min_support)
    if params.min_df_mode == "drop":
        terms = terms.filter(F.col("df") >= params.min_df)
    sized = lookup(terms, n_docs, KEY, "n_terms").drop("n_terms")
    sized = sized.filter(100 * F.col("df") / F.col("n_docs") <= params.max_df_percent)
    if params.min_df_mode == "clamp":
        sized = sized.withColumn("df", F.greatest("df", F.lit(params.min_df)))
    return sized


def number_terms(terms: DataFrame) -> DataFrame:
    """Add ``term_id``: each collection's terms counted from 0, the most frequent first."""
    numbered = dense_index(terms, KEY, [F.desc("df"), F.col("term")])
    return numbered.withColumn("term_id", F.col("idx").cast("int")).drop("idx", "n_rows")


def tfidf_weights(term_freq: DataFrame, terms: DataFrame) -> DataFrame:
    """Weight of each dictionary term in each document, long form; with numbers and counts if terms have numbers."""
    numbers = ["term_id"] if "term_id" in terms.columns else []
    known = terms.select(*KEY, "term", "df", "n_docs", *numbers)
    rows = lookup(term_freq.drop("leads"), known, [*KEY, "term"], "df", HOT_TERMS)
    weight = weights.tfidf(F.col("tf"), F.col("df"), F.col("n_docs"))
    counts = [*numbers, "tf", "df", "n_docs"] if numbers else []
    return rows.select(*KEY, "doc_id", "term", *counts, weight.alias("weight"))


def vectors(weighted: DataFrame) -> DataFrame:
    """One row per document: the numbers of its terms, rising, and log-normalised weights.

    The arrays hold one document's distinct dictionary terms. ``dfs``, ``tfs``, ``n_docs`` and ``norm``
    are what the weights follow from.
    """
    docs = weighted.groupBy(*KEY, "doc_id").agg(
        F.collect_list("term_id").alias("term_id"),
        F.collect_list(F.col("df").cast("int")).alias("df"),
        F.collect_list(F.col("tf").cast("int")).alias("tf"),
        F.max("n_docs").alias("n_docs"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
    # lists of plain numbers, in the same order, are a third of a list of pairs in the exchange, small ones less than weights
    docs = docs.withColumn("entries", F.sort_array(F.arrays_zip("term_id", "df", "tf")))
    return docs.select(
        *KEY,
        "doc_id",
        F.col("entries.term_id").alias("term_ids"),
        F.transform(
            "entries", lambda e: weights.log_normalize(weights.tfidf(e["tf"], e["df"], F.col("n_docs")), F.col("norm"))
        ).alias("weights"),
        F.col("entries.df").alias("dfs"),
        F.col("entries.tf").alias("tfs"),
        "n_docs",
        "norm",
    )


def long_form(docs: DataFrame, *others: str) -> DataFrame:
    """Vectors as one row per document and term; ``term_id`` if terms are numbered, else ``term``. ``others`` are kept."""
    name = "term_id" if "term_ids" in docs.columns else "term"
    return docs.select(
        *KEY, "doc_id", *others, F.inline(F.arrays_zip(F.col(f"{name}s").alias(name), F.col("weights").alias("weight")))
    )


def spelled(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with the ``term`` of each ``term_id``; ``terms`` is the dictionary that numbered them."""
    return lookup(rows, terms.select(*KEY, "term_id", "term", "df"), [*KEY, "term_id"], "df").drop("df")


def coded(docs: DataFrame) -> DataFrame:
    """``docs`` with the numbers of their terms in place of the terms.

    Vectors that were made without a dictionary at hand have their terms numbered here.
    """
    if "term_ids" not in docs.columns:
        docs = _numbered(docs)
    return docs.drop("terms").withColumnRenamed("term_ids", "terms")


def located(table: DataFrame) -> DataFrame:
    """A stored table with ``STORED``, where each of its rows lies."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return table.select("*", at.alias(STORED))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` with ``STORED``; vectors that do not tell where they lie are written out first."""
    return docs if STORED in docs.columns else located(stage(docs, "vectors"))


def _numbered(docs: DataFrame) -> DataFrame:
    rows = stage(
        docs.select(*docs.columns, F.posexplode("terms").alias("_at", "_term")).drop("terms"), "entries"
    )
    terms = rows.groupBy(*KEY, F.col("_term").alias("term")).agg(F.count("*").alias("df"))
    numbered = stage(number_terms(terms).withColumnRenamed("term", "_term"), "numbers")
    found = lookup(rows, numbered, [*KEY, "_term"], "df")
    others = [c for c in docs.columns if c not in (*KEY, "doc_id", "terms")]
    ids = F.sort_array(F.collect_list(F.struct("_at", "term_id")))
    return found.groupBy(*KEY, "doc_id").agg(
        *(F.any_value(c).alias(c) for c in others), F.transform(ids, lambda x: x["term_id"]).alias("term_ids")
    )


def eligible(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Documents with enough terms to be compared."""
    return docs.filter(n_terms(docs) >= params.min_terms)


def n_terms(docs: DataFrame) -> Column:
    """How many terms each vector has; if the vectors are stored, without reading them."""
    if COMPACT in docs.columns:
        return F.col(f"{COMPACT}.n_terms")
    return F.size("term_ids" if "term_ids" in docs.columns else "terms")
