"""Terms that go together: n-grams within texts, terms within clusters.

Both are judged by the log-likelihood ratio of a table of four counts. Counts are sums of
parts, so none of this brings a term, a collection or a cluster together in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.functions.weights import log_likelihood_ratio
from kindred.operators.joins import lookup, possible
from kindred.operators.vectors import DOCUMENT, Analyzer, by_document, long_form
from kindred.params import Params
from kindred.schema import KEY
from kindred.staging import stage

GRAM = [*KEY, "n", "head", "tail"]

TASK_GRAMS = 1_000_000
"""N-grams that a task counts."""


def gram_frequency(
    docs: DataFrame,
    max_ngram: int = 2,
    analyzer: Analyzer = text.words,
    stop_words: tuple[str, ...] = text.STOP_WORDS,
) -> DataFrame:
    """``n, head, tail, tf`` per document: runs of two to ``max_ngram`` kept terms, and how often.

    ``head`` is all terms of a run but the last, with spaces between. Like single terms, runs are
    counted where their document is; a text with fewer terms has none.
    """
    terms = by_document(docs, max_ngram).select(
        *KEY, "doc_id", DOCUMENT, text.without(analyzer(F.col("text")), stop_words).alias("terms")
    )

    names = [f"_{k}" for k in range(1, max_ngram)]

    def runs(n: int):
        # lists of first terms, second terms and so on, moved against each other: no function is called per term
        size = F.greatest(F.size("terms") - (n - 1), F.lit(0))
        moved = [F.slice("terms", k, size) for k in range(1, n + 1)]
        none = [F.array_repeat(F.lit(None).cast("string"), size)] * (max_ngram - n)
        columns = dict(zip(["n", *names, "tail"], [F.array_repeat(F.lit(n), size), *moved[:-1], *none, moved[-1]]))
        return F.arrays_zip(*(column.alias(name) for name, column in columns.items()))

    each = [runs(n) for n in range(2, max_ngram + 1)]
    found = terms.select(*KEY, "doc_id", DOCUMENT, F.inline(F.concat(*each)))
    rows = found.select(*KEY, "doc_id", DOCUMENT, "n", F.concat_ws(" ", *names).alias("head"), "tail")
    return rows.groupBy(*KEY, "doc_id", DOCUMENT, "n", "head", "tail").agg(F.count("*").alias("tf")).drop(DOCUMENT)


def collocations(grams: DataFrame, params: Params = Params()) -> DataFrame:
    """``n, head, tail, count, llr`` of the n-grams of ``gram_frequency`` that are no accident.

    The four counts are those of a head and a tail with each other, either without the other, and neither, among
    all n-grams of the same length. Kept are n-grams with ``min_support`` occurrences and a ratio of ``min_llr``.
    """
    counts = stage(_by_gram(grams).groupBy(*GRAM).agg(F.sum("tf").alias("count")), "grams", compression="zstd")
    often = stage(counts.filter(F.col("count") >= params.min_support), "often")
    # a lookup finds keys with nulls if they are among the hot ones, which all keys decide
    named = often.where(" OR ".join(f"{c} IS NULL" for c in KEY)).isEmpty()

    def margin(by: list[str], name: str) -> DataFrame:
        # only what n-grams that occur often need; loads: how many rows of counts there are to join
        needed = possible(counts, often, by) if named and len(by) > len(KEY) + 1 else counts
        return stage(needed.groupBy(*by).agg(F.sum("count").alias(name), F.count("*").alias(f"_{name}")), name)

    rows = lookup(often, margin([*KEY, "n", "head"], "heads"), [*KEY, "n", "head"], "_heads")
    rows = lookup(stage(rows, "with-heads"), margin([*KEY, "n", "tail"], "tails"), [*KEY, "n", "tail"], "_tails")
    rows = lookup(stage(rows, "with-tails"), margin([*KEY, "n"], "grams"), [*KEY, "n"], "_grams")
    both, head, tail, every = (F.col(c) for c in ("count", "heads", "tails", "grams"))
    ratio = log_likelihood_ratio(both, head - both, tail - both, every - head - tail + both)
    judged = rows.select(*GRAM, "count", ratio.alias("llr"))
    return judged.filter(F.col("llr") >= params.min_llr)


def _by_gram(grams: DataFrame) -> DataFrame:
    """Rows spread by n-gram, so that counting needs no other exchange.

    Few n-grams come twice within a task: adding up before the exchange would hold and sort nearly all of them, to no
    effect. It is done only where a single n-gram may have more rows than some tasks: it has one for each document at most.
    """
    n_rows = grams.count()
    n_docs = grams.agg(F.approx_count_distinct("doc_id")).first()[0]
    rows = grams.select(*GRAM, "tf")
    if n_docs > 8 * TASK_GRAMS:
        return rows
    usual = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(usual, n_rows // TASK_GRAMS), *GRAM)


def with_collocations(term_freq: DataFrame, grams: DataFrame, params: Params = Params()) -> DataFrame:
    """Term frequencies of single terms and of collocations, these named with spaces."""
    known = stage(collocations(grams, params), "collocations")
    # most n-grams are none: they are told from a hash, before any is exchanged
    met = stage(possible(grams.select(*GRAM, "doc_id", "tf"), known, GRAM), "met", compression="zstd")
    kept = lookup(met, known.select(*GRAM, "count"), GRAM, "count")
    named = kept.select(
        *KEY, "doc_id", F.concat_ws(" ", "head", "tail").alias("term"), "tf", F.lit(0).alias("leads")
    )
    return term_freq.unionByName(named)


def contrasting_terms(merged: DataFrame, vectors: DataFrame, terms: DataFrame, top: int = 5) -> DataFrame:
    """``rank, term, score`` per cluster: up to ``top`` terms that its documents have and others lack.

    The four counts are documents inside and outside of the cluster, with the term and
    without. A term counts that is more frequent inside; equal scores (to six places) go by the term. ``vectors``
    and ``terms`` (the dictionary with its numbers) are those the clusters were made from. Only
    the best of every task meet, ``top`` of each cluster.
    """
    label = [*KEY, "label"]
    sizes = stage(merged.groupBy(*label).agg(F.count("*").alias("size")), "cluster-sizes")
    inside = long_form(vectors.join(merged.select(*label, "doc_id"), [*KEY, "doc_id"]), "label")
    counts = stage(inside.groupBy(*label, "term_id").agg(F.count("*").alias("both")), "cluster-terms")
    known = terms.select(*KEY, "term_id", "term", "df", "n_docs")
    load = counts.groupBy(*label).agg(F.count("*").alias("_load"))
    rows = lookup(counts, stage(sizes.join(load, label), "loads"), label, "_load")
    rows = lookup(stage(rows, "with-sizes"), known, [*KEY, "term_id"], "df")
    both, size, df, n_docs = (F.col(c) for c in ("both", "size", "df", "n_docs"))
    ratio = log_likelihood_ratio(both, size - both, df - both, n_docs - size - df + both)
    scored = rows.where(both * n_docs > df * size).select(*label, "term", F.round(ratio, 6).alias("score"))
    order = Window.partitionBy(*label).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
