"""Term weights."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def tfidf(tf: Column, df: Column, n_docs: Column) -> Column:
    """``sqrt(tf) * (1 + ln(n / (df + 1)))``, not below 0.

    It is only below if a raised ``df`` exceeds the number of documents by far.
    """
    weight = F.sqrt(tf) * (F.lit(1.0) + F.log(n_docs / (df + F.lit(1))))
    return F.greatest(weight, F.lit(0.0))


def log_normalize(weight: Column, norm: Column) -> Column:
    """``log2(1 + w) / norm``, where ``norm`` is the document's Euclidean length; 0 if that is 0."""
    return F.when(norm > 0, F.log2(F.lit(1.0) + weight) / norm).otherwise(F.lit(0.0))


def normalized(tf: np.ndarray, df: np.ndarray, n_docs: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """``log_normalize`` of ``tfidf``, inside a task."""
    weight = np.maximum(np.sqrt(tf) * (1.0 + np.log(n_docs / (df + 1))), 0.0)
    return np.divide(np.log2(1.0 + weight), norm, out=np.zeros(len(norm)), where=norm > 0)


def _entropy(*counts: Column) -> Column:
    """``N ln N`` less the sum of ``n ln n`` of the counts ``n`` with the sum ``N``."""

    def times_log(n: Column) -> Column:
        n = n.cast("double")
        return F.when(n > 0, n * F.log(n)).otherwise(F.lit(0.0))

    total = counts[0]
    for n in counts[1:]:
        total = total + n
    parts = times_log(counts[0])
    for n in counts[1:]:
        parts = parts + times_log(n)
    return times_log(total) - parts


def log_likelihood_ratio(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Twice the mutual information of two events, in nats times the number of cases; not below 0.

    ``both`` counts cases with both, ``first`` and ``second`` those with one only.
    """
    rows = _entropy(both + first, second + neither)
    columns = _entropy(both + second, first + neither)
    cells = _entropy(both, first, second, neither)
    return F.greatest(F.lit(2.0) * (rows + columns - cells), F.lit(0.0))
