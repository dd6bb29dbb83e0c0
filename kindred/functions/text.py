"""Text to terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

WORD = r"([\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without(terms: Column, stop_words: tuple[str, ...]) -> Column:
    if not stop_words:
        return terms
    return F.filter(terms, lambda term: ~term.isin(*stop_words))
