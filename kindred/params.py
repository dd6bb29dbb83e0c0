"""Tuning values of the vectorise and cluster steps."""

from __future__ import annotations

from dataclasses import dataclass

NANO = 10**9
"""Similarities are compared and summed as whole billionths (see ``to_nano``)."""

MAX_BLOCK_SIZE = 2**20
"""Of a block of a given size. Without one a block is a collection, of any number of documents that an int counts."""


def to_nano(similarity: float) -> int:
    """A similarity as whole billionths: sums are then exact in any order."""
    return round(similarity * NANO)


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values: results depend on them."""

    min_support: int = 10  # corpus count a term needs
    min_df: int = 10  # documents a term needs
    max_df_percent: float = 95.0  # terms in more documents than this are dropped
    min_df_mode: str = "drop"  # or "clamp": raise a lower df to min_df
    max_ngram: int = 1  # terms in a row that may count as one
    min_llr: float = 1.0  # log-likelihood ratio such a run needs
    min_terms: int = 2  # terms a document needs to be clustered
    block_size: int | None = 40_000  # documents compared with each other; None: all of a collection
    min_similarity: float = 0.08  # a pair counts from here on
    reassign_similarity: float = 0.3  # a later leader may take over from here on
    drop_unmerged: bool = False  # lose clusters that join no other in the merge
    tile_docs: int = 2_048  # documents per side of one scoring task
    tile_terms: int = 1_000_000  # terms per side, but for the document that fills it up

    def __post_init__(self) -> None:
        if self.min_df_mode not in ("drop", "clamp"):
            raise ValueError(f"unknown min_df_mode: {self.min_df_mode}")
        if self.max_ngram < 1:
            raise ValueError("max_ngram must be positive")
        if self.block_size is not None and not 2 <= self.block_size <= MAX_BLOCK_SIZE:
            raise ValueError(f"block_size must be within 2 and {MAX_BLOCK_SIZE}")
        if not 1 <= self.tile_docs <= 16_384:
            raise ValueError("tile_docs must be within 1 and 16384")
        if self.tile_terms < self.tile_docs:
            raise ValueError("tile_terms must be tile_docs at least")
