"""Similarities between two tiles of at most ``Params.tile_docs`` documents each.

A task gets two panels, which are runs of tiles, and goes through their tiles two at a time.
Runs inside one Spark task on one Arrow group; holds no state between groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kindred.functions import compact
from kindred.functions.compact import COMPACT, ranges
from kindred.params import NANO

STRIPE = 256  # left documents scored at a time
PRODUCTS = 2_000_000  # weight products held at a time
TILE_DOCS = 2_048  # smaller tiles of a panel are scored together up to this
TILE_TERMS = 1_000_000


@dataclass
class Tile:
    """Vectors in position order, entry by entry."""

    pos: np.ndarray
    row: np.ndarray
    code: np.ndarray
    weight: np.ndarray


def read_tiles(group: pa.Table, low: int, high: int) -> tuple[Tile, Tile, int]:
    """Both tiles of a group with terms numbered alike, and how many terms there are."""
    (left, right), n_terms = _read(group, "tile", low, high)
    return left[0], right[0], n_terms


def read_panels(group: pa.Table, low: int, high: int) -> tuple[list[Tile], list[Tile], int]:
    """The tiles of both panels of a group, small ones that follow each other as one."""
    (left, right), n_terms = _read(group, "panel", low, high, TILE_DOCS, TILE_TERMS)
    return left, right, n_terms


def _read(
    group: pa.Table, by: str, low: int, high: int, most_docs: int | None = None, most_terms: int = 0
) -> tuple[list[list[Tile]], int]:
    if COMPACT in group.column_names:
        length, terms, weight = compact.entries(group[COMPACT].combine_chunks())
        encoded = pc.dictionary_encode(pa.array(terms))
    else:
        terms = group["terms"].combine_chunks()
        length = pc.list_value_length(terms).to_numpy()
        encoded = pc.dictionary_encode(terms.flatten())
        weight = group["weights"].combine_chunks().flatten().to_numpy()
    code = encoded.indices.to_numpy()
    start = length.cumsum() - length
    number = group[by].to_numpy()
    pos = group["pos"].to_numpy()
    tile_no = group["tile"].to_numpy()

    def tile(docs: np.ndarray) -> Tile:
        entries = ranges(start[docs], length[docs])
        row = np.repeat(np.arange(len(docs)), length[docs])
        return Tile(pos[docs], row, code[entries], weight[entries])

    def side(which: int) -> list[Tile]:
        docs = np.flatnonzero(number == which)
        docs = docs[np.argsort(pos[docs])]
        if most_docs is None:
            return [tile(docs)]
        firsts = np.flatnonzero(np.diff(tile_no[docs], prepend=-1))
        ends = np.r_[firsts[1:], len(docs)]
        n_terms = np.add.reduceat(length[docs], firsts)
        cuts, n_docs, total = [], 0, 0
        for first, end, more in zip(firsts, ends, n_terms):
            if not cuts or n_docs + end - first > most_docs or total + more > most_terms:
                cuts.append(first)
                n_docs, total = 0, 0
            n_docs, total = n_docs + end - first, total + more
        return [tile(part) for part in np.split(docs, cuts[1:])]

    left = side(low)
    return [left, left if low == high else side(high)], len(encoded.dictionary)


def _top(tile: Tile) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a tile and the greatest weight of each."""
    order = np.argsort(tile.code, kind="stable")
    code = tile.code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.maximum.reduceat(np.abs(tile.weight[order]), first) if len(first) else np.zeros(0)


def _by_tile(docs: Tile, tile_no: np.ndarray, n_terms: int) -> Tile:
    """``docs``, whose tiles are ``tile_no``, as a row per tile: the greatest weight of each of its terms."""
    numbers, row = np.unique(tile_no, return_inverse=True)
    key = row[docs.row] * n_terms + docs.code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    weight = np.maximum.reduceat(np.abs(docs.weight[order]), first) if len(first) else np.zeros(0)
    return Tile(numbers, key[order][first] // n_terms, key[order][first] % n_terms, weight)


def facing(lefts: list[Tile], rights: list[Tile], n_terms: int, min_nano: int) -> Iterator[tuple[list[Tile], Tile]]:
    """Each right tile with the left ones, up to itself, that may have a similar document; others are
    told by the sum of products of the greatest weights, above which no similarity is."""
    tops = [_top(tile) for tile in lefts]
    for number, right in enumerate(rights):
        greatest = np.zeros(n_terms)
        terms, top = tops[number] if lefts is rights else _top(right)
        greatest[terms] = top
        before = number if lefts is rights else len(lefts)
        # sums differ in their last digits with the order of terms
        near = [left for left, (at, x) in zip(lefts[:before], tops) if x @ greatest[at] * NANO >= min_nano - 1]
        yield near + ([right] if lefts is rights else []), right


def score_stripes(
    left: Tile, right: Tile, n_terms: int, min_nano: int
) -> Iterator[tuple[int, np.ndarray]]:
    """Similarities of left documents with all right ones, a stripe at a time.

    Yields the first left row and a matrix of whole billionths, zero where the
    pair is too far apart or, within one tile, not in order.
    """
    n_right = len(right.pos)
    for first, score in products(left, right, n_terms):
        nano = np.rint(score * NANO).astype(np.int64)
        nano[nano < min_nano] = 0
        if left is right:
            nano[np.arange(n_right) <= first + np.arange(len(nano))[:, None]] = 0
        yield first, nano


def products(left: Tile, right: Tile, n_terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """Dot products of left documents with all right ones, a stripe at a time.

    Terms in many right documents go through a matrix product, the others through their postings.
    """
    n_right = len(right.pos)
    by_term = np.argsort(right.code, kind="stable")
    posting_row = right.row[by_term]
    posting_weight = right.weight[by_term]
    count = np.bincount(right.code, minlength=n_terms)
    start = count.cumsum() - count

    common = np.flatnonzero(count > max(8, n_right // 16))
    slot = np.full(n_terms, -1)
    slot[common] = np.arange(len(common))
    at = slot[right.code]
    dense = np.zeros((len(common), n_right))
    dense[at[at >= 0], right.row[at >= 0]] = right.weight[at >= 0]

    bounds = np.searchsorted(left.row, np.arange(0, len(left.pos) + STRIPE, STRIPE))
    for number, first in enumerate(range(0, len(left.pos), STRIPE)):
        entries = slice(bounds[number], bounds[number + 1])
        height = min(STRIPE, len(left.pos) - first)
        row, code, weight = left.row[entries] - first, left.code[entries], left.weight[entries]
        at = slot[code]
        mine = np.zeros((height, len(common)))
        mine[row[at >= 0], at[at >= 0]] = weight[at >= 0]
        score = mine @ dense

        rare = (at < 0) & (count[code] > 0)
        row, code, weight = row[rare], code[rare], weight[rare]
        done = 0
        filled = count[code].cumsum()
        while done < len(code):
            base = filled[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(filled, base + PRODUCTS, side="right")))
            part = slice(done, upto)
            n = count[code[part]]
            hit = ranges(start[code[part]], n)
            cell = np.repeat(row[part] * n_right, n) + posting_row[hit]
            product = np.repeat(weight[part], n) * posting_weight[hit]
            score += np.bincount(cell, product, height * n_right).reshape(height, n_right)
            done = upto

        yield first, score


def pairs(left: Tile, right: Tile, n_terms: int, min_nano: int) -> dict[str, np.ndarray]:
    """Every pair of a left and a later right document that is similar enough."""
    a, b, sim = [], [], []
    for first, score in products(left, right, n_terms):
        row, col, nano = _similar(score, min_nano, first if left is right else None)
        a.append(left.pos[first + row])
        b.append(right.pos[col])
        sim.append(nano)
    return {"a": np.concatenate(a), "b": np.concatenate(b), "sim_nano": np.concatenate(sim)}


def partial_scores(
    left: Tile, right: Tile, n_terms: int, min_nano: int
) -> dict[str, np.ndarray]:
    """What these two tiles add to each document's scores.

    ``centricity_nano`` is a sum, ``best_nano`` and ``best_pos`` the most similar of the earlier documents (the last of
    equals), ``first_nano`` and ``first_pos`` the first of them, zeros if there is none; see ``similarity.document_scores``.
    """
    n_left, n_right = len(left.pos), len(right.pos)
    as_left, as_right = np.zeros(n_left, np.int64), np.zeros(n_right, np.int64)
    best, best_pos, earliest, first_pos = (np.zeros(n_right, kind) for kind in (np.int64, np.int32) * 2)
    for begun, score in products(left, right, n_terms):
        row, col, nano = _similar(score, min_nano, begun if left is right else None)
        if not len(row):
            continue
        # sums of whole numbers, none near 2**53
        as_left[begun : begun + len(score)] = np.bincount(row, nano, len(score)).astype(np.int64)
        as_right += np.bincount(col, nano, n_right).astype(np.int64)
        at = np.flatnonzero(np.diff(col, prepend=-1))
        most = np.maximum.reduceat(nano, at)
        equal = np.flatnonzero(nano == np.repeat(most, np.diff(at, append=len(col))))
        last = equal[np.flatnonzero(np.diff(col[equal], append=-1))]
        last = last[most >= best[col[at]]]
        best[col[last]], best_pos[col[last]] = nano[last], left.pos[begun + row[last]]
        at = at[earliest[col[at]] == 0]
        earliest[col[at]], first_pos[col[at]] = nano[at], left.pos[begun + row[at]]

    follow = (as_left + as_right > 0) if left is right else as_right > 0
    lead = (as_left > 0) & (left is not right)
    none = np.zeros(lead.sum(), np.int64)
    total = as_right[follow] + (as_left[follow] if left is right else 0)
    places = none.astype(np.int32)
    return {
        "pos": np.concatenate([left.pos[lead], right.pos[follow]]),
        "centricity_nano": np.concatenate([as_left[lead], total]),
        "best_nano": np.concatenate([none, best[follow]]),
        "best_pos": np.concatenate([places, best_pos[follow]]),
        "first_nano": np.concatenate([none, earliest[follow]]),
        "first_pos": np.concatenate([places, first_pos[follow]]),
    }


def _similar(score: np.ndarray, min_nano: int, begun: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and whole billionths of a stripe's pairs that are similar enough, column by column. Within one tile,
    where the first row is document ``begun``, only those in order."""
    col, row = np.nonzero(np.ascontiguousarray((score >= (min_nano - 1) / NANO).T))
    if begun is not None:
        ordered = col > begun + row
        row, col = row[ordered], col[ordered]
    nano = np.rint(score[row, col] * NANO).astype(np.int64)
    enough = nano >= max(min_nano, 1)
    return row[enough], col[enough], nano[enough]


def _joined(found: list[dict[str, np.ndarray]], types: dict[str, type]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([np.zeros(0, kind), *(f[name] for f in found)]) for name, kind in types.items()}


def pairs_of_panels(lefts: list[Tile], rights: list[Tile], n_terms: int, min_nano: int) -> dict[str, np.ndarray]:
    """``pairs`` of all tiles of two panels."""
    near = facing(lefts, rights, n_terms, min_nano)
    found = [pairs(left, right, n_terms, min_nano) for some, right in near for left in some]
    return _joined(found, {"a": np.int32, "b": np.int32, "sim_nano": np.int64})


def scores_of_panels(lefts: list[Tile], rights: list[Tile], n_terms: int, min_nano: int) -> dict[str, np.ndarray]:
    """``partial_scores`` of all tiles of two panels, added up: a row per document."""
    near = facing(lefts, rights, n_terms, min_nano)
    found = [partial_scores(left, right, n_terms, min_nano) for some, right in near for left in some]
    kinds = {"pos": np.int32, "centricity_nano": np.int64}
    every = _joined(found, kinds | {f"{x}_{y}": kinds.get(y, np.int64) for x in ("best", "first") for y in ("nano", "pos")})
    if not len(every["pos"]):
        return every
    order = np.argsort(every["pos"], kind="stable")
    first = np.flatnonzero(np.diff(every["pos"][order], prepend=-1))
    made = {"pos": every["pos"][order][first], "centricity_nano": np.add.reduceat(every["centricity_nano"][order], first)}
    best = np.lexsort((every["best_pos"], every["best_nano"], every["pos"]))[np.r_[first[1:], len(order)] - 1]
    earliest = np.lexsort((every["first_pos"], every["first_nano"] == 0, every["pos"]))[first]
    for name, at in (("best", best), ("first", earliest)):
        made |= {f"{name}_{x}": every[f"{name}_{x}"][at] for x in ("nano", "pos")}
    return made


def stairs_of_panels(
    lefts: list[Tile], rights: list[Tile], n_terms: int, min_nano: int, threshold: int
) -> dict[str, pa.Array]:
    """``staircases`` of all tiles of two panels: a row per right document."""
    near = facing(lefts, rights, n_terms, min_nano)
    found = [staircases(some, right, n_terms, min_nano, threshold) for some, right in near]
    tables = [{k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in f.items()} for f in found]
    return {name: pa.concat_arrays([t[name] for t in tables]) for name in tables[0]}


def staircases(
    left: Tile | list[Tile], right: Tile, n_terms: int, min_nano: int, threshold: int
) -> dict[str, np.ndarray | pa.Array]:
    """For right documents, which similarities to left ones, in their order, reach all before.

    ``steps`` are the different values of these from ``threshold`` on and ``counts`` how often
    each came, ``first_nano`` and ``most_nano`` the first value and the greatest. A row for each
    right document that has any. Several left tiles are one after another.
    """
    lefts = left if isinstance(left, list) else [left]
    n_right = len(right.pos)
    most, first_nano = np.zeros(n_right, np.int64), np.zeros(n_right, np.int64)
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stripes = (nano for each in lefts for _, nano in score_stripes(each, right, n_terms, min_nano))
    for nano in stripes:
        top = (nano > 0).argmax(axis=0)
        fresh = (first_nano == 0) & (nano[top, np.arange(n_right)] > 0)
        first_nano[fresh] = nano[top, np.arange(n_right)][fresh]
        best = np.maximum.accumulate(nano, axis=0)
        np.maximum(best, most, out=best)
        row, col = np.nonzero((nano == best) & (nano >= max(threshold, 1)))
        found_at.append(col)
        found.append(nano[row, col])
        most = best[-1] if len(best) else most
    at, value = np.concatenate(found_at), np.concatenate(found)
    order = np.lexsort((value, at))
    at, value = at[order], value[order]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(value) != 0)][: len(at)])
    steps, counts, owner = value[new], np.diff(np.r_[new, len(at)]), at[new]
    used = np.flatnonzero(most > 0)
    ends = np.searchsorted(owner, used, side="right")
    offsets = pa.array(np.r_[0, ends].astype(np.int32))
    return {
        "b": right.pos[used],
        "first_nano": first_nano[used],
        "most_nano": most[used],
        "steps": pa.ListArray.from_arrays(offsets, pa.array(steps)),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(counts)),
    }


def bounds_of_panels(group: pa.Table, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dot products of the rows of two panels: those of the one, of the other, and a matrix.

    Rows are tiles; vectors as bytes are those of documents, whose tiles are made here.
    """
    ((left,), (right,)), n_terms = _read(group, "panel", low, high)
    if COMPACT in group.column_names:
        pos, tile_no = group["pos"].to_numpy(), group["tile"].to_numpy()
        order = np.argsort(pos)
        sides = [left] if left is right else [left, right]
        sides = [_by_tile(side, tile_no[order[np.searchsorted(pos[order], side.pos)]], n_terms) for side in sides]
        left, right = sides[0], sides[-1]
    score = [stripe for _, stripe in products(left, right, n_terms)]
    return left.pos, right.pos, np.concatenate(score)


def bound(group: pa.Table) -> float:
    """The dot product of the vectors of a group's two rows."""
    terms, weights = group["terms"].combine_chunks(), group["weights"].combine_chunks()
    (a, b), (x, y) = (
        [np.asarray(c.slice(i, 1).flatten()) for i in range(2)] for c in (terms, weights)
    )
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return float(x[i] @ y[j])
