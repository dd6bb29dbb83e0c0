"""Repair of conversation structure: weighted CYK parsing of spans of turns.

Legal role sequences are ``(s?(ua)+)?``: nothing, or user and assistant in turn, at most
one system turn before them. As a grammar in Chomsky normal form it has a symbol
``N[p, q]`` for each pair of states of that pattern (what was said last) and the binary
rules ``N[p, q] -> N[p, r] N[r, q]``; a row is derived by keeping it, giving it another
role, or deleting it, and inserted turns derive from nothing: their closure is
``CLOSURE``. A cell holds the least (cost, audit) with which a span of rows derives its
symbol.

Cells are combined bottom-up by span length: rows, pairs, fours, and so on. Rules of this form
derive the same whichever way a span is split, so that one split of each span suffices.
For one symbol and span, no audit of least cost begins with another (it would only add
insertions, which cost), so the least audit of a span is the least of its left part
followed by the least of its right part: ties are met exactly.

A segment of ``SEGMENT`` rows is parsed within a task; segments of a longer
conversation are joined two by two in rounds, so no conversation has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.conversations import CONVERSATION, conversation_id, in_order
from kindred.operators.joins import lookup
from kindred.staging import stage

SEGMENT = 256
SPACES = " \t\n\x0b\f\r"

# fixed values: costs of edits, legal neighbours
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}

START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua?"  # the last stands for any other role
FAULTS = ("", "truncated", "blank", "duplicate")

Cells = tuple  # of 16 (cost, audit) or None, by 4 * p + q


def least(*found: tuple[int, str] | None) -> tuple[int, str] | None:
    return min((x for x in found if x is not None), default=None)


def compose(left: Cells, right: Cells) -> Cells:
    """Cells of a span out of those of its two parts."""
    out = []
    for p in range(4):
        for q in range(4):
            best = None
            for r in range(4):
                a, b = left[4 * p + r], right[4 * r + q]
                if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = least(best, (a[0] + b[0], a[1] + b[1]))
            out.append(best)
    return tuple(out)


def _closure() -> Cells:
    nothing = [(0, "") if p == q else None for p in range(4) for q in range(4)]
    for (p, initial), q in STEPS.items():
        if initial in ROLES:
            nothing[4 * p + q] = (INSERT, "I")
    cells = tuple(nothing)
    while (more := compose(cells, cells)) != cells:
        cells = more
    return cells


CLOSURE = _closure()


@cache
def row_cells(symbol: str) -> Cells:
    """A row, with what may be inserted before it; ``symbol`` as made by ``_symbol``."""
    initial, fault = INITIALS[(ord(symbol) - 65) // 4], FAULTS[(ord(symbol) - 65) % 4]
    cells: list = [None] * 16
    for p in range(4):
        cells[5 * p] = (DELETE, "D")
        if fault in ("blank", "duplicate"):
            continue
        extra = TRUNCATED if fault == "truncated" else 0
        for letter, cost, edit in ((initial, KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            if (p, letter) in STEPS:
                at = 4 * p + STEPS[p, letter]
                cells[at] = least(cells[at], (cost + extra, edit))
    return compose(CLOSURE, tuple(cells))


def bottom_up(spans: list[Cells]) -> Cells:
    while len(spans) > 1:
        pairs = [spans[i : i + 2] for i in range(0, len(spans), 2)]
        spans = [compose(*x) if len(x) == 2 else x[0] for x in pairs]
    return spans[0]


@lru_cache(1 << 16)
def _short(symbols: str) -> Cells:
    return bottom_up([row_cells(x) for x in symbols])


def parse(symbols: str) -> Cells:
    """Cells of a span of rows; spans of eight rows are remembered."""
    return bottom_up([_short(symbols[i : i + 8]) for i in range(0, len(symbols), 8)])


def verdict(cells: Cells) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    whole = compose(cells, CLOSURE)
    return least(*(whole[4 * START + q] for q in ENDS))


# --- segments ----------------------------------------------------------------------------

SPANS = (
    "_conv bigint, _named boolean, seg bigint, first string, last string, counts array<bigint>, "
    "least_turn bigint, most_turn bigint, n_turns bigint, costs array<bigint>, audits array<string>"
)


@dataclass
class Span:
    """What is known of some rows of a conversation that follow each other."""

    first: str
    last: str
    counts: list[int]  # blank, duplicate, truncated, illegal
    least_turn: int | None
    most_turn: int | None
    n_turns: int
    cells: Cells

    def __add__(self, other: Span) -> Span:
        counts = [a + b for a, b in zip(self.counts, other.counts)]
        counts[3] += self.last + other.first not in LEGAL
        met = [x for x in (self.least_turn, other.least_turn) if x is not None]
        last = [x for x in (self.most_turn, other.most_turn) if x is not None]
        twice = self.most_turn is not None and self.most_turn == other.least_turn
        return Span(
            self.first, other.last, counts, min(met, default=None), max(last, default=None),
            self.n_turns + other.n_turns - twice, compose(self.cells, other.cells),
        )

    def fields(self) -> tuple:
        costs, audits = zip(*(x or (None, None) for x in self.cells))
        return (
            self.first, self.last, self.counts, self.least_turn, self.most_turn, self.n_turns, list(costs), list(audits),
        )


def _read(first, last, counts, least_turn, most_turn, n_turns, costs, audits) -> Span:
    cells = tuple(None if c is None else (c, a) for c, a in zip(costs, audits))
    return Span(first, last, counts, least_turn, most_turn, n_turns, cells)


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


KEYS = [("_conv", pa.int64()), ("_named", pa.bool_()), ("seg", pa.int64())]
SPAN_FIELDS = pa.schema([
    *KEYS, ("first", pa.string()), ("last", pa.string()), ("counts", pa.list_(pa.int64())), ("least_turn", pa.int64()),
    ("most_turn", pa.int64()), ("n_turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Of rows ``_conv, _named, seg, turn, symbol`` that lie in order, a span per segment."""
    open_: tuple | None = None
    turns: list[int | None] = []
    symbols: list[str] = []
    for batch in batches:
        done = []
        for *key, turn, symbol in zip(*(c.to_pylist() for c in batch.columns)):
            if key != open_:
                if open_ is not None:
                    done.append((*open_, *_segment(turns, "".join(symbols)).fields()))
                open_, turns, symbols = key, [], []
            turns.append(turn)
            symbols.append(symbol)
        yield _made(done, SPAN_FIELDS)
    if open_ is not None:
        yield _made([(*open_, *_segment(turns, "".join(symbols)).fields())], SPAN_FIELDS)


def _segment(turns: list[int | None], symbols: str) -> Span:
    initials = "".join(INITIALS[(ord(x) - 65) // 4] for x in symbols)
    faults = [FAULTS[(ord(x) - 65) % 4] for x in symbols]
    illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
    known = {x for x in turns if x is not None}
    return Span(
        initials[0], initials[-1], [*map(faults.count, ("blank", "duplicate", "truncated")), illegal],
        min(known, default=None), max(known, default=None), len(known), parse(symbols),
    )


def _join(batches) -> Iterator[pa.RecordBatch]:
    """Spans of a conversation that lie in order, two and two where both have the same ``seg div 2``."""
    held: tuple | None = None
    for batch in batches:
        done = []
        for *key, seg, first, last, counts, lo, hi, n, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
            span = _read(first, last, counts, lo, hi, n, costs, audits)
            at = (*key, seg // 2)
            if held and held[0] == at:
                done.append((*at, *(held[1] + span).fields()))
                held = None
            else:
                if held:
                    done.append((*held[0], *held[1].fields()))
                held = (at, span)
        yield _made(done, SPAN_FIELDS)
    if held:
        yield _made([(*held[0], *held[1].fields())], SPAN_FIELDS)


RESULT = pa.schema([
    *KEYS[:2], ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
])


def _verdicts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for *key, _, first, last, counts, lo, hi, n, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
            gaps = 0 if lo is None else hi - lo + 1 - n
            done.append((*key, gaps, *counts, *verdict(_read(first, last, counts, lo, hi, n, costs, audits).cells)))
        yield _made(done, RESULT)


EDITS = pa.schema([
    *KEYS[:2], ("place", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()),
])


def _edits(batches) -> Iterator[pa.RecordBatch]:
    """A row per turn that the repaired conversation has, of ``_conv, _named, audit``."""
    for batch in batches:
        for *key, audit in zip(*(c.to_pylist() for c in batch.columns)):
            done, pos, place = [], 0, 0
            system = (len(audit) - audit.count("D")) % 2  # an odd number of turns begins with the system's
            for edit in audit:
                if edit != "D":
                    role = ROLES["ua"[(place - system) % 2]]
                    done.append((*key, place, None if edit == "I" else pos, edit, None if edit == "K" else role))
                    place += 1
                pos += edit != "I"
                if len(done) >= 1 << 16:
                    yield _made(done, EDITS)
                    done = []
            yield _made(done, EDITS)


# --- tables --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Repaired:
    """``conversations``: a row per conversation with counts of faults, cost and audit.
    ``turns``: the turns of the repaired conversations in ``place``, with the edit that made each."""

    conversations: DataFrame
    turns: DataFrame


def _symbol(initial: Column, fault: Column) -> Column:
    return F.char(65 + 4 * initial + fault)


def faults(rows: DataFrame) -> DataFrame:
    """``_conv, _named, pos, turn, symbol`` of ``in_order``: initial of the role and first fault."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    same = [F.xxhash64("role", "text").alias("_s1"), F.xxhash64(F.lit(7), "role", "text").alias("_s2")]
    initial = F.lit(INITIALS.index("?"))
    for at, letter in enumerate(INITIALS[:3]):
        initial = F.when(F.startswith("role", F.lit(letter)), at).otherwise(initial)
    seen = stage(
        rows.select(
            *CONVERSATION, "pos", "turn", *same, initial.alias("_initial"), (end == "").alias("_blank"),
            end.isin(".", "!", "?").alias("_ended"),
        ),
        "turns",
    )
    key = [*CONVERSATION, "_s1", "_s2"]
    firsts = stage(seen.groupBy(*key).agg(F.min("pos").alias("_first"), F.count("*").alias("_n")), "firsts")
    fault = F.when(F.col("_blank"), 2).when(F.col("pos") > F.col("_first"), 3).when(~F.col("_ended"), 1).otherwise(0)
    found = lookup(seen, firsts, key, "_n")
    return found.select(*CONVERSATION, "pos", "turn", _symbol(F.col("_initial"), fault).alias("symbol"))


def repair(turns: DataFrame, segment: int = SEGMENT) -> Repaired:
    """Cheapest repair of each conversation of ``turns (conv_id, turn, role, text, …)``.

    Rows of a conversation follow each other by turn (null first), then role and text. A row's first
    fault counts: ``blank`` (null text included), ``duplicate`` (role and text seen before in
    the conversation; both are deleted) or ``truncated`` (does not end in ``.!?``; undeleted
    costs 3). Roles go by their first letter; one that is null, empty or begins otherwise has to be
    changed or deleted. ``audit`` has a letter per edit (K, R, D, I) of the cheapest repair,
    the ASCII-least of several. ``gaps`` counts turn numbers left out between the first and the
    last. All rows of a null ``conv_id`` are one conversation. Extra columns are ignored;
    an empty table gives empty tables.
    """
    rows = in_order(turns)
    found = faults(rows).withColumn("seg", F.expr(f"pos div {segment}"))
    spans = stage(
        found.repartition(*CONVERSATION, "seg")
        .sortWithinPartitions(*CONVERSATION, "seg", "pos")
        .select(*CONVERSATION, "seg", "turn", "symbol")
        .mapInArrow(_segments, SPANS),
        "spans",
    )
    longest = spans.agg(F.max("seg")).first()[0] or 0
    if longest:
        more = spans.where("seg > 0").select(*CONVERSATION).distinct()
        single, many = (stage(spans.join(more, CONVERSATION, how), "spans") for how in ("left_anti", "left_semi"))
        for _ in range(math.ceil(math.log2(longest + 1))):
            pairs = many.repartition(*CONVERSATION, F.expr("seg div 2")).sortWithinPartitions(*CONVERSATION, "seg")
            many = stage(pairs.select(*spans.columns).mapInArrow(_join, SPANS), "spans")
        spans = single.unionByName(many)
    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    ddl = [", ".join(f"{f.name} {kinds[f.type]}" for f in schema) for schema in (RESULT, EDITS)]
    found = stage(spans.mapInArrow(_verdicts, ddl[0]), "verdicts")
    edits = found.select(*CONVERSATION, "audit").mapInArrow(_edits, ddl[1])
    kept = edits.join(rows.drop("n_rows"), [*CONVERSATION, "pos"], "left")
    return Repaired(
        found.select(conversation_id(), *found.columns[2:]),
        kept.select(
            conversation_id(), "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ),
    )
