"""Secrets in texts: patterns that count by themselves, and weak parts that count together.

A login, a token or a host alone says little; an identifier and a secret close to each
other are a credential, and so is the endpoint that goes with them. Parts are intervals of a
text; scopes are its stretches between blank lines. Parts join within a scope where at
most ``REACH`` code points lie between them: an interval join, done as a sweep. In the order of
starts a running maximum of ends tells the nearest complementary part before, and the
same backwards the nearest one behind, so that no pairs are formed and a text with very many parts
takes as many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.staging import stage

# fixed values: what counts by itself
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_VALUE = 8

# what counts only with a complementary part
IDENT = r"""(?i:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{2,}"""
SECRET_NAME = "(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key)"
SECRET = SECRET_NAME + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|[A-Za-z0-9+/_=-]{16,}"""
ENDPOINT = (
    r"(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D\"'<>]+"
    r"|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?"
    r"|(?i:host|endpoint|server|region)\x20*[:=]\x20*[A-Za-z0-9._:/-]{4,}"
)
BLANK_LINE = r"\n[\x20\x09\x0B-\x0D]*\n"

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
BASE = KINDS[:3]
SCOPE = len(KINDS)  # rank of the ends of blank lines
REACH = 200


@dataclass(frozen=True)
class Findings:
    """``documents``: ``row, doc_id`` and how many spans of each base kind, a row per document.
    ``spans``: ``row, doc_id, kind, start, end, match``; ``row`` tells repeated documents apart."""

    documents: DataFrame
    spans: DataFrame


def _matches(text: Column, pattern: str, rank: int, counts: Column | None = None) -> Column:
    """Each match with the length of what lies before it; positions are sums of these."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(
        F.size(hits) > 0,
        F.transform(
            F.arrays_zip(hits.alias("match"), F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap")),
            lambda x, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"),
            ),
        ),
    )


def _counts(rank: Column, match: Column) -> Column:
    """Whether a match is long or odd enough to be a part of its kind."""
    value = F.regexp_extract(match, ASSIGN, 1)
    token = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return (
        F.when(rank == KINDS.index("assign"), F.length(value) >= LEAST_VALUE)
        .when(rank == KINDS.index("secret"), match.rlike("^" + SECRET_NAME) | token)
        .otherwise(F.lit(True))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, found``: all matches of a text; weak kinds only where both halves are there."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = rows.select(
        "*", _matches(text, ASSIGN, 0).alias("assign"), _matches(text, ACCESS, 1).alias("access"),
        _matches(text, HEX, 2).alias("hex"), _matches(text, IDENT, 3).alias("ident"),
    )
    named = F.col("access").isNotNull() | F.col("ident").isNotNull()
    second = first.withColumn("secret", F.when(named, _matches(text, SECRET, 4)))
    linked = named & (F.col("secret").isNotNull() | F.col("hex").isNotNull() | F.col("assign").isNotNull())
    third = second.select(
        "row", "doc_id", *BASE,
        *(F.when(linked, F.col(c)).alias(c) for c in ("ident", "secret")),
        F.when(linked, _matches(text, ENDPOINT, 5)).alias("endpoint"),
        F.when(linked, _matches(text, BLANK_LINE, SCOPE)).alias("blank"),
    )
    none = F.array().cast("array<struct<rank: int, i: int, gap: int, match: string>>")
    return third.select("row", "doc_id", F.concat(*(F.coalesce(c, none) for c in (*KINDS, "blank"))).alias("found"))


def _positions(found: DataFrame) -> DataFrame:
    """``row, doc_id, rank, start, end, match`` of the matches that count."""
    each = found.select("row", "doc_id", F.inline("found"))
    so_far = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum((F.col("gap") + F.length("match")).cast("bigint")).over(so_far))
    start = F.col("end") - F.length("match")
    placed = placed.select("row", "doc_id", "rank", start.alias("start"), "end", "match")
    return placed.where(_counts(F.col("rank"), F.col("match")))


def _before(by: list[str]):
    return Window.partitionBy(*by).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)


def _behind(by: list[str]):
    order = [F.desc(c) for c in ("start", "rank", "end")]
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _overlapped(rank: int) -> Column:
    """Whether a part of a kind before ``rank`` lies over this one."""
    other = F.col("rank") < rank
    return F.coalesce(F.max(F.when(other, F.col("end"))).over(_before(["row"])) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(other, F.col("start"))).over(_behind(["row"])) < F.col("end"), F.lit(False)
    )


def _near(kinds: tuple[str, ...], reach: int) -> Column:
    """Whether a part of one of the ``kinds`` is within reach, in the same scope."""
    by = ["row", "scope"]
    other = F.col("rank").isin([KINDS.index(k) for k in kinds])
    before = F.col("start") - F.max(F.when(other, F.col("end"))).over(_before(by)) <= reach
    behind = F.min(F.when(other, F.col("start"))).over(_behind(by)) - F.col("end") <= reach
    return F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False))


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak ones of ``parts (row, rank, start, end, …)`` that have what they need.

    Parts over which one of an earlier kind lies do not count. Identifiers need a secret within
    reach, secrets an identifier, endpoints one of each; base kinds are both. A scope
    begins with the text and behind each blank line (rank ``SCOPE``).
    """
    scope = F.max(F.when(F.col("rank") == SCOPE, F.col("end"))).over(_before(["row"]))
    kept = parts.withColumns(
        {"scope": F.coalesce(scope, F.lit(0)), "_of_3": _overlapped(3), "_of_4": _overlapped(4), "_of_5": _overlapped(5)}
    ).where(
        F.when(F.col("rank") == 3, ~F.col("_of_3")).when(F.col("rank") == 4, ~F.col("_of_4"))
        .when(F.col("rank") == 5, ~F.col("_of_5")).otherwise(F.col("rank") < 3)
    )
    near = kept.withColumns({"_named": _near(("access", "ident"), reach), "_secret": _near(("assign", "hex", "secret"), reach)})
    return near.where(
        F.when(F.col("rank") == 3, F.col("_secret")).when(F.col("rank") == 4, F.col("_named"))
        .when(F.col("rank") == 5, F.col("_named") & F.col("_secret")).otherwise(F.lit(False))
    ).select(*parts.columns)


def find(docs: DataFrame, reach: int = REACH) -> Findings:
    """All secrets in each of ``docs (doc_id, text, …)``.

    Kinds and patterns are above; matches of one kind do not overlap, the leftmost counts. Positions are in
    code points, ``end`` is behind the last. A null text is empty; null ids and repeated
    rows are told apart by ``row``; other columns are ignored; no rows give none. Base
    kinds are found whatever is near; weak ones as ``link`` says.
    """
    found = stage(candidates(docs), "matches")
    parts = stage(_positions(found), "parts")
    weak = F.col("rank") >= len(BASE)
    spans = stage(parts.where(~weak).unionByName(link(parts.join(parts.where(weak).select("row").distinct(), "row"), reach)), "spans")
    counts = spans.groupBy("row").agg(*(F.count_if(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(BASE)))
    zero = F.lit(0).cast("bigint")
    documents = found.select("row", "doc_id").join(counts, "row", "left").select(
        "row", "doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE)
    )
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind")
    return Findings(documents, spans.select("row", "doc_id", kind, "rank", "start", "end", "match"))


def spans_text(spans: DataFrame, chosen: Column) -> Column:
    """``kind:start:end`` of a document's spans by start, then kind; an aggregate."""
    each = F.when(chosen, F.struct("start", "rank", "end", "kind"))
    return F.array_join(
        F.transform(
            F.sort_array(F.collect_list(each)),
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )
