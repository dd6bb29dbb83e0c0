"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks.

``ledger`` stores for each document what was measured and one bit for each rule that
failed. A policy is a version and the rules that count; applying one, or finding what
leaving a rule out would change, needs bit operations on the ledger only, no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SPACE

SYMBOLS = "[#*$%&|<>]"  # fixed value
EDGES = " \t\n\x0b\f\r"



MADE = {
    "text", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines",
    "n_repeat_words", "failed", "kept", "policy",
}


def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "duplicate_lines": (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 20 * n,
        "shouting": (n > 0) & (2 * F.col("n_upper") > F.col("word_chars")),
    }


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(_rules())
        return sum(1 << names.index(rule) for rule in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
DEFAULT = Policy("v1", tuple(
    ["few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"]
))


def measure(docs: DataFrame) -> DataFrame:
    """Measurements of each row of ``docs``, one row each; ``text`` is dropped, the rest stays.

    Columns of ``docs`` named like a result (``MADE``) are replaced by it.

    A null text has no words and no lines: all measurements are 0. Texts are never
    exploded: a row's words stay in the row, and no two rows meet. Repeated windows
    are told by XXH64 of their three words, within the text only.
    """
    own = ["_words", "_lines", "_windows", "_sorted", "_at", "_text"]
    words = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn(
        "_words", F.split(F.btrim("_text", F.lit(EDGES)), SPACE)
    )
    words = words.withColumn(
        "_words", F.when(F.col("_words") == F.array(F.lit("")), F.array().cast("array<string>")).otherwise(F.col("_words"))
    )
    n = F.size("_words")
    counted = words.select(
        *[c for c in docs.columns if c.lower() not in MADE],
        "_words",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(
            n >= 3,
            F.transform(
                F.arrays_zip(
                    F.slice("_words", 1, n - 2).alias("a"),
                    F.slice("_words", 2, n - 2).alias("b"),
                    F.slice("_words", 3, n - 2).alias("c"),
                ),
                lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
            ),
        ).alias("_windows"),
    ).drop("_words")
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    in_order = counted.withColumn(
        "_sorted",
        F.when(repeated, F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    ).drop("_windows")
    twin = lambda x, i: (
        F.when(
            (F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"])),
            x["i"],
        )
    )
    at = in_order.withColumn("_at", F.array_sort(F.array_compact(F.transform("_sorted", twin)))).drop("_sorted")
    # a window covers three words; the next one may begin inside it
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    measured = at.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        }
    )
    return measured.drop(*own)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, a bit for each rule of ``_rules`` that the text fails."""
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(_rules().values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs).withColumn("failed", failed.cast("bigint"))


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """``kept`` and ``policy`` from a ledger: kept if no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).withColumn(
        "policy", F.lit(policy.version)
    )


def ablation(rows: DataFrame, policy: Policy = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """Per rule of the policy: rows it fails, rows that it alone fails, rows kept without it.

    One pass over a ledger with partial sums; a text is not read again.
    """
    names = list(_rules())
    failed = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.count("*").alias("n_rows"), F.count_if(failed == 0).alias("n_kept")]
    for rule in policy.rules:
        bit = 1 << names.index(rule)
        sums += [
            F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"_fail_{rule}"),
            F.count_if(failed == bit).alias(f"_only_{rule}"),
        ]
    each = F.array(
        *(
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(f"_fail_{rule}").alias("n_failed"),
                F.col(f"_only_{rule}").alias("n_failed_alone"),
                (F.col("n_kept") + F.col(f"_only_{rule}")).alias("n_kept_without"),
            )
            for rule in policy.rules
        )
    )
    return rows.groupBy(*by).agg(*sums).select(*by, "n_rows", "n_kept", F.inline(each))


def keep(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns, from the same pass.

    Rows are left out by ``inline``: a filter would be pushed below the measurements, with
    each of them written out again wherever a rule reads it.
    """
    row = F.struct(*(F.col(c) for c in docs.columns))
    judged = apply_policy(ledger(docs.select("text", row.alias("_row"))), policy)
    return judged.select(F.inline(F.when(F.col("kept"), F.array("_row"))))
