import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(inside),
    )


def texts():
    dice = random.Random(2)
    made = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x", "x\n\nx\ny\n", "é ñ\x0bö\x0c—  ü\r\n|<>", "#$%&* word"]
    for n in (5, 20, 60, 300, 5_000):
        made += [" ".join(dice.choices("ab", k=n)), "\n".join(dice.choices(["la la la", "do re", " "], k=n))]
        made.append(" ".join(dice.choice("abcdefgh") * dice.randrange(1, 9) + str(dice.randrange(n)) for _ in range(n)))
    return made


def test_measurements(spark):
    docs = spark.createDataFrame(
        [(i, t, 7) for i, t in enumerate(texts())], "doc_id long, text string, n_words int"
    )
    found = quality.apply_policy(quality.ledger(docs)).orderBy("doc_id").collect()
    for row, text in zip(found, texts()):
        got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert got == brute(text), text
        base = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        assert bool(row.failed & quality.BASE.mask) == base
        assert row.kept == (row.failed & quality.DEFAULT.mask == 0) and not (base and row.kept)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] * 2, "doc_id long, text string")
    rows = quality.ledger(docs).cache()
    for rule in quality.DEFAULT.rules:
        without = quality.Policy("w", tuple(r for r in quality.DEFAULT.rules if r != rule))
        found = quality.ablation(rows).where(F.col("rule") == rule).first()
        assert found.n_kept_without == quality.apply_policy(rows, without).where("kept").count()
        assert found.n_kept == quality.apply_policy(rows).where("kept").count()
        only = quality.Policy("o", (rule,))
        assert found.n_failed == quality.apply_policy(rows, only).where("not kept").count()
    assert quality.ledger(docs.limit(0)).count() == 0
    rows.unpersist()


def test_keep_returns_the_columns_of_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, good, "x"), (None, good, None), (2, None, "x"), (3, "short", "x"), (1, good, "x")],
        "doc_id long, text string, failed string",
    )
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, good, "x"), (None, good, None), (1, good, "x")], key=str)


def test_unknown_rule():
    with pytest.raises(ValueError):
        _ = quality.Policy("x", ("no such rule",)).mask
