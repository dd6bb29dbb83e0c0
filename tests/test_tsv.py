import random

import pytest
from models import read_tsv
from pyspark.sql import functions as F

from kindred.sources.opinions import conform, read_opinions, rejects
from kindred.sources.tsv import read_escaped_tsv, write_escaped_tsv

TWO_RECORDS = "red\\\tgreen\\\tblue\n7\tup\\\tdown\n"

CASES = {
    "": [],
    "k1\tk2\tk3\tk4": [["k1", "k2", "k3", "k4"]],
    "red\\\tgreen": [["red\tgreen"]],
    TWO_RECORDS: [["red\tgreen\tblue"], ["7", "up\tdown"]],
    "  padded \n\tsecond ": [["  padded "], ["", "second "]],
    TWO_RECORDS * 40: [["red\tgreen\tblue"], ["7", "up\tdown"]] * 40,
    " x\ny \nz\n\nlast": [[" x"], ["y "], ["z"], [""], ["last"]],
    "a\\\nb\tc\n": [["a\nb", "c"]],
    "a\\\\\tb\n": [["a\\", "b"]],
    "\\a\\b\n": [["ab"]],
    "a\t\n": [["a", ""]],
    "\n\n": [[""], [""]],
    "größe\\\t中\t\\é\n": [["größe\t中", "é"]],
    "a\rb\tc\n": [["a\rb", "c"]],
}


def read(spark, tmp_path, text, split_bytes):
    (tmp_path / "in.tsv").write_bytes(text.encode())
    rows = read_escaped_tsv(spark, str(tmp_path), split_bytes).orderBy("start").collect()
    return [r["fields"] for r in rows]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_cases(spark, tmp_path, number):
    text, want = list(CASES.items())[number]
    assert read_tsv(text) == want
    assert read(spark, tmp_path, text, 1 << 20) == want


def test_any_split_gives_every_record_once(spark, tmp_path):
    pick = random.Random(7)
    text = "".join(pick.choice("ab\\\\\\\t\né") for _ in range(600))
    want = read_tsv(text)
    for split_bytes in (7, 64, 10_000):
        assert read(spark, tmp_path, text, split_bytes) == want


def test_long_backslash_runs_across_splits(spark, tmp_path):
    for length in (2_999, 3_000):
        text = "a" + "\\" * length + "\nb\n"
        assert read(spark, tmp_path, text, 500) == read_tsv(text)


def test_round_trip(spark, tmp_path):
    texts = ["plain", "tab\there", "line\nbreak", "back\\slash", "\\", "\\\n\t\\", "", "end\\"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    write_escaped_tsv(df, str(tmp_path / "out"))
    back = read_escaped_tsv(spark, str(tmp_path / "out")).select(
        F.col("fields")[0].cast("int").alias("id"), F.col("fields")[1].alias("text")
    )
    assert [r["text"] for r in back.orderBy("id").collect()] == texts


def test_conform(spark, tmp_path):
    rows = ["\t".join(str(i) for i in range(n)) for n in (10, 11, 12)]
    (tmp_path / "in.tsv").write_text("\n".join(rows))
    records = read_escaped_tsv(spark, str(tmp_path))
    kept = conform(records).collect()
    assert [(r["id"], r["text"]) for r in kept] == [("0", "10")]
    assert sorted(r["n_fields"] for r in rejects(records).collect()) == [10, 12]
    assert read_opinions(spark, str(tmp_path)).columns[:11] == conform(records).columns[:11]
