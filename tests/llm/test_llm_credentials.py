import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.llm import credentials as C
from kindred.llm.queries import ORACLE, QUERIES

A = re.ASCII
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | A)


def base(text):
    """As the contract says it, in the words of another engine."""
    text = text or ""
    folded = text.translate({0x17F: "\x00", 0x212A: "\x00"})  # s and k to Python, letters of their own here
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(folded) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def weak(text, reach):
    """All pairs of parts, compared one by one."""
    text = text or ""
    parts = [(s, r, e) for s, r, e in base(text)]
    for rank, pattern in ((3, C.IDENT), (4, C.SECRET), (5, C.ENDPOINT)):
        for m in re.finditer(pattern, text, A):
            if rank == 4 and not re.match(C.SECRET_NAME, m[0], A) and not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            parts.append((m.start(), rank, m.end()))
    ends = [m.end() for m in re.finditer(C.BLANK_LINE, text)]
    scope = lambda p: max([0, *(x for x in ends if x <= p[0])])
    kept = [p for p in parts if p[1] < 3 or not any(q[1] < p[1] and q[0] < p[2] and p[0] < q[2] for q in parts)]
    near = lambda p, ranks: any(
        q is not p and q[1] in ranks and scope(q) == scope(p) and max(p[0] - q[2], q[0] - p[2]) <= reach for q in kept
    )
    need = {3: [(0, 2, 4)], 4: [(1, 3)], 5: [(1, 3), (0, 2, 4)]}
    return sorted(p for p in kept if p[1] < 3 or all(near(p, x) for x in need[p[1]]))


def texts():
    dice = random.Random(4)
    hexes = "0123456789abcdef"
    made = [
        None, "", "password", "token=secret:abcdefgh12", "PassWord  = 'abcdefgh'", "token==abcdefg", "api_key:abcdefg", "apikey=\"a.b-c_d/e\"",
        "Key toKen=abcdefgh ſecret=abcdefgh", "é" * 50 + "AKIA" + "A1" * 6, "AKIAAKIA" + "Z" * 9, "xAKIA" + "B" * 11,
        "ab" * 16 + "g" + "12" * 15, "token=" + "ab" * 20, "😀password=12345678😀", "secret = \"" + "f" * 40 + "\"",
        "user=alice password=pw12", "user=alice\n\npassword=pw12", "user=alice" + " x" * 300 + " password=pw12", "https://db.example/x",
        "login: bob secret: hunter2 https://db.example/x 10.0.0.1:80", "10.1.2.3 zAbcdefghijk12345678",
        "AKIA" + "Q" * 16 + " wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY host=db.internal",
    ]
    pieces = ["user=", "login: ", "account='x9'", "password=", "secret: ", "token", " = ", "abc", "12345678", "\n\n", "\n \n", "\n", " ", " word ", "é", "AKIA",
              "0123456789ABCDEF", "https://a.b/c", "1.2.3.4", "host: h.example", "".join(dice.choices(hexes, k=33)), "Zx9" * 6, "x" * 150]
    made += ["".join(dice.choices(pieces, k=dice.randrange(1, 40))) for _ in range(400)]
    return [*made, " ".join(made[23:]) * 30]


def as_text(spans):
    return ",".join(f"{C.KINDS[r]}:{s}:{e}" for s, r, e in spans)


@pytest.mark.parametrize("reach", [C.REACH, 15])
def test_find(spark, reach):
    made = texts()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("row", "rank", "start", "end", "match", "i", "gap", "found", "kind", "assign", "n_hex")))
    found = C.find(clash, reach)
    spans = {i: [] for i, _ in enumerate(made)}
    for r in found.spans.collect():
        assert made[r.doc_id][r.start : r.end] == r.match
        spans[r.doc_id].append((r.start, r["rank"], r.end))
    n_base = []
    for i, text in enumerate(made):
        if i < len(made) - 1:
            assert as_text(sorted(spans[i])) == as_text(weak(text, reach)), text
        n_base.append(Counter(x[1] for x in base(text)))
        assert sorted(x for x in spans[i] if x[1] < 3) == base(text)
    for r in found.documents.collect():
        n = n_base[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == (n[0], n[1], n[2])
    none = C.find(docs.limit(0))
    assert none.documents.count() == none.spans.count() == 0


def test_query_equals_sql_and_brute_force(spark, tmp_path):
    import duckdb

    from check import rows

    made = [*enumerate(texts()), *[(None, "user=a secret=bcde1")] * 2, (None, None), *[(3, texts()[4])] * 3]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(path)
    found = QUERIES["op12_credential_linking"](spark, str(tmp_path)).toPandas()
    duck = duckdb.connect()
    documents = spark.createDataFrame(made, "doc_id long, text string").toPandas()  # noqa: F841
    assert rows(found) == rows(duck.sql(ORACLE["op12_credential_linking"]).df())
    want = Counter((i, hashlib.sha256(as_text(base(t)).encode()).hexdigest()) for i, t in made)
    assert Counter((None if i != i else i, h) for i, h in zip(found.doc_id, found.base_sha256)) == want


def test_no_python_on_the_way(spark, tmp_path):
    spark.createDataFrame([(1, "user=a secret=bcde1")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = QUERIES["op12_credential_linking"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
