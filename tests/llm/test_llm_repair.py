import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from conftest import SF
from pyspark.sql import functions as F

from kindred.llm import repair as R
from kindred.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Of ``(role, text)`` in order."""
    seen, found = set(), []
    for role, text in rows:
        end = text.rstrip(SPACES)[-1:]
        found.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return found


def derive(rows, found):
    """Cheapest edits by what has been said last, row after row: no spans, no cells."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    state = {"": (0, "")}

    def insert(state):
        for _ in range(3):
            for said, (cost, audit) in list(state.items()):
                for role in "ua":
                    if to := follow.get((said, role)):
                        state[to] = min(state.get(to, (1 << 40, "")), (cost + 3, audit + "I"))
        return state

    for (role, _), fault in zip(rows, found):
        after = {}
        for said, (cost, audit) in insert(dict(state)).items():
            options = [(said, 4, "D")]
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                options += [(follow.get((said, role[:1])), extra, "K")]
                options += [(follow.get((said, x)), 3 + extra, "R") for x in "ua"]
            for to, more, edit in options:
                if to is not None:
                    after[to] = min(after.get(to, (1 << 40, "")), (cost + more, audit + edit))
        state = after
    return min(v for k, v in insert(dict(state)).items() if k in ("", "a"))


def every_repair(rows, found, most_inserts=2):
    """All edits there are, tried one by one."""
    best = None
    gaps = [p for n in range(most_inserts + 1) for p in product(*[["", "u", "a"]] * n)]
    kinds = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    for edits in product(*kinds):
        for inserts in product({"".join(g) for g in gaps}, repeat=len(rows) + 1):
            cost, audit, said = 3 * len(inserts[0]), "I" * len(inserts[0]), inserts[0]
            for (role, _), fault, edit, more in zip(rows, found, edits, inserts[1:]):
                cost += {"D": 4, "K": 0}.get(edit[0], 3) + 3 * (edit != "D" and fault == "truncated") + 3 * len(more)
                audit += edit[0] + "I" * len(more)
                said += {"D": "", "K": role[:1] or "?"}.get(edit, edit[1:]) + more
            if LEGAL.fullmatch(said):
                best = min(best or (1 << 40, ""), (cost, audit))
    return best


def all_splits(symbols):
    """CYK with every split of every span, as a yardstick for one split of each."""
    n = len(symbols)
    cell = {(i, i + 1): R.row_cells(x) for i, x in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            made = [R.compose(cell[i, k], cell[k, i + size]) for k in range(i + 1, i + size)]
            cell[i, i + size] = tuple(R.least(*x) for x in zip(*made))
    return cell[0, n]


def symbols(rows, found):
    return "".join(
        chr(65 + 4 * ("sua".find(r[:1]) if r[:1] and r[0] in "sua" else 3) + R.FAULTS.index(f)) for (r, _), f in zip(rows, found)
    )


def some_rows(dice, n):
    roles = ["user", "assistant", "system", "tool", "", " ", "User"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Well. ", "é.\x0b", "ü"]
    made = [(dice.choices(roles, [6, 6, 2, 1, 0.3, 0.3, 0.3])[0], dice.choice(texts) if dice.random() < 0.4 else f"t{i}.") for i in range(n)]
    return [x for r in made for x in [r] * (1 + (dice.random() < 0.1))]


def test_cells_give_the_cheapest_edits():
    dice = random.Random(5)
    for n in range(1, 4):
        for _ in range(3):
            rows = some_rows(dice, n)[:3]
            found = faults(rows)
            assert R.verdict(R.parse(symbols(rows, found))) == every_repair(rows, found) == derive(rows, found)
    for n in [5, 8, 9, 17, 33] * 4:
        rows = some_rows(dice, n)
        found = faults(rows)
        assert R.parse(symbols(rows, found)) == all_splits(symbols(rows, found))
    for n in [40, 700]:
        rows = some_rows(dice, n)
        assert R.verdict(R.parse(symbols(rows, faults(rows)))) == derive(rows, faults(rows))


def expected(turns):
    """``turns``: (conv, turn, role, text); per conversation its row and the repaired turns."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv), key=lambda x: (x[0] is not None, x))
        rows = [x[1:] for x in own]
        found = faults(rows)
        cost, audit = derive(rows, found)
        numbers = {t for t, *_ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        texts, at = [], 0
        for edit in audit:
            if edit != "D":
                texts.append(None if edit == "I" else rows[at])
            at += edit != "I"
        odd = len(texts) % 2
        final = [
            f"{t[0] if i < odd or t and audit.replace('D', '')[i] == 'K' else ('user', 'assistant')[(i - odd) % 2]}:{t[1] if t else ''}"
            for i, t in enumerate(texts)
        ]
        counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *counts, illegal, cost, audit, final)
    return out


def check(repaired, want):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    turns = {}
    for row in repaired.turns.orderBy("conv_id", "place").collect():
        assert row.place == len(turns.setdefault(row.conv_id, []))
        turns[row.conv_id].append(f"{row.role}:{row.text}")
    got = {r.conv_id: (*(r[n] for n in names), turns.get(r.conv_id, [])) for r in repaired.conversations.collect()}
    assert got == want


@pytest.mark.parametrize("segment", [3, 256])
def test_repair(spark, segment):
    dice = random.Random(segment)
    turns = []
    for conv in [None, *range(-3, 40)]:
        rows = some_rows(dice, dice.choice([1, 2, 3, 5, 8, 13]) if conv != 7 else 90)
        for i, (role, text) in enumerate(rows):
            turn = dice.choice([None, i, i, i, i + 3])
            turns.append((conv, turn, dice.choice([role, role, role, None]), dice.choice([text] * 9 + [None])))
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    clash = frame.select("*", *(F.lit(1).alias(c) for c in ("pos", "seg", "idx", "_conv", "_named", "symbol", "place", "audit", "_h1")))
    check(R.repair(clash, segment), expected(turns))


def test_long_and_empty_conversations(spark):
    turns = [(1, i, ("user", "assistant", "tool")[i % 3], "so " * 40_000 * (i == 5) + f"x{i}.") for i in range(2_000)]
    turns += [(2, 0, None, None)] * 3 + [(3, None, "system", "Be short.")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    check(R.repair(frame, 64), expected(turns))
    none = R.repair(frame.limit(0))
    assert none.conversations.count() == none.turns.count() == 0


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        row = (conv, turn, "user" if way == 4 else role, text)
        out += [row] * {0: 0, 3: 2}.get(way, 1)
    return out


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_query(rows):
    want = expected(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", [])
    return {c: (*(w := want.get(c, none))[:7], digest("\n".join(w[7]))) for c in {r[0] for r in rows}}


def run(query, spark, path):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = query(spark, path)
    assert dict(found.dtypes) == {"conv_id": "bigint", **{n: "bigint" for n in names[:6]}, "audit": "string", "repaired_sha256": "string"}
    rows = found.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def test_query_equals_brute_force(spark, tmp_path):
    query = QUERIES["op13_conversation_repair"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(query, spark, SF) == brute_query(rows)
    dice = random.Random(3)
    made = [(dice.choice([None, *range(60)]), dice.choice([None, *range(9)]), *some_rows(dice, 1)[0]) for _ in range(300)]
    made += [(500 + i, 0, None, None) for i in range(30)]
    for n, some in (("a", made), ("b", made[:0])):
        frame = spark.createDataFrame(some, "conv_id long, turn long, role string, text string")
        frame.withColumn("edit", F.lit(1)).write.parquet(str(tmp_path / n / "conversations.parquet"))
        assert run(query, spark, str(tmp_path / n)) == brute_query(some)
