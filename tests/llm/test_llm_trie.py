import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from kindred.llm import trie as T
from kindred.llm.queries import QUERIES


def brute(sequences):
    """``sequences``: conversation to its tuple of (role, text); a row per prefix, one by one."""
    members = defaultdict(set)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(conv)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in own if sequences[c] == p)))
        parent = min(members[p[:-1]]) if p else None
        leaves = sum(not children[q] for q in below)
        out.append((min(own), len(p), parent, len(own), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_query(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: tuple(x[2:] for x in sorted(t)) for c, t in own.items()}
    sequences = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        sequences[c] = said.get(c - c % 100, ())[:h] + turns[h:]
    return brute(sequences)


def test_ends_by_range_minima():
    dice = np.random.default_rng(1)
    for n in [1, 2, 3, 7, 8, 9, 60]:
        values = dice.integers(-1, 5, n)
        at, depth = np.repeat(np.arange(n), 7), np.tile(np.arange(-1, 6), n)
        left, right = (f(T.sparse_table(values), at, depth) for f in (T.left_end, T.right_end))
        for i, d, a, b in zip(at, depth, left, right):
            assert a == max([-1, *(p for p in range(i + 1) if values[p] < d)])
            assert b == min([n, *(p for p in range(i + 1, n) if values[p] < d)])


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_trie(spark, block):
    dice = random.Random(block)
    sequences = {c: tuple(dice.choice([("user", "a"), ("user", "bé"), ("usera", "")]) for _ in range(dice.randrange(6))) for c in range(-20, 60)}
    hot = (("user", "common"),) * 3
    sequences |= {c: hot[: dice.randrange(1, 4)] for c in range(100, 150)}
    sequences[7] = hot * 40
    rows = [(c, i, *x) for c, turns in sequences.items() for i, x in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string")
    convs = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    clash = turns.select("*", *(F.lit(1).alias(c) for c in ("key", "idx", "block", "rank", "node", "depth", "digest", "n_chars", "turn")))
    found = T.prefix_trie(clash, convs, block)
    members = defaultdict(list)
    ranked = sorted((r.rank, r.conv_id, (r.node, r.depth)) for r in found.members.collect())
    for rank, conv, node in ranked:
        members[node].append(str(conv))
    assert [r for r, *_ in ranked] == list(range(len(sequences)))
    got = []
    for r in found.nodes.collect():
        own = members[r.node, r.depth]
        assert [str(c) for _, c, _ in ranked][r.first_rank : r.first_rank + r.n_ends] == own
        assert min(c for _, c, _ in ranked[r.first_rank : r.first_rank + r.n_convs]) == r.conv_id
        ends = hashlib.sha256(",".join(own).encode()).hexdigest()
        got.append((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, ends))
    assert sorted(got, key=repr) == brute(sequences)
    none = T.prefix_trie(turns.limit(0), convs.limit(0))
    assert none.nodes.count() == none.members.count() == 0


def run(spark, path):
    found = QUERIES["op11_prefix_trie"](spark, path)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.dtypes == [(n, "bigint") for n in names[:-1]] + [(names[-1], "string")]
    return sorted(map(tuple, found.collect()), key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, SF) == brute_query(rows)
    dice = random.Random(3)
    made = [
        (dice.choice([None, *range(40), 100, 107, 199, 350]), dice.choice([None, 0, 1, 2, 3, 4, 5]), dice.choice(["user", "assistant", None]), dice.choice(["a", "bé", "", None]))
        for _ in range(300)
    ]
    made += [(107, 9, "user", "long " * 50_000)] + [(100, 5, "user", "twice")] * 3
    for n, some in (("a", made), ("b", made[:0])):
        frame = spark.createDataFrame(some, "conv_id long, turn long, role string, text string")
        frame.withColumn("node", F.lit(1)).write.parquet(str(tmp_path / n / "conversations.parquet"))
        assert run(spark, str(tmp_path / n)) == brute_query(some)
