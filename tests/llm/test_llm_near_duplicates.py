import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import embeddings, simhash
from kindred.llm.components import components
from kindred.llm.common import word_blocks


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    dice = random.Random(seed)
    edges = [(dice.randrange(60), dice.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    edges += [(200, i) for i in range(201, 240)] + [(7, 7), (100, 101)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = classes(nodes, edges)
    assert {n: found.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies():
    dice = random.Random(5)
    words = ["".join(dice.choices("abcdeé", k=5)) for _ in range(300)]
    base = dice.choices(words, k=400)
    texts = [" ".join(base)]
    for _ in range(60):  # chains of small changes
        copy = texts[-1].split()
        copy[dice.randrange(400)] = dice.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(dice.choices(words, k=dice.randrange(1, 60))) for _ in range(60)]
    texts += [None, "", " \n", "One", "one", "one two", "A b C", "a B c", texts[0].upper(), texts[0]]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0]), (None, "nothing like it")]


@pytest.mark.parametrize("crowd", [512, 2])
def test_simhash_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CELL_HOMES", crowd)
    rows = near_copies()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, node int")
    found = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    assert sorted((r.doc_id or -1, r.fp[0] % 2**64) for r in found) == sorted((d or -1, p) for (d, _), p in zip(rows, prints))
    different = sorted(set(prints))
    near = [(a, b) for a in different for b in different if a < b and (a ^ b).bit_count() <= 2]
    assert len(near) > 20
    member = classes(different, near)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[member[p]] = min(d, least.get(member[p], d))
    for r in found:
        assert r.component_id == least.get(member[r.fp[0] % 2**64])


@pytest.mark.parametrize("radius", [2, 3, 5])
def test_every_pair_within_the_radius_meets(spark, radius):
    dice = random.Random(radius)
    words = [dice.getrandbits(64) for _ in range(40)]
    for w in words[:40]:
        for _ in range(5):
            words.append(w ^ sum(1 << b for b in dice.sample(range(64), radius)))
    signed = [w - (1 << 64) if w >> 63 else w for w in set(words)]
    groups = spark.createDataFrame([(w, [w]) for w in signed], "node long, fp array<long>")
    edges = [(r.a, r.b) for r in simhash.links(groups, radius, 1).collect()]
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= radius]
    assert classes(signed, edges) == classes(signed, want)


def test_keep_one_and_empty_tables(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, source string")
    kept = simhash.keep_one(docs, radius=3, lanes=2)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) < 80 and len(set(texts)) == len(texts)
    for at in range(61, 70):  # texts without a near copy stay
        assert rows[at][1] in texts
    empty = docs.limit(0)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_long_texts_are_read_in_blocks():
    text = " ".join(f"w{i % 977}é" for i in range(30_000)).encode()
    words = text.split()
    got = []
    for k, block in enumerate(word_blocks(text, 2, 1000)):
        got += block[2 if k else 0 :]
    assert got == words
    assert simhash.fingerprint(text.decode(), 3, 1) == [brute_fingerprint(text.decode())]


def vectors():
    made = np.random.default_rng(3)
    base = made.standard_normal((12, 16))
    rows = [b + 0.02 * made.standard_normal(16) for b in base for _ in range(12)]
    rows += [made.standard_normal(16) for _ in range(60)] + [rows[0], rows[0], 3 * rows[0], -rows[0], 1e200 * rows[1]]
    rows = [[float(x) for x in r] for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return rows


@pytest.mark.parametrize("tile", [1024, 3])
def test_embeddings_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vectors()
    frame = spark.createDataFrame(
        [(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, component_id string"
    )
    found = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    unit = {
        i: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
        for i, v in enumerate(rows)
        if v and None not in v and np.isfinite(v).all() and np.any(v)
    }
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    member = classes(range(len(rows)), links)
    for i in range(len(rows)):
        assert found[i].n_links == sum(i in p for p in links)
        assert found[i].component_id == member[i]
        assert found[i].kept == (member[i] == i)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_with_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, embeddings.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, False)], key=str)
    assert embeddings.near_duplicates(frame.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 4
