import random

import models
import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.functions import compact, tiles
from kindred.operators import collocations as grams
from kindred.operators import forest, index, similarity, vectors
from kindred.params import Params, to_nano
from kindred.plans.rebuild import rebuild, rebuild_all
from kindred.plans.textcluster import block_and_rest, textcluster
from kindred.plans.vectorize import read_vectors, unpack, vectorize
from kindred.staging import stage

VECTORS = "namespace string, collection_key string, doc_id long, terms array<string>, weights array<double>"


def corpus(seed, n, words=12, steps=(0.1, 0.2, 0.3)):
    """Weights from a small set, so that equal similarities are common."""
    pick = random.Random(seed)
    return {
        d * 3: {
            f"t{t}": pick.choice(steps) for t in pick.sample(range(words), pick.randint(1, 4))
        }
        for d in range(n)
    }


def to_frame(spark, collections):
    rows = [
        ("n", name, d, list(v), list(v.values()))
        for name, docs in collections.items()
        for d, v in docs.items()
    ]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


@pytest.mark.parametrize("tile_docs", [1, 7, 16, 100])
def test_tiles_equal_brute_force(tile_docs):
    pick = random.Random(tile_docs)
    docs = list(corpus(tile_docs, 100, words=40).values())
    pick.shuffle(docs)
    threshold = to_nano(0.03)
    want = models.all_pairs(docs, threshold)
    got = {}
    n_tiles = -(-len(docs) // tile_docs)
    for low in range(n_tiles):
        for high in range(low, n_tiles):
            rows = [i for i in range(len(docs)) if i // tile_docs in (low, high)]
            pick.shuffle(rows)
            group = pa.table(
                {
                    "tile": pa.array([i // tile_docs for i in rows], pa.int32()),
                    "pos": pa.array(rows, pa.int32()),
                    "terms": pa.array([list(docs[i]) for i in rows]),
                    "weights": pa.array([list(docs[i].values()) for i in rows]),
                }
            )
            left, right, n_terms = tiles.read_tiles(group, low, high)
            found = tiles.pairs(left, right, n_terms, threshold)
            got |= {
                (int(a), int(b)): int(s) for a, b, s in zip(found["a"], found["b"], found["sim_nano"])
            }
    assert got == want


def test_tiles_take_large_postings_in_parts(monkeypatch):
    docs = list(corpus(1, 300, words=40).values())
    group = pa.table(
        {
            "tile": pa.array([0] * 300, pa.int32()),
            "pos": pa.array(range(300), pa.int32()),
            "terms": pa.array([list(d) for d in docs]),
            "weights": pa.array([list(d.values()) for d in docs]),
        }
    )
    left, right, n_terms = tiles.read_tiles(group, 0, 0)
    whole = tiles.partial_scores(left, right, n_terms, to_nano(0.03))
    monkeypatch.setattr(tiles, "PRODUCTS", 50)
    monkeypatch.setattr(tiles, "STRIPE", 11)
    parts = tiles.partial_scores(left, right, n_terms, to_nano(0.03))
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


def two_tiles(docs, cut):
    return pa.table(
        {
            "tile": pa.array([int(i >= cut) for i in range(len(docs))], pa.int32()),
            "pos": pa.array(range(len(docs)), pa.int32()),
            "terms": pa.array([list(d) for d in docs]),
            "weights": pa.array([list(d.values()) for d in docs]),
        }
    )


@pytest.mark.parametrize("threshold", [0.0, 0.09, 0.2])
def test_staircases_join(monkeypatch, threshold):
    """Two tiles' staircases give the number of takeovers of both together."""
    monkeypatch.setattr(tiles, "STRIPE", 7)
    docs = list(corpus(3, 60, words=9).values())
    least, reassign = to_nano(0.02), to_nano(threshold)
    group = two_tiles(docs, 25)
    first, second, n_terms = tiles.read_tiles(group, 0, 1)
    parts = [tiles.staircases(first, second, n_terms, least, reassign), tiles.staircases(second, second, n_terms, least, reassign)]
    sims = models.all_pairs(docs, least)
    got = {}
    for part in parts:
        for b, one, most, steps, counts in zip(*(np.asarray(part[k]) if k in ("b", "first_nano", "most_nano") else part[k].to_pylist() for k in part)):
            assert steps == sorted(set(steps)) and all(c > 0 for c in counts)
            before, n = got.get(b, (0, 0))
            n += sum(c for s, c in zip(steps, counts) if s >= before) - (not before and one >= reassign)
            got[b] = (max(before, most), n)
    for b in range(25, 60):
        earlier = [(a, s) for (a, x), s in sims.items() if x == b]
        assert got.get(b, (0, 0)) == (max([0, *(s for _, s in earlier)]), models.takeovers(earlier, reassign))


def test_bound_is_above_all_pairs():
    docs = list(corpus(4, 40, words=30).values())
    tops = [{}, {}]
    for i, doc in enumerate(docs):
        for term, weight in doc.items():
            tops[i >= 20][term] = max(weight, tops[i >= 20].get(term, 0))
    group = pa.table({"terms": pa.array([list(t) for t in tops]), "weights": pa.array([list(t.values()) for t in tops])})
    across = [s for (a, b), s in models.all_pairs(docs, 1).items() if a < 20 <= b]
    assert max(across) <= tiles.bound(group) * 1e9 < 20 * max(across)


def test_tiles_are_cut_by_terms(spark):
    """One document as long as many tiles, among short ones."""
    docs = {d: {f"t{i}": 0.1 for i in range(5_000 if d == 50 else 2 + d % 7)} for d in range(200)}
    params = Params(tile_docs=20, tile_terms=100)
    blocked = similarity.assign_blocks(to_frame(spark, {"c": docs}), [F.col("doc_id")], params)
    found = {}
    for row in blocked.orderBy("pos").collect():
        found.setdefault(row["tile"], []).append(len(row["terms"]))
        assert row["n_tiles"] == 1 + max(r["tile"] for r in blocked.select("tile").collect()) if row["pos"] == 0 else True
    assert sorted(found) == list(range(len(found)))
    for lengths in found.values():
        assert len(lengths) <= 20 and sum(lengths[:-1]) < 100


def test_skipped_tiles_have_no_pairs(spark):
    """Two kinds of documents without a common term, each in tiles of its own."""
    docs = {d: {f"{'a' if d < 40 else 'b'}{d % 5 + i}": 0.3 + d % 3 / 10 for i in range(3)} for d in range(80)}
    params = Params(tile_docs=8, tile_terms=1_000)
    blocked = similarity.assign_blocks(to_frame(spark, {"c": docs}), [F.col("doc_id")], params)
    skipped = {(r["low"], r["high"]) for r in similarity.skipped_tiles(blocked, params).collect()}
    assert skipped == {(a, b) for a in range(5) for b in range(5, 10)}
    pairs = {(r["a"], r["b"]): r["sim_nano"] for r in similarity.similar_pairs(blocked, params).collect()}
    assert pairs == models.all_pairs(list(docs.values()), to_nano(0.08))


@pytest.mark.parametrize("seed", range(2))
def test_one_pass_equals_the_fold(spark, seed):
    """Many collections at once, each checked against the step-by-step model."""
    collections = {f"c{i}": corpus(100 * seed + i, 5 + 3 * i) for i in range(15)}
    params = Params(min_similarity=0.05, reassign_similarity=0.09, tile_docs=8)
    frame = to_frame(spark, collections)
    blocked = similarity.assign_blocks(frame, [F.col("doc_id")], params)
    scored = similarity.scored_documents(blocked, params)
    edges = forest.directed_edges(scored)
    assigned = forest.cluster_pass(scored)
    in_rounds = forest.cluster_pass(scored, in_rounds=True).select(assigned.columns)
    assert in_rounds.exceptAll(assigned).isEmpty() and assigned.exceptAll(in_rounds).isEmpty()

    def grouped(df, key, *value):
        found = {}
        for row in df.collect():
            values = tuple(row[v] for v in value)
            found.setdefault(row["collection_key"], {})[row[key]] = values
        return found

    scores = grouped(forest.used(scored), "pos", "centricity_nano")
    leaders = grouped(scored.filter("leader_pos is not null"), "pos", "leader_pos")
    parents = grouped(edges, "pos", "parent_pos", "parent_nano")
    medoid = grouped(forest.members(assigned), "pos", "medoid_pos", "similarity", "doc_id")
    moved = grouped(similarity.reassignments(blocked, params), "b", "reassigned")
    splices = {r["collection_key"]: r["splices"] for r in forest.splices(assigned).collect()}
    ranks = grouped(forest.medoid_rank(scored), "rank", "pos")

    for name, docs in collections.items():
        kept = [(d, v) for d, v in sorted(docs.items()) if len(v) >= 2]
        sims = models.all_pairs([v for _, v in kept], to_nano(0.05))
        want = models.cluster(len(kept), sims, to_nano(0.09))
        assert scores.get(name, {}) == {d: (c,) for d, c in want["centricity"].items()}
        assert leaders.get(name, {}) == {d: (v,) for d, v in want["leader"].items()}
        assert parents.get(name, {}) == {
            d: (p, sims[min(d, p), max(d, p)]) for d, p in want["parent"].items()
        }
        clusters = {}
        for pos, (root, similar, doc_id) in medoid.get(name, {}).items():
            assert doc_id == kept[pos][0]
            assert (similar == 1.0) == (pos == root) or pos in want["parent"]
            if pos != root:
                clusters.setdefault(root, []).append(pos)
        assert {m: sorted(f) for m, f in clusters.items()} == want["clusters"]
        moves = {d: (want["reassigned"][d],) for d in want["leader"]}
        assert moved.get(name, {}) == moves
        if kept:
            assert (splices.get(name) or 0) == want["splices"]
        order = sorted(want["centricity"], key=lambda d: (want["centricity"][d], -d))
        assert ranks.get(name, {}) == {i + 1: (d,) for i, d in enumerate(order)}


@pytest.mark.parametrize("drop", [False, True])
def test_all_passes_equal_the_lists(spark, drop):
    collections = {f"c{i}": corpus(7 + i, 10 + 6 * i, words=14 + 4 * i) for i in range(8)}
    params = Params(
        min_similarity=0.05, reassign_similarity=0.09, block_size=9, drop_unmerged=drop, tile_docs=4
    )
    merged = textcluster(to_frame(spark, collections), params).merged
    got = {}
    seen = set()
    for row in merged.collect():
        assert (row["collection_key"], row["doc_id"]) not in seen
        seen.add((row["collection_key"], row["doc_id"]))
        members = got.setdefault(row["collection_key"], {}).setdefault(row["label"], [])
        assert row["is_medoid"] == (row["doc_id"] == row["label"])
        if not row["is_medoid"]:
            members.append(row["doc_id"])
    for name, docs in collections.items():
        kept, only_merged = models.passes(docs, 9, to_nano(0.05), to_nano(0.09))
        want = only_merged if drop else kept
        assert {m: sorted(f) for m, f in got.get(name, {}).items()} == {
            m: sorted(f) for m, f in want.items()
        }


def test_a_third_of_the_documents_are_copies(spark):
    """Copies follow one another in a chain as long as their number."""
    docs = {d: {"a": 0.5, "b": 0.5} if d % 3 == 0 else {f"x{d}": 0.4, f"y{d}": 0.4} for d in range(600)}
    params = Params(tile_docs=64)
    merged = textcluster(to_frame(spark, {"c": docs}), params).merged
    rows = merged.collect()
    assert {r["doc_id"] for r in rows} == {d for d in range(600) if d % 3 == 0}
    assert {r["label"] for r in rows} == {0}


def test_nothing_to_cluster(spark):
    empty = to_frame(spark, {"c": {1: {"a": 0.5, "b": 0.5}}})
    assert textcluster(empty).merged.count() == 0


def test_scoring_plan_has_no_term_join(spark):
    frame = to_frame(spark, {"c": corpus(1, 20)})
    blocked = similarity.assign_blocks(frame, [F.col("doc_id")], Params())
    plan = similarity.document_scores(blocked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rebuild_and_rebuild_all(spark, store):
    tables = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = tables.select(
        F.lit("n").alias("namespace"), F.col("lang").alias("collection_key"), "doc_id", "text"
    )
    store.upsert_documents(docs, 1)
    sizes = docs.groupBy("namespace", "collection_key").count().withColumnRenamed("count", "size")
    store.upsert_collections(sizes.withColumn("modified_ms", F.lit(10)), 1)

    done = rebuild(store, "n", "en", 20)
    active = store.active_clusters()
    assert done.exported == docs.filter("collection_key = 'en'").count()
    assert {(r[0], r[1]) for r in active.select("collection_key", "rebuild_ms").collect()} == {("en", 20)}

    rebuild_all(store, 30)
    stamps = active_stamps(store)
    assert stamps == {"en": 20, "de": 30, "es": 30, "fr": 30}
    store.upsert_collections(
        sizes.filter("collection_key = 'en'").withColumn("modified_ms", F.lit(35)), 35
    )
    rebuild_all(store, 40)
    assert active_stamps(store) == {**stamps, "en": 40}
    current = store.active_clusters()
    assert current.count() == current.select("collection_key", "doc_id").distinct().count()
    left = read_vectors(spark, f"{store.root}/runs/40/all/vectorize")
    assert left.schema["vector"].dataType == VectorUDT()
    assert vectors.long_form(unpack(left)).count() == sum(r["vector"].numNonzeros() for r in left.collect()) > 0


def active_stamps(store):
    rows = store.active_clusters().select("collection_key", "rebuild_ms").distinct().collect()
    return {r[0]: r[1] for r in rows}


def test_metrics_of_a_rebuild(spark, store):
    docs = [("n", "c", d, " ".join(f"w{(d * k) % 7 + k % 3}" for k in range(5))) for d in range(60)]
    store.upsert_documents(spark.createDataFrame(docs, "namespace string, collection_key string, doc_id long, text string"), 1)
    params = Params(min_support=1, min_df=1, block_size=25, min_similarity=0.2)
    told = rebuild(store, "n", "c", 5, params, metrics=True).metrics
    assert list(told) == ["blocks", "rest", "medoids"] and told["blocks"]["documents"] > told["medoids"]["documents"]
    for counts in told.values():
        assert set(counts) == {"documents", "used", "splices", "reassigned"}
        assert counts["documents"] >= counts["used"] >= counts["splices"] >= 0 <= counts["reassigned"]
    assert rebuild(store, "n", "c", 6, params).metrics == {}


def test_roots_in_rounds(spark, monkeypatch):
    """A deep chain, a star, two blocks with the same positions; few rounds."""
    chain = [("n", "c", 0, i, i - 1) for i in range(1, 600)]
    star = [("n", "c", 1, i, 7) for i in range(300) if i != 7] + [("n", "c", 1, 7, 900)]
    edges = spark.createDataFrame(
        chain + star, "namespace string, collection_key string, block_id bigint, pos int, parent_pos int"
    ).repartition(5)
    rounds = []
    staged = forest.stage
    monkeypatch.setattr(forest, "stage", lambda df, name: rounds.append(name) or staged(df, name))
    found = {(r["block_id"], r["pos"]): r["root_pos"] for r in forest.roots(edges).collect()}
    assert found == {(0, i): 0 for i in range(600)} | {(1, i): 900 for i in [*range(300), 900]}
    assert rounds.count("hops") <= 11
    assert forest.roots(edges.limit(0)).count() == 0


def test_panels_equal_tiles():
    """Tiles of a panel are taken together, or one by one, with the same result."""
    docs = list(corpus(5, 90, words=30).values())
    rows = list(range(90))
    random.Random(1).shuffle(rows)
    group = pa.table(
        {
            "panel": pa.array([i // 45 for i in rows], pa.int32()),
            "tile": pa.array([i // 7 if i < 45 else 7 + (i - 45) // 4 for i in rows], pa.int32()),
            "pos": pa.array(rows, pa.int32()),
            "terms": pa.array([list(docs[i]) for i in rows]),
            "weights": pa.array([list(docs[i].values()) for i in rows]),
        }
    )
    threshold = to_nano(0.03)
    want = models.all_pairs(docs, threshold)
    for most in (1, 10, 1_000):
        tiles_before, tiles.TILE_DOCS = tiles.TILE_DOCS, most
        try:
            got = {}
            for low, high in ((0, 0), (0, 1), (1, 1)):
                found = tiles.pairs_of_panels(*tiles.read_panels(group, low, high), threshold)
                got |= {(a, b): s for a, b, s in zip(*(found[c].tolist() for c in ("a", "b", "sim_nano")))}
        finally:
            tiles.TILE_DOCS = tiles_before
        assert got == want


@pytest.mark.parametrize("tile_terms", [20, 1_000_000])
def test_vectors_travel_once_for_a_panel_not_for_every_tile(spark, tile_terms):
    """Fails where each vector is sent once for every small tile of its block."""
    params = Params(tile_docs=2, tile_terms=tile_terms, min_similarity=0.05)
    blocked = similarity.assign_blocks(to_frame(spark, {"c": corpus(1, 200)}), [F.col("doc_id")], params)
    n_docs = blocked.count()
    n_tiles = blocked.first()["n_tiles"]
    size = similarity._panels(blocked)
    assert n_tiles > 50
    assert similarity._spread(blocked, size).count() <= 4 * n_docs


def test_vectors_stay_in_their_files(spark, monkeypatch):
    """Failed where a pass sorted the vectors and wrote them again to number their documents."""
    texts = [("n", f"c{d % 2}", d, " ".join(f"w{d * k % 11 + k % 3}" for k in range(d % 5 + 1))) for d in range(700)]
    docs = spark.createDataFrame(texts, "namespace string, collection_key string, doc_id long, text string")
    params = Params(min_support=1, min_df=1, block_size=100, min_similarity=0.9, tile_docs=16)
    made = vectorize(docs, params).vectors
    written = {}

    def staged(df, name):
        written.setdefault(name, set()).update(df.columns)
        return stage(df, name)

    for module in (index, similarity, vectors):
        monkeypatch.setattr(module, "stage", staged)
    passes = block_and_rest(made, params)
    assert {"sorted", "places", "cuts"} <= set(written)
    assert not any({"weights", "terms", "term_ids"} & columns for columns in written.values())
    for done in passes:
        plan = done.blocked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    # positions count the documents of a block in their order, whatever files they are in
    window = Window.partitionBy("collection_key").orderBy("doc_id")
    want = made.where("size(term_ids) >= 2").select("collection_key", "doc_id", (F.row_number().over(window) - 1).alias("at"))
    got = passes[0].blocked.select("collection_key", "doc_id", F.expr("block_id * 100 + pos").alias("at"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(similarity, "MAX_BROADCAST_PLACES", 0)
    joined = similarity.assign_blocks(made, [F.col("doc_id")], params).select(passes[0].blocked.drop("stored_at").columns)
    assert joined.exceptAll(passes[0].blocked.drop("stored_at")).isEmpty() and joined.count() == got.count()


def test_tile_bounds_in_panels(spark, monkeypatch):
    """Bounds of all pairs of tiles, however many panels the tiles are in."""
    params = Params(tile_docs=8, tile_terms=1_000)
    blocked = similarity.assign_blocks(to_frame(spark, {"c": corpus(2, 90)}), [F.col("doc_id")], params)

    def bounds():
        return {(r["low"], r["high"]): round(r["bound"], 9) for r in similarity.tile_bounds(blocked).collect()}

    whole = bounds()
    n = blocked.first()["n_tiles"]
    assert set(whole) == {(i, j) for i in range(n) for j in range(i + 1, n)}
    monkeypatch.setattr(similarity, "PANEL_TILES", 3)
    assert bounds() == whole


def test_greatest_weights_of_tiles_take_one_exchange(spark, monkeypatch):
    """Every term of every vector was exchanged with its keys, and the tiles' terms once more."""
    params = Params(tile_docs=8, tile_terms=1_000)
    blocked = similarity.assign_blocks(to_frame(spark, {"c": corpus(2, 90)}), [F.col("doc_id")], params)
    plans = {}

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        return stage(df, name)

    monkeypatch.setattr(similarity, "stage", staged)
    assert similarity.tile_bounds(blocked).count() > 0
    assert plans["tops"].count("Exchange hashpartitioning") == 1


def test_bounds_take_vectors_as_bytes(spark, monkeypatch):
    """Failed where tiles' terms and weights, 12 bytes each, were exchanged, stored and exchanged again."""
    texts = [("n", "c", d, " ".join(f"w{d * k % 11 + k % 3}" for k in range(d % 9 + 1))) for d in range(200)]
    docs = spark.createDataFrame(texts, "namespace string, collection_key string, doc_id long, text string")
    params = Params(min_support=1, min_df=1, tile_docs=4, tile_terms=100)
    blocked = similarity.assign_blocks(vectorize(docs, params).vectors, [F.col("doc_id")], params)

    def bounds(rows):
        return {(r["low"], r["high"]): round(r["bound"], 9) for r in similarity.tile_bounds(rows).collect()}

    want = bounds(blocked.drop("compact"))
    assert len(want) > 500 and max(want.values()) > 0

    def staged(df, name):
        assert "terms" not in df.columns
        return stage(df, name)

    monkeypatch.setattr(similarity, "stage", staged)
    for most in (4_096, 7):
        monkeypatch.setattr(similarity, "PANEL_TILES", most)
        assert bounds(blocked) == want


def test_counts_take_one_exchange_with_a_constant_key(spark):
    """A constant namespace made the counts exchange every term once more."""
    docs = to_frame(spark, {"c": {1: {}}}).select(
        F.lit("n").alias("namespace"), "collection_key", "doc_id", F.lit("one two two").alias("text")
    )
    for made in (vectors.term_frequency(docs), grams.gram_frequency(docs, 3)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
        assert made.count() > 0


def test_vectors_as_bytes():
    pick = random.Random(3)
    docs = [sorted(pick.sample(range(100_000), n)) for n in (0, 5, 1, 300, 0, 2)]
    df = [[2_000_000 // (t + 1) + 1 for t in doc] for doc in docs]
    tf = [[pick.choice([1, 1, 2, 127, 128, 20_000]) for _ in doc] for doc in docs]
    packed = compact.encode(*(pa.array(x, pa.list_(pa.int32())) for x in (docs, df, tf)))
    for first, end in ((0, 6), (1, 4), (4, 5), (3, 3)):
        length, *columns = compact.decode(packed[first:end])
        assert length.tolist() == [len(doc) for doc in docs[first:end]]
        assert [x.tolist() for x in columns] == [sum(x[first:end], []) for x in (docs, df, tf)]
    with pytest.raises(ValueError):
        compact.encode(*(pa.array([x]) for x in ([1, 2], [3, 4], [1, 1])))


def test_vectors_are_exchanged_as_bytes(spark):
    """Failed where panels got 4 bytes for the number of a term and 8 for its weight."""
    texts = [("n", f"c{d % 2}", d, " ".join(f"w{d * k % 11 + k % 3}" for k in range(d % 9 + 1))) for d in range(300)]
    docs = spark.createDataFrame(texts, "namespace string, collection_key string, doc_id long, text string")
    params = Params(min_support=1, min_df=1, block_size=100, min_similarity=0.1, tile_docs=16)
    made = vectorize(docs, params).vectors
    for row in made.collect():
        length, terms, weight = compact.entries(pa.array([row["compact"].asDict()]))
        assert terms.tolist() == row["term_ids"] and weight == pytest.approx(row["weights"], rel=1e-14)
    blocked = similarity.assign_blocks(made, [F.col("doc_id")], params)
    assert not {"terms", "weights"} & set(similarity._spread(blocked, 2).columns)
    plain = similarity.assign_blocks(made.drop("compact"), [F.col("doc_id")], params)
    for scores in (similarity.similar_pairs, similarity.document_scores):
        got = scores(blocked, params)
        assert got.exceptAll(scores(plain, params)).isEmpty() and got.count() > 100
    blocks, rest = block_and_rest(made, params)
    # numbering and cutting read no vectors: failed where lengths were those of the lists
    lengths = blocks.blocked.select("pos", vectors.n_terms(blocks.blocked).alias("n_terms"))
    plan = lengths._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan.split("ReadSchema: ")[1].split("\n")[0] and "n_terms" in plan
    assert lengths.agg(F.sum("n_terms")).first()[0] == made.where("size(term_ids) >= 2").agg(F.sum(F.size("term_ids"))).first()[0]
    assert "compact" in rest.blocked.columns and "compact" not in blocks.assigned.columns
