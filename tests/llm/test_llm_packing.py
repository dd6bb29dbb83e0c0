import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
CACHED = packing.Encoder(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé 1.\n\t   \0中<|endoftext|>"), max_size=40), max_size=4))
def test_words_are_encoded_as_in_their_text(texts):
    for encoder in (CACHED, packing.Encoder(PATH)):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)


def test_names_of_added_tokens_and_words_of_all_kinds():
    assert ids_of("<|endoftext|>") == [50256]
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "end\n", "end\n next", "tab\tin word", "\u0120 \u0120x y", "a\u00a0b c", "中文字 テスト", "don't 12ab c.d,e"]
    texts += [" ".join(f"{a}{b}" for a in "ab1.é\n" for b in ("x", "'s", "\n", "..", "９")), "p " * 9_000 + "q"]
    for some in (texts, texts[::-1], *([t] for t in texts)):
        for text, ids in zip(some, packing.Encoder(PATH).encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text), text


def test_every_character_is_cut_alike():
    assert CACHED.fast is not None
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 1 << 14):
        text = " ".join(f"a{c}1{c} {c}{c}b" for c in every[at : at + (1 << 14)])
        assert np.frombuffer(CACHED.encode([text])[0], "<u4").tolist() == ids_of(text)


def test_other_tokenizers_run_as_they_are(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        config = json.load(file)
    text = "Hello  world's <|endoftext|> ﬁn"
    changes = {
        "normalizer": {"type": "NFKC"}, "pre_tokenizer": {**config["pre_tokenizer"], "add_prefix_space": True},
        "model": {**config["model"], "merges": config["model"]["merges"][1:] + config["model"]["merges"][:1]},
    }
    for name, value in changes.items():
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump({**config, name: value}, file)
        encoder = packing.Encoder(path)
        assert encoder.fast is None
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 2_500), (100, 4, 3_000)])
def test_best_fit_equals_a_plain_search(select, limits):
    """Every bin there is, tried for each piece in turn."""
    capacity = packing.Capacity(*limits, weights=(1.0, 0.5, 0.25), select=select)
    dice = np.random.default_rng(sum(limits))
    for n in (0, 1, 40, 300):
        lengths = dice.integers(1, capacity.piece + 1, n)
        bins, offsets = packing.best_fit(lengths, capacity)
        rooms, want = [], np.zeros((n, 2), np.int64)
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            need = (int(lengths[i]), 1, int(lengths[i]) ** 2)
            fits = [k for k, room in enumerate(rooms) if all(x >= y for x, y in zip(room, need))]
            if select == "norm":
                cost = {k: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(capacity.weights, rooms[k], need, limits)) for k in fits}
            else:
                cost = {k: -sum(w * x * y / c**2 for w, x, y, c in zip(capacity.weights, rooms[k], need, limits)) for k in fits}
            if fits:
                best = min(cost.values())
                assert abs(cost.get(bins[i], np.inf) - best) < 1e-9, (i, bins[i])  # equal ones may change places
                at = int(bins[i])
            else:
                at = len(rooms)
                rooms.append(list(limits))
            want[i] = at, limits[0] - rooms[at][0]
            rooms[at] = [x - y for x, y in zip(rooms[at], need)]
        assert want[:, 0].tolist() == bins.tolist() and want[:, 1].tolist() == offsets.tolist()


def check_packing(rows, capacity):
    of = {}
    for r in rows:
        of.setdefault(r["sequence_id"], []).append(r)
    for pieces in of.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity.tokens and len(pieces) <= capacity.documents
        assert sum(r["length"] ** 2 for r in pieces) <= capacity.attention
    return len(of)


@pytest.mark.parametrize(
    "capacity",
    [packing.Capacity(), packing.Capacity(select="dot"), packing.Capacity(documents=3), packing.Capacity(attention=300_000)],
)
def test_pack(spark, capacity):
    texts = [None, "", "a b", *(" ".join(f"word{i * j}" for i in range(13 * j)) for j in range(60)), "x " * 40_000]
    docs = spark.createDataFrame(
        [(i, t, "z") for i, t in enumerate(texts)] + [(5, texts[5], "z"), (None, "no id", "z")],
        "doc_id long, text string, length string",
    )
    rows = packing.pack(docs, PATH, capacity=capacity).collect()
    check_packing(rows, capacity)
    for i, text in enumerate(texts):
        if i == 5:
            continue  # twice
        want = [*ids_of(text), 2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.length for r in mine][1:] == [capacity.piece] * (len(mine) - 1)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == want
    assert sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_few_sequences_and_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 500)
    dice = np.random.default_rng(1)
    lengths = np.minimum(dice.geometric(1 / 250, 3_000), 1024)
    frame = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    for order in (None, [F.col("doc_id")]):
        rows = packing.place(frame.repartition(7), order=order).collect()
        assert len(rows) == 3_000
        n = check_packing(rows, packing.Capacity())
        assert n <= 1.02 * lengths.sum() / 1024 + 12
    position = sorted(rows, key=lambda r: r.sequence_id)  # by the order: stretches of 500 follow each other
    assert [r.doc_id // 500 for r in position] == sorted(r.doc_id // 500 for r in position)


def test_best_fit_prefers_the_fullest():
    bins, offsets = packing.best_fit(np.array([700, 600, 400, 320, 24]), packing.Capacity())
    assert bins.tolist() == [0, 1, 1, 0, 1] and offsets.tolist() == [0, 0, 600, 700, 1000]


def test_digest_is_that_of_the_ids(spark):
    docs = spark.createDataFrame([(1, "to be or not to be")], "doc_id long, text string")
    row = packing.token_pieces(docs, PATH).select("*", F.crc32("ids").alias("crc")).first()
    assert row.crc == zlib.crc32(np.array([*ids_of("to be or not to be"), 2], "<u4").tobytes())


def test_wrong_capacities():
    for wrong in ({"tokens": 0}, {"select": "first"}):
        with pytest.raises(ValueError):
            packing.Capacity(**wrong)
