import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm import kneser_ney, langid, toxicity
from kindred.llm.shelf import shelve

LETTERS = {"aa": "abcdeo", "bb": "bcdxyu", "cc": "éñíoab"}


def speech(dice, lang, n):
    return " ".join("".join(dice.choices(LETTERS[lang], k=dice.randrange(2, 7))) for _ in range(n))


def test_language_held_out(spark):
    dice = random.Random(1)
    rows = [(i, speech(dice, lang, dice.randrange(8, 60)), lang) for i, lang in enumerate(dice.choices(list(LETTERS), k=400))]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 34 !?", "cc"), (403, rows[0][1], None), (404, "ab", None), (None, rows[1][1], "aa")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.train(docs.where("doc_id % 3 <> 1"))
    found = langid.predict(docs, model).collect()
    assert len(found) == len(rows)
    of = {r.doc_id: r for r in found}
    tested = [i for i in range(400) if i % 3 == 1]
    assert sum(of[i].lang_pred == rows[i][2] for i in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)
    for i in (400, 401, 402):
        assert of[i].lang_pred == "und" and of[i].score == 0
    assert of[404].lang_pred in LETTERS
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_language_learns_from_different_texts(spark, monkeypatch):
    dice = random.Random(2)
    monkeypatch.setattr(langid, "PER_LANGUAGE", 40)
    learned = {}
    monkeypatch.setattr(langid, "fit", lambda grams, langs: learned.update(grams=grams, langs=langs))
    copies = [speech(dice, "aa", 30) for _ in range(3)]
    few = [speech(dice, "aa", 30) for _ in range(20)]
    many = [speech(dice, "bb", 30) for _ in range(300)]
    rows = [(t, "aa") for t in copies * 1000 + few + ["1 2", None]] + [(t, "bb") for t in many + many[:1] * 2000]
    langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(7))
    told = list(zip(learned["langs"], (tuple(g) for g in learned["grams"])))
    assert {g for n, g in told if n == "aa"} == {tuple(langid.presence(t)) for t in copies + few}
    assert learned["langs"].count("aa") == 23 and learned["langs"].count("bb") == 40
    assert len(set(told)) == 63


def test_folded_matrix_is_the_kernel_machine():
    dice = random.Random(4)
    texts = [speech(dice, lang, 12) for lang in ("aa", "bb", "cc") * 8]
    grams = [langid.presence(t) for t in texts]
    kernel = np.array([[len(np.intersect1d(a, b)) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    model = langid.fit(grams, ["aa", "bb", "cc"] * 8)
    # all texts are landmarks here, so Nyström is exact and ridge regression has a closed form
    target = np.array([[1.0 if a == b else -1.0 for b in model.languages] for a in ["aa", "bb", "cc"] * 8])
    exact = kernel @ np.linalg.solve(kernel + langid.RIDGE * np.eye(24), target)
    assert np.allclose(model.scores(grams), exact, atol=2e-3)


def test_presence_of_long_texts():
    text = speech(random.Random(3), "aa", 90_000)
    assert np.array_equal(langid.presence(text), np.unique(np.concatenate([langid.presence(text), langid.presence(text[:1000])])))
    assert len(langid.presence("")) and not langid.has_letter("1 2") and langid.has_letter("1é")


def toxic_rows(n):
    dice = random.Random(9)
    words = ["".join(dice.choices("abcdefgh", k=5)) for _ in range(200)]
    bad = ["grumble", "grumbly", "grumbled", "snarkzz"]
    rows = []
    for i in range(n):
        sentences = [" ".join(dice.choices(words, k=7)) for _ in range(dice.randrange(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            sentences.insert(dice.randrange(len(sentences) + 1), " ".join([*dice.choices(words, k=4), dice.choice(bad)]))
        rows.append((i, ". ".join(sentences), int(toxic)))
    return rows


def test_toxicity_held_out_and_spans(spark):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(600, None), (601, ""), (None, "x"), (0, rows[0][1])], "doc_id long, text string")
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    told = [(i, y) for i, _, y in rows if i not in held] + [(None, 1), (1, None)]
    model = toxicity.train(docs, spark.createDataFrame(told, "doc_id long, toxic int"))
    found = toxicity.score(docs, model).collect()
    assert len(found) == 604
    of = {r.doc_id: r for r in found if r.doc_id is not None}
    assert sum((of[i].score >= 0.5) == rows[i][2] for i in held) >= 0.97 * len(held)
    assert of[600].score == 0 and of[601].score == 0
    for i in held:
        if rows[i][2] and of[i].sentences:
            span = of[i].sentences[0]
            assert any(w in rows[i][1][span.start : span.start + span.length] for w in ("grumbl", "snarkzz"))
    assert toxicity.score(docs.limit(0), model).count() == 0
    silent = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, silent).collect())


def test_noisy_or():
    assert toxicity.noisy_or(np.array([0.5, 0.2])) == pytest.approx(1 - 0.5 * 0.8)
    assert toxicity.noisy_or(np.zeros(0)) == 0


# --- Kneser-Ney, by definition ----------------------------------------------------------


def brute_model(texts):
    order = kneser_ney.ORDER
    counts = {order: Counter()}
    for t in texts:
        padded = kneser_ney.BEGIN + t
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in counts[k + 1]:
            before[g[1:]].add(g[0])
        counts[k] = Counter({g: len(s) for g, s in before.items()})

    def discount(k):
        n = Counter(counts[k].values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) for i in (1, 2, 3)]

    rates = {k: discount(k) for k in counts}
    followers = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            followers[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 256
        k, lower = len(g), p(g[1:])
        after = followers[k].get(g[:-1])
        if not after:
            return lower
        total, c, d = sum(after), counts[k].get(g, 0), rates[k]
        kept = sum(d[min(x, 3) - 1] for x in after) / total
        return (max(c - d[min(c, 3) - 1], 0) / total if c else 0) + kept * lower

    return p


@pytest.mark.parametrize("files", [True, False])
def test_kneser_ney_by_definition(spark, monkeypatch, tmp_path, files):
    """Chunks of a few rows, cut by tasks; texts in files and not; columns of clashing names."""
    monkeypatch.setattr(kneser_ney, "CHUNK_ROWS", 5)
    monkeypatch.setattr(kneser_ney, "HELD", 100)
    monkeypatch.setattr(kneser_ney.windows, "__defaults__", (7,))
    dice = random.Random(8)
    rows = [(i, speech(dice, lang, dice.randrange(5, 30)), lang) for i, lang in enumerate(dice.choices(list(LETTERS), k=40))]
    rows += [(40, None, "aa"), (41, " ", "bb"), (42, "#### ZZZZ %%", "aa"), (43, "words", None), (44, "alone", "dd"), (0, rows[0][1], rows[0][2]), (None, "abc", "aa")]
    docs = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, threshold int, _metadata int, chunk int"
    )
    if files:
        docs.repartition(3).write.option("parquet.block.size", 1).parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    trusted = [i for i in range(40) if i % 2] + [None, 41]
    found = kneser_ney.classify(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    assert len(found) == len(rows)
    models = {
        lang: brute_model([t.encode() for i, t, x in rows if i in trusted and x == lang and i is not None and t.strip()])
        for lang in ("aa", "bb", "cc", "dd", None)
    }
    assert sum(r.doc_id == 0 for r in found) == 2
    for r in found:
        text, lang = next((t, x) for i, t, x in rows if i == r.doc_id)
        data = kneser_ney.BEGIN + " ".join((text or "").split()).encode()
        order = kneser_ney.ORDER
        logs = [math.log(models[lang](data[i : i + order])) for i in range(len(data) - order + 1)]
        want = -sum(logs) / len(logs) if logs else 0.0
        assert r.log_perplexity == pytest.approx(want, abs=2e-5), r
        assert r.lang == (lang or "und")
    of = {r.doc_id: r for r in found}
    assert not of[42].kept and of[40].kept and of[41].kept and of[44].kept and of[44].threshold is None
    assert all(of[i].kept for i in trusted if i is not None)
    assert kneser_ney.classify(docs.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


def test_shelf_gives_each_key_its_rows(spark):
    rows = [(k, i, f"{k}:{i}") for k in (-9, -1, 0, 3, 2**62) for i in range(k % 5 + 1)]
    shelf = shelve(spark.createDataFrame(rows, "key long, i int, v string").repartition(3), 5)
    assert shelf.folders == 2
    for key in (-9, -1, 0, 3, 2**62):
        assert [tuple(r.values()) for r in shelf.rows(key).to_pylist()] == [(i, v) for k, i, v in rows if k == key]
    assert not shelf.rows(4) and not shelf.rows(5)
    nothing = shelve(spark.createDataFrame([], "key long, i int"), 0)
    assert nothing.rows(1) is None


def test_probabilities_of_a_context_add_up():
    p = brute_model([b"abracadabra abrab", b"cab bad"])
    assert sum(p(b"abra" + bytes([i])) for i in range(256)) == pytest.approx(1)


def plain_probabilities(text, weights, bias):
    """One by one, of the sentences with a word."""
    out = []
    for sentence in re.split(r"[.!?\n]", text.lower()):
        words = set(re.findall(r"[^\W\d_]+", sentence))
        if words:
            z = bias + sum(weights.get(p, 0.0) for w in words for p in toxicity.parts(w))
            out.append(1 / (1 + math.exp(-z)))
    return out


def test_toxicity_equals_a_plain_computation(monkeypatch):
    """Scores by the formula; a fit of some rounds by differences of the likelihood."""
    rows = [(t + ". " * (i % 3), y) for i, t, y in toxic_rows(40)]
    monkeypatch.setattr(toxicity, "LEAST_SIGNAL", 2.5)
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    monkeypatch.setattr(toxicity, "DECAY", 0.01)
    texts, labels = zip(*rows)
    model = toxicity.fit(list(texts), list(labels))
    for text in texts:
        want = plain_probabilities(text, model.weights, model.bias)
        assert model.sentences(text)[1] == pytest.approx(want)
        assert toxicity.noisy_or(model.sentences(text)[1]) == pytest.approx(1 - math.prod(1 - p for p in want))

    # the same parts, from scratch
    with_part = lambda p: [any(p in toxicity.parts(w) for w in re.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    names = []
    n1, n0 = sum(labels), len(labels) - sum(labels)
    for p in sorted({p for t in texts for w in re.findall(r"[^\W\d_]+", t.lower()) for p in toxicity.parts(w)}):
        has = with_part(p)
        a, b = (sum(h for h, y in zip(has, labels) if y == k) for k in (1, 0))
        share = (a + b + 1) / (n1 + n0 + 2)
        if a + b >= toxicity.MIN_DOCS and abs(a / n1 - b / n0) >= 2.5 * math.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)):
            names.append(p)
    assert set(model.weights) <= set(names) and len(names) >= 5

    def loss(w):
        total = 0.0
        for text, y in rows:
            safe = math.prod(1 - p for p in plain_probabilities(text, dict(zip(names, w)), w[-1]))
            total -= math.log(max(1 - safe, 1e-12)) if y else math.log(safe)
        return total / len(rows) + 0.01 / 2 * sum(x * x for x in w[:-1])

    n_sentences = sum(len(plain_probabilities(t, {}, 0.0)) for t in texts) / len(texts)
    w = [0.0] * len(names) + [math.log(n1 / len(labels) / n_sentences)]
    first, second = [0.0] * len(w), [0.0] * len(w)
    for k in range(1, 4):
        slope = []
        for i in range(len(w)):
            up, down = ([x + (j == i) * s for j, x in enumerate(w)] for s in (1e-5, -1e-5))
            slope.append((loss(up) - loss(down)) / 2e-5)
        first = [0.9 * a + 0.1 * g for a, g in zip(first, slope)]
        second = [0.999 * a + 0.001 * g * g for a, g in zip(second, slope)]
        w = [x - toxicity.STEP * a / (1 - 0.9**k) / (math.sqrt(b / (1 - 0.999**k)) + 1e-8) for x, a, b in zip(w, first, second)]
    assert model.bias == pytest.approx(w[-1], abs=1e-3)
    for name, value in zip(names, w):
        assert model.weights.get(name, 0.0) == pytest.approx(value, abs=1e-3)


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(texts) or toxicity.Model(0.0, {}))
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "concat('text ', id % 7) AS text").union(spark.createDataFrame([(2, "b")], "doc_id long, text string"))
    toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert seen == [["text 0", "b"]]


def test_many_toxic_words_all_count():
    """More telling words than any fixed number of places."""
    dice = random.Random(2)
    bad = ["z" + "".join(dice.choices("abcdefghij", k=7)) for _ in range(150)]
    good = ["".join(dice.choices("klmnopqrst", k=6)) for _ in range(300)]
    texts, labels = [], []
    for i in range(4_500):
        words = dice.choices(good, k=8)
        labels.append(int(i % 2 == 0))
        texts.append(" ".join([*words, *([bad[i // 2 % 150]] if i % 2 == 0 else [])]))
    model = toxicity.fit(texts, labels)
    assert all(model.weight(w) > 1 for w in bad)
