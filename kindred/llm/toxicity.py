"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence is toxic with probability sigmoid(bias + weights of its distinct words), and a
document unless none of its sentences is: noisy-or. A word weighs as much as its parts: the
word itself, its beginnings and its endings. Weights are fitted to the labels of
documents through noisy-or, after which the sentences that offend can be told.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+")
MAX_DOCS = 6_000
"""About so many labelled documents are learned from; every document is scored."""
MIN_DOCS = 4  # a part of the model occurs in so many of these
LEAST_SIGNAL = 3.0  # standard errors by which a part's shares of toxic and other documents differ
PARTS = range(3, 8)  # letters of beginnings and endings
KNOWN_WORDS = 500_000
SPANS = T.ArrayType(
    T.StructType()
    .add("start", T.IntegerType())
    .add("length", T.IntegerType())
    .add("probability", T.DoubleType())
)
ROUNDS, STEP, DECAY = 200, 0.1, 1e-4


def parts(word: str) -> list[str]:
    """The word, and what it begins and ends with."""
    sizes = [n for n in PARTS if n < len(word)]
    return [f"={word}", *(f"^{word[:n]}" for n in sizes), *(f"{word[-n:]}$" for n in sizes)]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def weight(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            value = self.known[word] = sum(x for p in parts(word) if (x := self.weights.get(p)))
        return value

    def sentences(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans (start, end) of the sentences and their probabilities, over the whole text."""
        spans, values = [], []
        for found in SENTENCE.finditer((text or "").lower()):
            words = set(WORDS.findall(found[0]))
            if words:
                spans.append(found.span())
                values.append(self.bias + sum(map(self.weight, words)))
        return spans, 1 / (1 + np.exp(-np.clip(values, -500, 500)))


def noisy_or(probabilities: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(probabilities, 1 - 1e-12)).sum()))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Maximum likelihood of the documents' labels under noisy-or, by Adam on all at once."""
    same: dict[str, str] = {}  # one object per word
    docs = [
        [tuple({same.setdefault(w, w) for w in WORDS.findall(s)}) for s in SENTENCE.findall((t or "").lower())]
        for t in texts
    ]
    docs = [[s for s in d if s] for d in docs]
    vocabulary = _telling_parts(docs, toxic)
    column: dict[str, list[int]] = {}
    sentence, word, owner = [], [], []
    for k, d in enumerate(docs):
        for s in d:
            for w in s:
                if w not in column:
                    column[w] = [i for p in parts(w) if (i := vocabulary.get(p)) is not None]
                word += column[w]
                sentence += [len(owner)] * len(column[w])
            owner.append(k)
    sentence, word, owner = (np.array(x, dtype=np.int64) for x in (sentence, word, owner))
    y = np.array(toxic, dtype=np.float64)
    if not len(owner) or y.min() == y.max():
        return Model(20.0 if len(y) and y.min() == 1 else -20.0, {})
    w = np.zeros(len(vocabulary) + 1)  # the last one is the bias
    w[-1] = np.log(max(y.mean(), 1e-3) / np.bincount(owner).mean())
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        z = w[-1] + np.bincount(sentence, w[word], minlength=len(owner))
        p = 1 / (1 + np.exp(-z))
        total = np.maximum(np.bincount(owner, np.logaddexp(0, z), minlength=len(y)), 1e-9)
        slope = p * ((1 - y) - y / np.expm1(np.minimum(total, 500)))[owner]
        gradient = np.append(np.bincount(word, slope[sentence], minlength=len(vocabulary)), slope.sum()) / len(y)
        gradient[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= STEP * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    names = list(vocabulary)
    return Model(float(w[-1]), {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:-1]) > 1e-6)})


def _telling_parts(docs: list[list[tuple[str, ...]]], toxic: list[int]) -> dict[str, int]:
    """All parts whose shares of documents differ by ``LEAST_SIGNAL`` standard errors or more."""
    counts = {True: Counter(), False: Counter()}
    for d, y in zip(docs, toxic):
        counts[y > 0].update({p for w in set().union(*d) for p in parts(w)})
    n1 = max(1, sum(y > 0 for y in toxic))
    n0 = max(1, len(toxic) - n1)
    signal = {}
    for p in counts[True].keys() | counts[False].keys():
        a, b = counts[True][p], counts[False][p]
        if a + b >= MIN_DOCS:
            share = (a + b + 1) / (n1 + n0 + 2)
            signal[p] = abs(a / n1 - b / n0) / (share * (1 - share) * (1 / n1 + 1 / n0)) ** 0.5
    return {p: i for i, p in enumerate(sorted(p for p, x in signal.items() if x >= LEAST_SIGNAL))}


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> Model:
    """A model from the rows of ``docs`` that ``labels (doc_id, toxic)`` has.

    Null ids and labels teach nothing; of several labels of one id the greatest counts, of
    several rows the least text. A hash of the id picks the sample, whose size ``MAX_DOCS`` bounds.
    """
    told = labels.where(f"{id_column} IS NOT NULL AND toxic IS NOT NULL").groupBy(id_column).agg(F.max("toxic").alias("toxic"))
    share = 1.0 * MAX_DOCS / max(1, told.count())
    dice = F.pmod(F.xxhash64(F.col(id_column), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = told.where(dice < share)  # about MAX_DOCS rows, so small enough to broadcast
    drawn = docs.select(id_column, "text").join(F.broadcast(sample), id_column)
    # an id that is repeated comes once
    rows = drawn.groupBy(id_column).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toPandas()
    rows = rows.sort_values(id_column)
    return fit(rows["text"].tolist(), (rows["toxic"] > 0).astype(int).tolist())


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (noisy-or over the sentences) and ``sentences`` that offend.

    ``sentences`` are the spans with a probability of ``offending`` or more, most probable
    first. A text without words (null, empty) scores 0. Columns of these names are
    replaced; others, and repeated rows, stay.
    """
    docs = docs.drop("score", "sentences")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("sentences", SPANS)]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(
        partial(_score, shared=shared, column=docs.columns.index("text"), offending=offending), schema
    )


def _score(batches, shared, column: int, offending: float) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("probability", pa.float64())]))
    for whole in batches:
        for at in range(0, len(whole), 1024):
            batch = whole.slice(at, 1024)
            scores, found = [], []
            for text in batch.column(column).to_pylist():
                spans, p = model.sentences(text)
                scores.append(noisy_or(p))
                worst = sorted((i for i in np.flatnonzero(p >= offending)), key=lambda i: -p[i])
                found.append(
                    [{"start": spans[i][0], "length": spans[i][1] - spans[i][0], "probability": p[i]} for i in worst]
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(found, kind)],
                [*batch.schema.names, "score", "sentences"],
            )
