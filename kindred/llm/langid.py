"""Language identification with string kernels.

Texts are compared by the blended spectrum of presence: which n-grams of characters, from
``SIZES``, occur in both, divided by the root of how many each has. Nyström landmarks
turn the kernel into features, and kernel ridge regression, one language versus the rest,
is solved on them. Since a kernel value is a dot product of presence vectors, landmarks and
weights fold into one matrix, and a batch of texts is scored by its sparse presence
matrix times that one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.staging import stage

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 17
PER_LANGUAGE = 400
"""So many different texts of each language are learned from, those of the smallest hashes;
the model is fitted on this sample, and every text is scored."""
LANDMARKS = 256
MAX_LANGUAGES = 1000
RIDGE = 0.1
UNKNOWN = "und"
SPACES = re.compile(r"[\W\d_]+")


def presence(text: str) -> np.ndarray:
    """Sorted hashed n-grams of the whole text: letters in lower case, else single spaces."""
    data = SPACES.sub(" ", f" {text} ".lower())
    points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    found = np.zeros(0, dtype=np.uint64)
    for start in range(0, len(points), 1 << 18):
        part = points[start : start + (1 << 18) + max(SIZES)]
        grams = [found]
        code = np.zeros(len(part), dtype=np.uint64)
        for size in range(1, max(SIZES) + 1):
            code = code[: len(part) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + part[size - 1 :] + np.uint64(1)
            if size in SIZES and len(code):
                mixed = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                grams.append(mixed >> np.uint64(64 - BUCKETS.bit_length() + 1))
        found = np.unique(np.concatenate(grams))
    return found.astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(x.isalpha() for x in text)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    matrix: np.ndarray  # n-gram by language

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Regression values of a batch, text by language."""
        out = np.zeros((len(grams), len(self.languages)))
        lengths = np.array([len(x) for x in grams])
        full = np.flatnonzero(lengths)
        if len(full):
            rows = self.matrix[np.concatenate(grams)]
            starts = np.r_[0, np.cumsum(lengths[full])[:-1]]
            out[full] = np.add.reduceat(rows, starts) / np.sqrt(lengths[full])[:, None]
        return out


def fit(grams: list[np.ndarray], languages: list[str]) -> Model:
    """Kernel ridge regression on Nyström features; texts come in an order without meaning."""
    names = sorted(set(languages))
    if not names:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), dtype=np.float32))
    texts = [i for i, x in enumerate(grams) if len(x)]
    by_name = {n: [i for i in texts if languages[i] == n] for n in names}
    marks = [i for n in names for i in by_name[n][: max(8, LANDMARKS // len(names))]]
    used = np.unique(np.concatenate([grams[i] for i in marks])) if marks else np.zeros(0, np.int64)
    place = np.full(BUCKETS, len(used), dtype=np.int64)
    place[used] = np.arange(len(used))
    wide = np.zeros((len(used) + 1, len(marks)), dtype=np.float32)  # landmarks, scaled; the last row is of all others
    for k, i in enumerate(marks):
        wide[place[grams[i]], k] = len(grams[i]) ** -0.5
    kernel = np.array([wide[place[grams[i]]].sum(axis=0) * len(grams[i]) ** -0.5 for i in texts]).reshape(len(texts), -1)
    own = {i: k for k, i in enumerate(texts)}
    values, vectors = np.linalg.eigh(kernel[[own[i] for i in marks]].astype(np.float64))
    strong = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, strong] / np.sqrt(values[strong])
    features = kernel @ root
    target = np.array([[1.0 if languages[i] == n else -1.0 for n in names] for i in texts])
    weight = np.array([len(texts) / (len(names) * len(by_name[languages[i]])) for i in texts])[:, None]
    solved = np.linalg.solve(
        features.T @ (weight * features) + RIDGE * np.eye(features.shape[1]), features.T @ (weight * target)
    )
    matrix = np.zeros((BUCKETS, len(names)), dtype=np.float32)
    matrix[used] = wide[:-1] @ (root @ solved).astype(np.float32)
    return Model(names, matrix)


def train(labelled: DataFrame) -> Model:
    """A model from ``labelled (text, lang)``; rows without a language or letter teach nothing.

    The sample's size is bounded by ``PER_LANGUAGE`` times the languages, not by the rows.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("text", "lang", F.shiftrightunsigned(F.xxhash64("text", F.lit(3)), 1).alias("spot"))
    spots = stage(rows.select("lang", "spot").distinct(), "spots")
    counts = spots.groupBy("lang").count()
    if (n := counts.count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; a model holds {MAX_LANGUAGES} at most")
    # twice as many as are taken lie below the bound, so none of those is missed
    bounds = counts.select("lang", (F.lit(2.0 * PER_LANGUAGE * 2**63) / F.col("count")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    low = spots.join(F.broadcast(bounds), "lang").where("spot < bound").withColumn("_place", place)
    drawn = low.where(F.col("_place") <= PER_LANGUAGE).select("lang", "spot")
    sample = rows.join(F.broadcast(drawn), ["lang", "spot"]).select("text", "lang", "spot")
    found = sample.mapInArrow(_presences, "lang string, spot bigint, grams array<int>").dropDuplicates(["lang", "spot"]).toPandas()
    found = found.sort_values(["spot", "lang"])
    return fit([np.asarray(x, dtype=np.int64) for x in found["grams"]], found["lang"].tolist())


def _presences(batches) -> Iterator[pa.RecordBatch]:
    """Of the copies in a task one is told."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        rows = []
        for text, *key in zip(*(c.to_pylist() for c in batch.columns)):
            if (key := tuple(key)) not in seen:
                seen.add(key)
                rows.append((*key, presence(text).astype(np.int32)))
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["lang", "spot", "grams"]
        )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the share of a softmax).

    A text that is null or has no letter is ``und`` with score 0. Columns of those names
    are replaced; all others, and repeated rows, stay.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return docs.mapInArrow(partial(_predict, shared=shared, column=docs.columns.index("text")), schema)


def _predict(batches, shared, column: int) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    for whole in batches:
        for start in range(0, len(whole), 512):
            batch = whole.slice(start, 512)
            texts = batch.column(column).to_pylist()
            spoken = np.array([has_letter(x) for x in texts], dtype=bool)
            values = model.scores([presence(x) if ok else np.zeros(0, np.int64) for x, ok in zip(texts, spoken)])
            odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
            best = np.argmax(values, axis=1)
            score = np.where(spoken, odds[np.arange(len(best)), best] / odds.sum(axis=1), 0.0)
            named = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, spoken)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(named, pa.string()), pa.array(score)],
                [*batch.schema.names, "lang_pred", "score"],
            )
