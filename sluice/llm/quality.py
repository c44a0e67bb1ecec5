"""A quality classifier: random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Words and their shapes get sparse random index vectors.  A word's vector is its
index vector and the direction of the sum of its neighbours' index vectors over
the sample.  A document's vector is the mean over all its words.  The network
is small numpy; its temperature is set on a part of the sample that it has not
seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import whole_text
from sluice.llm.labelled import fold, labelled_sample

#: Length of word vectors, entries of an index vector that are not 0, hashed words that have vectors.
SIZE, ENTRIES, WORDS = 48, 4, 1 << 14
HIDDEN, STEPS, RATE = 24, 400, 0.02
#: Documents of each label that are learned from, at most.
SAMPLE = 1500
#: Words that a task remembers, and texts that it holds at once.
REMEMBERED, TEXTS = 100_000, 256
#: Neighbours on each side that make up a word's context.
WINDOW = 2
#: Words beyond the vocabulary that mark repetition.
AGAIN, SAME = "\x00again", "\x00same"


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token) % WORDS


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one letter each; other characters as they are, runs of one as one."""
    out = []
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def index_vectors() -> np.ndarray:
    """A row for each hashed word: a few entries of 1 or -1 at random places."""
    rng = np.random.default_rng(7)
    out = np.zeros((WORDS, SIZE), np.float32)
    for _ in range(ENTRIES):
        np.add.at(out, (np.arange(WORDS), rng.integers(0, SIZE, WORDS)), rng.choice([-1.0, 1.0], WORDS))
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None


def keys_of(word: str) -> tuple[int, int]:
    return bucket(word.lower()), bucket("\x01" + shape(word))


def contexts(texts: list[str]) -> np.ndarray:
    """Word vectors from a sample: index vectors plus the direction of the neighbours' sum."""
    index = index_vectors()
    total = np.zeros_like(index)
    known: dict[str, tuple[int, int]] = {}
    for text in texts:
        ids = np.array([known.setdefault(w, keys_of(w)) if w not in known else known[w] for w in text.split()], np.int64).reshape(-1, 2)
        for column in range(2):
            own = index[ids[:, column]]
            near = np.zeros_like(own)
            for k in range(1, WINDOW + 1):
                near[k:] += own[:-k]
                near[:-k] += own[k:]
            np.add.at(total, ids[:, column], near)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return index + np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)


def pooled(text: str, vectors: np.ndarray, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """The document's vector: means over its words of their own and their shapes' vectors, and how much it repeats itself."""
    words = text.split()
    if not words:
        return np.zeros(2 * SIZE, np.float32)
    counts = Counter(words)
    ids = []
    for w in counts:
        found = known.get(w)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[w] = keys_of(w)
        ids.append(found)
    pairs = np.array(ids)
    weights = np.fromiter(counts.values(), np.float32, len(counts))
    following = words[1:]
    again = len(following) - len(set(zip(words, following, strict=False)))
    same = sum(map(eq, words, following))
    own = weights @ vectors[pairs[:, 0]]
    marks = weights @ vectors[pairs[:, 1]] + again * vectors[bucket(AGAIN)] + same * vectors[bucket(SAME)]
    return np.concatenate([own, marks]) / len(words)


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the weighted logistic loss, with a little decay."""
    rng = np.random.default_rng(11)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, STEPS + 1):
        hidden, z = forward(x, layers)
        g = (1 / (1 + np.exp(-z)) - y) * weight
        back = np.outer(g, layers[2]) * (1 - hidden**2)
        slopes = [x.T @ back + 1e-3 * layers[0], back.sum(0), hidden.T @ g + 1e-3 * layers[2], np.array([g.sum()])]
        for k, s in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * s
            second[k] = 0.999 * second[k] + 0.001 * s * s
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit(sample: pd.DataFrame, counts: dict[int, int]) -> Model:
    """A model of a sample (text, y).  Without both labels it gives the share of label 1 (0.5 without any) to all."""
    blank = Model(np.zeros((WORDS, SIZE), np.float32), np.zeros(2 * SIZE), np.ones(2 * SIZE))
    if set(sample["y"]) != {0, 1}:
        known = sum(counts.values())
        blank.constant = counts.get(1, 0) / known if known else 0.5
        return blank
    vectors = contexts(sample["text"].tolist())
    x = np.stack([pooled(t, vectors, {}) for t in sample["text"]]).astype(float)
    y = sample["y"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    took = sample["y"].value_counts()
    weight = np.where(y == 1, counts[1] / took[1], counts[0] / took[0])
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside])) < 2 or not aside.any():
        aside[:] = False
    layers = train(x[~aside], y[~aside], weight[~aside] / weight[~aside].sum())
    heat = 1.0
    if aside.any():
        z = forward(x[aside], layers)[1]
        loss = lambda t: float((weight[aside] * (np.logaddexp(0, z / t) - y[aside] * z / t)).sum())
        heat = min(np.geomspace(0.5, 8, 33), key=loss)
    return Model(vectors, mean, scale, layers, float(heat))


def scores(texts: list[str], model: Model, known: dict[str, tuple[int, int]]) -> np.ndarray:
    if model.constant is not None or not texts:
        return np.full(len(texts), model.constant or 0.0)
    x = (np.stack([pooled(t, model.vectors, known) for t in texts]) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(forward(x, model.layers)[1] / model.temperature, -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """A model learned from at most `sample` documents of each label, none of them in the held-out fold."""
    return fit(*labelled_sample(docs, labels, label, fold("doc_id", folds) != held, {0: sample, 1: sample}))


def with_score(docs: DataFrame, model: Model, name: str = "score", column: str = "text") -> DataFrame:
    """docs and the probability of label 1.  Null texts count as empty and are scored too.  The model's size is fixed, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, int]] = {}
        for texts in batches:
            parts = [scores(texts.slice(at, TEXTS).to_pylist(), shared.value, known) for at in range(0, len(texts), TEXTS)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.withColumn(name, score(whole_text(column)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted.  Rows with a null id are never learned from and count as held out."""
    scored = with_score(docs.select("doc_id", "text"), fitted(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
