"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nystroem landmarks.

The kernel of two words counts their common subsequences of three letters,
each weighted by decay to the power of the stretch that it spans in both, so
that insults with gaps or inserted characters stay alike.  Words are mapped by
their kernels with landmark words.  The machine learns from sentences: all of a
clean document are clean, those of a toxic one are toxic if they hold a word
that tells; a sentence is represented by its worst word, which is chosen anew as
the machine learns.  The kernel expansion over the landmarks is then one weight for each
subsequence, so every word is scored by the kernel itself, without a filter.  A
document's score is that of its worst words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import nlargest
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import whole_text
from sluice.llm.labelled import fold, labelled_sample

DECAY = 0.6
#: Letters are of this many kinds: a to z and digits by themselves, others share some; two mark a word's ends.
LETTERS = 64
START, END = 62, 63
#: Subsequences that span more letters do not count.
SPAN = 12
#: Landmarks that are telling words, and that are words of clean documents.
TELLING, ORDINARY = 192, 320
#: Words of clean documents that are learned from at first, and the worst ones that each round adds.
NEGATIVES, HARD = 6000, 1500
#: Rounds in which worst words are chosen.
ROUNDS = 3
#: Log-likelihood ratio from which a word tells that a toxic document's sentence is toxic.
EVIDENCE = 14.0
#: Eigenvalues of the landmarks' kernel below this are left out.
FLOOR = 0.01
#: The margin that stands for a missing word.
NOTHING = -1.0
#: Learnable documents of label 0 and of label 1 that are learned from, at most.
SAMPLE = {0: 2000, 1: 1000}
#: Words whose margins a task remembers.
REMEMBERED = 300_000
#: Longer words are scored in overlapping stretches of this length.
STRETCH = 24
#: Words whose kernels are computed at once, and texts that are held at once.
BATCH, TEXTS = 512, 256
TRIMMED = ".,;:!?\"'()[]{}<>*#%&$|-_/\\~`+=^@…»«“”„¿¡"
#: Four or more single characters in a row.
SPELLED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def squeezed(word: str) -> str:
    return "".join(filter(str.isalnum, word))


def words_of(text: str) -> set[str]:
    """The different words of a text, lower-cased, without punctuation around them; runs of single characters as words too."""
    low = text.lower()
    found = {w.strip(TRIMMED) for w in low.split()}
    found |= {squeezed(w) for w in found if not w.isalnum()}
    for run in SPELLED.findall(low):
        found.add("".join(run.split()))
    return {w for w in found if len(w) > 2}


def stretches(word: str) -> list[str]:
    return [word] if len(word) <= STRETCH else [word[k : k + STRETCH] for k in range(0, len(word) - STRETCH // 2, STRETCH // 2)]


def letter_table() -> np.ndarray:
    """The kind of each of the first 2 ** 16 code points."""
    code = np.arange(1 << 16)
    kinds = 37 + (code * 40503 >> 4) % 25
    kinds[ord("a") : ord("z") + 1] = np.arange(1, 27)
    kinds[ord("0") : ord("9") + 1] = np.arange(27, 37)
    return kinds.astype(np.int32)


KINDS = letter_table()


@lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places i < j < k of three letters in a word of n, with the weight of each, in all of length 1."""
    each = np.array([x for x in combinations(range(n), 3) if x[2] - x[0] < SPAN], np.int32).reshape(-1, 3)
    weight = DECAY ** (each[:, 2] - each[:, 0] + 1.0)
    return each[:, 0], each[:, 1], each[:, 2], (weight / max(np.linalg.norm(weight), 1e-12)).astype(np.float32)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of words of one length, as numbers, a row for each word; and the weights of their places."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
    kinds = np.full((len(words), n + 2), START, np.int32)
    kinds[:, 1:-1] = KINDS[codes & 0xFFFF]
    kinds[:, -1] = END
    i, j, k, weight = places(n + 2)
    return (kinds[:, i] * LETTERS + kinds[:, j]) * LETTERS + kinds[:, k], weight


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Positions of words in batches of one length."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    lo = 0
    while lo < len(order):
        hi, size = lo, len(words[order[lo]])
        while hi < len(order) and hi - lo < BATCH and len(words[order[hi]]) == size:
            hi += 1
        yield order[lo:hi]
        lo = hi


class Expansion:
    """The weights of subsequences of some words, to compute kernels with them."""

    def __init__(self, words: list[str]):
        self.words = words
        found = [(k, *(x[0] for x in (ids,)), weight) for k, w in enumerate(words) for ids, weight in [subsequences([w])]]
        used = np.unique(np.concatenate([ids for _, ids, _ in found])) if found else np.zeros(0, np.int64)
        self.used = used
        self.at = np.full(LETTERS**3, len(used), np.int32)
        self.at[used] = np.arange(len(used))
        self.table = np.zeros((len(used) + 1, len(words)), np.float32)
        for k, ids, weight in found:
            np.add.at(self.table[:, k], self.at[ids], weight)

    def kernel(self, words: list[str]) -> np.ndarray:
        """The kernel of each of words with each of the expansion's."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for batch in by_length(words):
            for lo in range(0, len(batch), 32):
                part = batch[lo : lo + 32]
                ids, weight = subsequences([words[k] for k in part])
                out[part] = np.einsum("bts,t->bs", self.table[self.at[ids]], weight, optimize=True)
        return out

    def combined(self, factors: np.ndarray) -> np.ndarray:
        """One weight for each subsequence: the kernel's sum over the expansion's words with these factors."""
        out = np.zeros(LETTERS**3, np.float32)
        out[self.used] = self.table[:-1] @ factors.astype(np.float32)
        return out


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0
    slopes: np.ndarray | None = None
    constant: float | None = None


def margins(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The margin of each word: that of its worst stretch."""
    parts = [(k, x) for k, w in enumerate(words) for x in stretches(w)]
    texts, own = [x for _, x in parts], np.empty(len(parts), np.float32)
    for batch in by_length(texts):
        ids, weight = subsequences([texts[k] for k in batch])
        own[batch] = weights[ids] @ weight
    out = np.full(len(words), -np.inf)
    np.maximum.at(out, [k for k, _ in parts], own + bias)
    return out


def ratios(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """How much likelier each word of the toxic documents is there than in clean ones, as a log-likelihood ratio."""
    a, b = Counter(w for d in toxic for w in d), Counter(w for d in clean for w in d)
    na, nb = len(toxic), len(clean)

    def ratio(x: int, y: int) -> float:
        if x / na <= y / nb:
            return 0.0
        p = (x + y) / (na + nb)
        part = lambda k, n: (k * math.log(k / n / p) if k else 0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0)
        return 2 * (part(x, na) + part(y, nb))

    return {w: ratio(x, b[w]) for w, x in a.items()}


def disguised(word: str, rng: np.random.Generator) -> list[str]:
    """A word with a letter after each of its own, after some of them, and with letters doubled."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    extra = [letters[k] for k in rng.integers(0, 26, len(word))]
    some, same = rng.random(len(word)) < 0.5, letters[rng.integers(0, 26)]
    return [same.join(word), "".join(c + (x if y else "") for c, x, y in zip(word, extra, some, strict=True)), "".join(c * 2 for c in word)]


def hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    decay = 1e-3
    rate = 1 / (decay + 2 * float(np.linalg.eigvalsh((x1 * cost[:, None]).T @ x1)[-1]))
    w = last = np.zeros(x1.shape[1])
    for t in range(1, steps + 1):
        ahead = w + (t - 1) / (t + 2) * (w - last)
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        last, w = w, ahead - rate * (decay * ahead - 2 * x1.T @ (cost * y * slack))
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and shift of the probability of label 1, by Newton's method with a little decay."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) * weight)[:, None]).T @ x1 + 0.05 * np.eye(len(w)), x1.T @ ((p - y) * weight) + 0.05 * w)
        w = w - np.clip(step, -2, 2)
    return w


def cut(words: list[str]) -> list[str]:
    return list(dict.fromkeys(s for w in words for s in stretches(w)))


def fit(sample: pd.DataFrame, counts: dict[int, int]) -> Model:
    """A model of a sample (text, y).  Without both labels, or without any word that tells, all get the share of label 1."""
    known = sum(counts.values())
    share = counts.get(1, 0) / known if known else 0.0
    if set(sample["y"]) != {0, 1}:
        return Model(constant=share)
    y = sample["y"].to_numpy()
    documents = [[s for s in map(words_of, SENTENCE.split(t)) if s] for t in sample["text"]]
    flat = [set().union(*d) for d in documents]
    toxic, clean = [documents[k] for k in np.flatnonzero(y == 1)], [documents[k] for k in np.flatnonzero(y == 0)]
    score = ratios([flat[k] for k in np.flatnonzero(y == 1)], [flat[k] for k in np.flatnonzero(y == 0)])
    telling = [w for w in sorted(score, key=lambda w: (-score[w], w)) if score[w] >= EVIDENCE]
    often = Counter(w for k in np.flatnonzero(y == 0) for w in flat[k])
    pool = sorted(often)
    if not telling or not pool:
        return Model(constant=share)
    rng = np.random.default_rng(3)
    common = [w for w, _ in often.most_common(ORDINARY // 2)]
    usual = cut([pool[k] for k in rng.permutation(len(pool))[:NEGATIVES]])
    landmarks = Expansion(list(dict.fromkeys([*cut(telling[:TELLING]), *cut(common), *usual[: ORDINARY // 2]])))
    gram = landmarks.kernel(landmarks.words).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = (vectors * np.where(values > FLOOR, np.maximum(values, FLOOR) ** -0.5, 0.0)) @ vectors.T
    mapped: dict[str, np.ndarray] = {}

    def map_(words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in mapped]
        mapped.update(zip(new, (landmarks.kernel(new) @ root).astype(np.float32), strict=True))
        return np.stack([mapped[w] for w in words])

    # Sentences: all of a clean document are clean, those of a toxic one are toxic if a word tells; each stands by its worst word.
    marks, negative = set(telling), list(dict.fromkeys([*cut(common), *usual]))
    sentences = [s & marks for d in toxic for s in d if s & marks]
    model, rank = Model(), score
    for turn in range(ROUNDS):
        worst = Counter(max(s, key=lambda w: (rank[w], w)) for s in sentences)
        times = Counter()
        for w, n in worst.items():
            for x in [stretches(w)[0], *[stretches(v)[0] for v in disguised(w, rng)]]:
                times[x] += n
        ordinary = [*negative, *[stretches(v)[0] for w in negative[:NEGATIVES:8] for v in disguised(w, rng)]]
        x = np.vstack([map_(ordinary), map_(list(times))]).astype(float)
        t = np.concatenate([-np.ones(len(ordinary)), np.ones(len(times))])
        own = np.sqrt(np.array(list(times.values()), float))
        cost = np.concatenate([np.full(len(ordinary), 0.5 / len(ordinary)), 0.5 * own / own.sum()])
        w, model.bias = hinge(x, t, cost, 400 if turn == ROUNDS - 1 else 120)
        model.weights = landmarks.combined(root @ w)
        if turn < ROUNDS - 1:
            every = sorted(set(pool) | marks)
            rank = dict(zip(every, margins(every, model.weights, model.bias).tolist(), strict=True))
            negative = list(dict.fromkeys([*negative, *cut(sorted(set(pool) - marks, key=lambda w: (-rank[w], w))[:HARD])]))
    found = evidence(flat, model, {})
    took = sample["y"].value_counts()
    weight = np.where(y == 1, counts[1] / took[1], counts[0] / took[0])
    model.slopes = logistic(found, y.astype(float), weight / weight.mean())
    return model


def evidence(documents: list[set[str]], model: Model, known: dict[str, float]) -> np.ndarray:
    """For each document the margins of its worst and second worst word and the logarithm of its number of words.  New words are scored together."""
    if len(known) > REMEMBERED:
        known.clear()
    new = sorted({w for d in documents for w in d if w not in known})
    known.update(zip(new, margins(new, model.weights, model.bias).tolist(), strict=True))
    out = np.full((len(documents), 3), NOTHING)
    for k, d in enumerate(documents):
        top = nlargest(2, map(known.__getitem__, d))
        out[k, : len(top)] = top
        out[k, 2] = math.log1p(len(d))
    return out


def scores(texts: list[str], model: Model, known: dict[str, float]) -> np.ndarray:
    """The probability of label 1 of each text."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = evidence([words_of(t) for t in texts], model, known)
    return 1 / (1 + np.exp(-np.clip(x @ model.slopes[:3] + model.slopes[3], -30, 30)))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, sample: dict[int, int] | None = None) -> Model:
    """A model learned from a bounded sample of labelled documents, none of them in the held-out fold."""
    return fit(*labelled_sample(docs, labels, label, fold("doc_id", folds) != held, sample or SAMPLE))


def with_score(docs: DataFrame, model: Model, name: str = "score", column: str = "text") -> DataFrame:
    """docs and the probability of label 1.  Null texts count as empty and are scored too.  The model is a megabyte of weights, whatever the input, and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for texts in batches:
            parts = [scores(texts.slice(at, TEXTS).to_pylist(), shared.value, known) for at in range(0, len(texts), TEXTS)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.withColumn(name, score(whole_text(column)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted.  Rows with a null id are never learned from and count as held out."""
    scored = with_score(docs.select("doc_id", "text"), fitted(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
