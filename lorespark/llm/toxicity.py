"""Toxicity of documents, and the sentences that carry it, by multiple-instance learning.

A document is a bag of sentences. A sentence is a sparse vector of its words and their
beginnings; its probability is a logistic function of their weights.
A document is toxic if any sentence is: 1 - prod(1 - p), the noisy-or, so document
labels alone train sentence scores. In scoring, sentences of a probability under
``LEAST`` have no say, but for one that stands for the text as a whole: thousands of
harmless sentences do not add up to a toxic document. Training is full-batch Adam with weight decay, on the driver, over at most ``sample`` labelled documents (those with the
smallest hash of the id).

Defined results: blank sentences do not count; null, empty and blank texts get the
model's score for a sentence without words; without labelled rows of both classes the score is the
share of toxic rows, 0 without any. Scores depend on the text alone; other columns
are carried by :func:`score` and ignored by :func:`fit`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .quality import labelled_sample
from .words import shingles

SAMPLE, STEPS, RATE, DECAY, EVIDENCE, LEAST = 6000, 150, 0.1, 1e-4, 22.0, 0.02
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(3, 9)


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings of 3 to 8 letters."""
    return ["=" + word, *[word[:k] for k in BEGINNINGS if k <= len(word)]]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text that hold more than white space."""
    return [m.span() for m in SENTENCE.finditer(text or "") if not m.group().isspace()]


def _parts(text: str | None) -> list[str]:
    """The texts of :func:`sentences`; one empty sentence if there is none."""
    return [p for p in SENTENCE.findall(text or "") if not p.isspace()] or [""]


class Model:
    """Weights of features, and through them of words; words are remembered up to ``most``."""

    most = 300_000

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.of_word: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.of_word.get(word)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.of_word) < self.most:
                self.of_word[word] = got
        return got

    def sentence_logit(self, sentence: str) -> float:
        return self.bias + sum(map(self.word, WORD.findall(sentence.lower())))

    def score(self, text: str | None) -> float:
        z = np.array([self.bias, *map(self.sentence_logit, _parts(text))])
        doubt = np.logaddexp(0, z)  # -log(1 - p)
        return float(-np.expm1(-doubt[0] - doubt[1:][doubt[1:] >= -np.log1p(-LEAST)].sum()))

    def locate(self, text: str | None, least: float = 0.3) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences of ``text`` whose own probability is at least ``least``."""
        found = [(a, b, float(1 / (1 + np.exp(-np.clip(self.sentence_logit(text[a:b]), -40, 40))))) for a, b in sentences(text)]
        return [f for f in found if f[2] >= least]


def _evidence(k: int, n: int, share: float) -> float:
    """Twice the log-likelihood ratio of ``k`` toxic among ``n`` documents against ``share``; 0 for no more than that."""
    if k <= n * share:
        return 0.0
    return 2 * (k * np.log(k / (n * share)) + ((n - k) * np.log((n - k) / (n * (1 - share))) if k < n else 0.0))


def train(texts: list[str | None], labels: np.ndarray, *, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, evidence: float = EVIDENCE) -> Model:
    """Only features take part whose log-likelihood ratio against the labels is at least ``evidence``.

    Of texts of one label that share one of their four smallest shingle hashes the first
    counts, so that copies do not make evidence of a passage's every word.
    """
    seen: tuple[set[int], set[int]] = (set(), set())
    alone = []
    for i, text in enumerate(texts):
        sketch, met_before = shingles(text, 5)[:4].tolist(), seen[int(labels[i] > 0)]
        if not met_before.intersection(sketch):
            alone.append(i)
        met_before.update(sketch)
    texts, labels = [texts[i] for i in alone], labels[alone]
    n = len(labels)
    share = float(labels.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Model({}, 40.0 if share else -40.0)

    def bag(text: str | None) -> list[list[str]]:
        return [WORD.findall(p) for p in _parts((text or "").lower())]

    def met(text: str | None) -> set[str]:
        return {f for w in {w for p in bag(text) for w in p} for f in features(w)}

    toxic_often = Counter(f for t, y in zip(texts, labels) if y for f in met(t))
    toxic_often = Counter({f: k for f, k in toxic_often.items() if _evidence(k, k, share) >= evidence})
    often = Counter(f for t in texts for f in met(t) if f in toxic_often)
    names = sorted(f for f, k in toxic_often.items() if _evidence(k, often[f], share) >= evidence)
    index = {f: i for i, f in enumerate(names)}
    slots: dict[str, list[int]] = {}
    flat, counts, owner = [], [], []
    for i, text in enumerate(texts):
        for part in bag(text):
            before = len(flat)
            for w in part:
                if w not in slots:
                    slots[w] = [index[f] for f in features(w) if f in index]
                flat.extend(slots[w])
            counts.append(len(flat) - before)
            owner.append(i)
    flat, owner = np.array(flat, np.int32), np.array(owner)
    m, size = len(owner), len(names)
    sentence = np.repeat(np.arange(m), counts)
    y = labels.astype(float)
    w, bias = np.zeros(size), float(np.log(share * n / m))
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[flat], m) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), n))
        # d loss / d logit of a sentence: p for clean documents, -p * clean / (1 - clean) for toxic ones.
        g = p * np.where(y > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0)[owner] / n
        gw, gb = np.bincount(flat, g[sentence], size), g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        scale = np.sqrt(m2 / (1 - 0.99**step)) + 1e-6
        w -= rate * (m1 / (1 - 0.9**step) / scale + decay * w)
        bias -= 0.2 * rate * b1 / (1 - 0.9**step) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-6)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, use: Column, *, label: str = "toxic", sample: int = SAMPLE, **options) -> Model:
    rows = labelled_sample(docs, labels, use, label, sample)
    return train(rows["text"].tolist(), rows["label"].to_numpy(), **options)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability that the text is toxic."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(F.col(text)))


def offending(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """(doc_id, start, end, probability): the sentences that make documents toxic, in code points."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *span) for key, t in zip(batch["doc_id"], batch["text"]) for span in shared.value.locate(t, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "probability"])

    # Ids pass as strings, as pandas has no whole numbers beside nulls.
    source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = source.mapInPandas(located, "doc_id string, start long, end long, probability double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
