"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of up to ``PASSAGE`` words. Every passage is encoded
from counts of its characters and words; gated attention weighs the passages, and the
score is a logistic function of the weighted mean. Encoder, gates and output are
trained together from document labels, by Adam on the driver, over at most
``sample`` labelled documents (those with the smallest hash of the id).

Defined results: null, empty and blank texts are one empty passage and get the
model's score for it; without labelled rows every score is 0.5, and with one class
only the share of that class. Scores depend on the text alone; other columns are
carried along by :func:`score` and ignored by :func:`fit`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches
from .words import GOLDEN, KNOWN, mix

PASSAGE, SAMPLE, HIDDEN, STEPS, RATE = 48, 3000, 24, 150, 0.03
SYMBOLS = "|!%&$#*.,;:?\"'()-_=/\\<>@+[]{}"


def _kinds() -> np.ndarray:
    """The kind of each character below 0x250: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 and up symbols."""
    out = np.zeros(0x250, np.int64)
    for c in map(chr, range(0x250)):
        out[ord(c)] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 0
    for i, c in enumerate(SYMBOLS):
        out[ord(c)] = 5 + i
    return out


KINDS = _kinds()
N_KINDS = 5 + len(SYMBOLS)
N_FEATURES = N_KINDS + 9


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document of each row): the passages of all texts, at least one each."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        found = (text or "").split()
        n = len(found)
        if not n:
            rows.append(np.zeros((1, N_FEATURES)))
            owner.append(np.full(1, i))
            continue
        at = np.arange(n) // PASSAGE
        count = np.bincount(at).astype(float)
        lengths = np.fromiter(map(len, found), np.int64, n)
        codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 0x250, KINDS[np.minimum(codes, 0x24F)], 0)
        kinds = np.bincount(np.repeat(at, lengths) * N_KINDS + kind, minlength=len(count) * N_KINDS).reshape(-1, N_KINDS)
        chars = np.maximum(kinds.sum(1), 1)
        h = np.fromiter(map(KNOWN.__getitem__, found), np.uint64, n)
        share = lambda mask: np.bincount(at, mask, len(count)) / count
        first = np.zeros(n, bool)
        first[np.unique(mix(h ^ (at.astype(np.uint64) * GOLDEN)), return_index=True)[1]] = True
        new = np.zeros(n, bool)
        new[np.unique(h, return_index=True)[1]] = True
        run = mix(h + np.roll(h, 1) * GOLDEN)
        fresh = np.zeros(n, bool)
        fresh[np.unique(run, return_index=True)[1]] = True
        starts = np.cumsum(lengths) - lengths
        upper_first = kind[starts] == 2
        has_lower = np.add.reduceat(kind == 1, starts) > 0
        symbol_end = kind[starts + lengths - 1] >= 5
        alone = (lengths == 1) & symbol_end
        features = [share(first), share(new), share(fresh), share(h == np.roll(h, 1)), share(upper_first), share(has_lower), share(symbol_end), share(alone), np.bincount(at, lengths) / count / 10]
        rows.append(np.concatenate([kinds / chars[:, None], np.stack(features, 1)], 1))
        owner.append(np.full(len(count), i))
    return np.concatenate(rows), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        t, g = np.tanh(h @ p["attend"]), _sigmoid(h @ p["gate"])
        e = (t * g) @ p["attention"]
        starts = np.searchsorted(bag, np.arange(n))  # passages come in order of their documents
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.bincount(bag, e, n)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ p["out"] + p["out_bias"])}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, bag = passages(texts)
        return self.forward(np.clip((x - self.mean) / self.scale, -8, 8), bag, len(texts))["p"]


def train(texts: list[str | None], labels: np.ndarray, *, hidden: int = HIDDEN, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    n = len(labels)
    raw, bag = passages(texts) if n else (np.zeros((1, N_FEATURES)), np.zeros(1, int))
    mean, scale = raw.mean(0), np.maximum(raw.std(0), 0.02)
    x, y = np.clip((raw - mean) / scale, -8, 8), labels.astype(float)
    rng = np.random.default_rng(seed)
    shapes = {"encode": (N_FEATURES, hidden), "encode_bias": (hidden,), "attend": (hidden, hidden), "gate": (hidden, hidden), "attention": (hidden,), "out": (hidden,), "out_bias": ()}
    w = {k: np.zeros(s) if k.endswith("bias") else rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    share = float(y.mean()) if n else 0.5
    if share in (0.0, 1.0) or not n:
        w["out"] = np.zeros(hidden)
        w["out_bias"] = np.array(0.0 if not n else 40.0 if share else -40.0)
        return Model(mean, scale, w)
    w["out_bias"] = np.array(np.log(share / (1 - share)))
    model = Model(mean, scale, w)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, bag, n)
        d = (f["p"] - y) / n
        dz = d[:, None] * w["out"]
        dh = f["a"][:, None] * dz[bag]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, n)[bag])
        inner = de[:, None] * w["attention"]
        dt, dg = inner * f["g"] * (1 - f["t"] ** 2), inner * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ w["attend"].T + dg @ w["gate"].T
        dx = dh * (1 - f["h"] ** 2)
        grads = {"encode": x.T @ dx, "encode_bias": dx.sum(0), "attend": f["h"].T @ dt, "gate": f["h"].T @ dg, "attention": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d, "out_bias": d.sum()}
        for k, g in grads.items():
            g = g + 1e-4 * w[k] * (not k.endswith("bias"))
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            w[k] = w[k] - rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Column, label: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """At most ``limit`` labelled documents (text, label), the same on every run; ``use`` marks label rows to learn from."""
    marked = labels.filter(use & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = bounded_sample(marked, F.col("_id"), limit)
    found = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return bounded_sample(found.select("_id", "label", "text"), F.col("_id"), limit).toPandas().sort_values(["_id", "label", "text"], na_position="first")


def fit(docs: DataFrame, labels: DataFrame, use: Column, *, label: str = "quality", sample: int = SAMPLE, **options) -> Model:
    rows = labelled_sample(docs, labels, use, label, sample)
    return train(rows["text"].tolist(), rows["label"].to_numpy(), **options)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [shared.value.score(texts.iloc[at : at + 100].tolist()) for at in range(0, len(texts), 100)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, scored(F.col(text)))
