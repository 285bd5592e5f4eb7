"""Language of a text by string-kernel classification.

A text is the set of its letter n-grams of one to three letters (words lower-cased,
between spaces), of those that occur in landmarks; the blended-spectrum presence
kernel of two texts is the number of n-grams in both over the root of the product of
their numbers. Landmark texts give a
Nyström map: kernel values against the landmarks, times the inverse root of the
landmarks' own kernel matrix. One ridge regression for each language on that map
gives the scores. Batches of texts are scored by matrix products: presence rows
times the landmarks' presence matrix, times the regression's coefficients.

Fitting takes at most ``sample`` labelled documents (smallest hash of the id) and
``landmarks`` of them, in turn by language. Landmarks are pieces of the texts of at
most ``PIECE`` words, as languages show in a short stretch and presence saturates in
a long one; texts to be scored are taken whole, as the mean over all their pieces.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without labelled rows every text is; with one language it is that one. The result
depends on the text alone; other columns are carried by :func:`predict`, which replaces
columns named ``lang_pred`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches
from .words import GOLDEN

PIECE, SAMPLE, LANDMARKS, RIDGE = 200, 1500, 128, 1e-2
#: Which code points are letters.
LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
#: A vocabulary's hash tables have two to the power of so many slots.
SLOTS = 18


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(n-gram, piece) of every n-gram of each piece of up to ``PIECE`` words, and the number of pieces.

    Every run of other characters than letters is one space; an n-gram is its code
    points, 21 bits each, and lies within a word and the spaces at its ends.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(LETTER[codes], codes, 32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    gap = codes == 32
    keep = ~gap | np.concatenate([[True], ~gap[:-1]])
    codes, gap = codes[keep], gap[keep]
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    piece = (np.cumsum(gap) - 1 - gap).clip(0) // PIECE
    pairs = (codes[:-1] << np.uint64(21)) | codes[1:]
    triples = (pairs[:-1] << np.uint64(21)) | codes[2:]
    single, inner = ~gap, ~gap[1:-1]
    found = [codes[single], pairs, triples[inner]]
    owner = [piece[single], piece[:-1], piece[:-2][inner]]
    return np.concatenate(found), np.concatenate(owner), int(piece[-1]) + 1


def _slot(h: np.ndarray, nth: int) -> np.ndarray:
    return (h * (GOLDEN + np.uint64(2 * nth))) >> np.uint64(64 - SLOTS)


@dataclass
class Model:
    vocabulary: np.ndarray  # n-grams of the landmarks
    presence: np.ndarray  # n-grams x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages
    languages: list[str]

    def __post_init__(self) -> None:
        """Places of n-grams in hash tables: those whose slot is taken go to the next table."""
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.vocabulary))
        while len(left):
            table = np.zeros(1 << SLOTS, np.int32)
            slots, first = np.unique(_slot(self.vocabulary[left], len(self.tables)), return_index=True)
            table[slots] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the n-grams of ``h`` that are in the vocabulary, their places in it)."""
        at, places, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], np.arange(len(h))
        for nth, table in enumerate(self.tables):
            place = table[_slot(h[left], nth)]
            known = self.vocabulary[place] == h[left]
            at.append(left[known])
            places.append(place[known])
            left = left[~known]
        return np.concatenate(at), np.concatenate(places)

    def kernel(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel values of each piece against the landmarks, text of each piece)."""
        rows, cells, owner, total = [], [], [], 0
        for i, text in enumerate(texts):
            h, at, n = grams(text)
            known, place = self.find(h)
            rows.append(at[known] + total)
            cells.append(place)
            owner.append(np.full(n, i))
            total += n
        out = np.zeros((total, self.presence.shape[1]), np.float32)
        if not total:
            return out, np.zeros(0, np.int64)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        rows, cells = rows[order], cells[order]
        for low in range(0, total, 128):
            high = min(low + 128, total)
            part = slice(*np.searchsorted(rows, [low, high]))
            x = np.zeros((high - low, len(self.vocabulary)), np.float32)
            x[rows[part] - low, cells[part]] = 1
            out[low:high] = x @ self.presence / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return out, np.concatenate(owner)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Mean regression value over a text's pieces, a row of nan for texts without a letter."""
        k, owner = self.kernel(texts)
        pieces = np.bincount(owner, minlength=len(texts))
        values = k @ self.weights
        sums = np.stack([np.bincount(owner, values[:, c], len(texts)) for c in range(values.shape[1])], 1) if len(owner) else np.zeros((len(texts), len(self.languages)))
        return np.where(pieces[:, None] > 0, sums / np.maximum(pieces, 1)[:, None], np.nan)


def train(texts: list[str | None], languages: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Landmarks are the first pieces of texts, taken in turn by language."""
    pieces = []
    for text, language in zip(texts, languages):
        h, at, n = grams(text)
        if n:
            pieces.append((h[at == 0], language))
    names = sorted({p[1] for p in pieces})
    if not names:
        return None
    turn: dict[str, int] = {}
    ranked = []
    for i, (_, language) in enumerate(pieces):
        turn[language] = turn.get(language, -1) + 1
        ranked.append((turn[language], i))
    chosen = [i for _, i in sorted(ranked)[:landmarks]]
    vocabulary = np.unique(np.concatenate([pieces[i][0] for i in chosen]))
    presence = np.stack([np.isin(vocabulary, pieces[i][0]) for i in chosen], 1).astype(np.float32)
    presence /= np.sqrt(np.maximum(presence.sum(0), 1))
    among = presence.T.astype(np.float64) @ presence
    values, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    model = Model(vocabulary, presence, np.eye(len(chosen), dtype=np.float32), names)
    k, owner = model.kernel(texts)
    mapped = k.astype(np.float64) @ root
    goal = np.where(np.array(languages)[owner][:, None] == np.array(names)[None, :], 1.0, -1.0)
    balance = 1 / np.bincount(np.searchsorted(names, np.array(languages)[owner]), minlength=len(names))[np.searchsorted(names, np.array(languages)[owner])]
    scaled = mapped * balance[:, None]
    inner = np.linalg.solve(mapped.T @ scaled + ridge * np.eye(mapped.shape[1]), scaled.T @ goal)
    model.weights = (root @ inner).astype(np.float32)
    return model


def fit(docs: DataFrame, use: Column, *, doc_id: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE, **options) -> Model | None:
    marked = docs.filter(use & F.col(language).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(language).alias("_lang"))
    rows = bounded_sample(marked, F.col("_id"), sample).toPandas().sort_values(["_id", "_lang", "_text"], na_position="first")
    return train(rows["_text"].tolist(), rows["_lang"].tolist(), **options)


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def predict(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: a softmax of the regression values)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts) if model else 0, 100):
                values = model.scores(texts.iloc[at : at + 100].tolist())
                for i in np.flatnonzero(~np.isnan(values[:, 0])):
                    p = np.exp(4 * (values[i] - values[i].max()))
                    best = int(values[i].argmax())
                    names[at + i], scores[at + i] = model.languages[best], p[best] / p.sum()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*map(_named, kept)).alias("row"), predicted(F.col(text)).alias("found"))
    return rows.select("row.*", "found.lang_pred", "found.score")
