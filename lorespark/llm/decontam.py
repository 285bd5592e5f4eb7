"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment.

Test items and documents are sequences of word hashes. The word ``n``-grams of the
items are seeds, all of them: common ones too, as those may be all that an edited
copy still has. Documents look them up with their own n-grams and with those that
skip the word before the last.

How many seeds a copy over the threshold still has follows from its score. Let an alignment take p of an item's L
words and score s >= t L. Its p - 2 three-word runs are seeds; a word put in costs 1 of p - s and takes at most one seed
(that with the gap before its last word is found by skipping), several put in at one place take two and cost two or more, a
word changed or left out costs 2 and takes three. So at least p - 2 - 1.5 (p - t L) >= (1.5 t - 0.5) L - 2 seeds are left.
Items of up to ``SHORT`` words have two-word seeds: a word put in costs 1 and takes one, a word changed or left out costs
2 and takes two, so p - 1 - (p - s) = s - 1 of them are left. Pairs of a passage and an item with fewer seeds in common,
counted as often as the item has them, are no copies.

Items go by length into classes, each up to a quarter longer than the last, so that one item sets no bound for much longer ones.
One pass over the corpus cuts documents, for each class, into overlapping passages, long enough that any alignment over the threshold
lies whole in one of them, and notes the seeds of those that have enough of them. Of an item with n seeds, of which a copy has m at
least, any n - m + 1 must meet a copy; the n - m + 1 that are rarest in the corpus are looked up, so that what
is frequent in the corpus joins nothing as long as an item has enough else, and rows of one seed are dealt by a salt. The pairs found are checked for
all seeds that they share; only then are the words of the documents with candidates read again. A pair with too few words in common to reach the
threshold is dropped, and local alignment over words (match 1, mismatch and gap -1) scores the others; a score
of at least ``threshold`` times the item's length is contamination. Items are
aligned whole, whatever their length; classes set only how long passages are.

Executors get a Bloom filter of each class's seeds, and one of all seeds of a width, which most words fail at once, of ``BITS_A_SEED`` bits for each up to
``MOST_BITS`` (128 MB, 67 million seeds) a filter; what passes by chance falls out at the join.

Defined results: null, empty and wordless texts and items match nothing; items of
one or two words are one seed and found whole only; repeated items and documents
repeat their pairs once for each distinct id; null ids match nothing; empty tables
give an empty result. Other columns are ignored by :func:`contamination` and carried
by :func:`decontaminate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, small_batches, store
from .words import GOLDEN, mix, windows, word_hashes

SEED_WORDS, THRESHOLD = 3, 0.5
BITS_A_SEED, LEAST_BITS, MOST_BITS, FILTER_HASHES = 16, 1 << 16, 1 << 30, 3
#: Items of up to so many words (and those of the same class) have seeds of two words.
SHORT = 12
#: In how many parts rows of a seed are dealt.
SALTS = 8
#: Cells in one row of the matrices that are aligned together.
CELLS = 1 << 18


class Bloom:
    """A Bloom filter over well mixed 64-bit hashes, of a size (a power of two) for about ``n`` of them."""

    def __init__(self, n: int) -> None:
        self.size = 1 << (min(max(n * BITS_A_SEED, LEAST_BITS), MOST_BITS) - 1).bit_length()
        self.bits = np.zeros(self.size // 8, np.uint8)

    def places(self, h: np.ndarray, k: int) -> np.ndarray:
        return (mix(h ^ np.uint64(k * int(GOLDEN) % 2**64)) if k else h) & np.uint64(self.size - 1)

    def add(self, h: np.ndarray) -> None:
        for k in range(FILTER_HASHES):
            at = self.places(h, k)
            np.bitwise_or.at(self.bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the filter."""
        left = np.arange(len(h))
        for k in range(FILTER_HASHES):
            at = self.places(h[left], k)
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return left


def _blooms(seeds: DataFrame, counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], Bloom]:
    """A filter of each (class, width) and, under (-1, width), of each width; parts are made on executors and joined on the driver."""
    sizes = dict(counts)
    for (_, k), n in counts.items():
        sizes[-1, k] = sizes.get((-1, k), 0) + n

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple[int, int], Bloom] = {}
        for batch in batches:
            for (c, k), rows in batch.groupby(["class", "k"]):
                for name in ((c, k), (-1, k)):
                    own.setdefault(name, Bloom(sizes[name])).add(rows["seed"].to_numpy(np.int64).view(np.uint64))
        for (c, k), found in own.items():
            yield pd.DataFrame({"class": [c], "k": [k], "bits": [found.bits.tobytes()]})

    out = {name: Bloom(n) for name, n in sizes.items()}
    for row in seeds.select("class", "k", "seed").coalesce(8).mapInPandas(part, "class long, k long, bits binary").toLocalIterator():
        out[row["class"], row["k"]].bits |= np.frombuffer(row["bits"], np.uint8)
    return out


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment scores of pairs of sequences, rows of ``a`` and ``b``.

    Zero pads and never matches. One row of all the pairs' matrices at a time; gaps
    along the row follow from a running maximum.
    """
    n = b.shape[1]
    ramp = np.arange(n, dtype=np.int32)
    above, best = np.zeros((len(a), n + 1), np.int32), np.zeros(len(a), np.int32)
    for i in range(a.shape[1]):
        word = a[:, i : i + 1]
        match = np.where((word == b) & (word != 0), 1, -1)
        row = np.maximum(above[:, :-1] + match, above[:, 1:] - 1)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        above[:, 1:] = row
        best = np.maximum(best, row.max(axis=1))
    return best


def shared_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of each row of ``a`` are in the same row of ``b``: no alignment scores more."""
    row = np.arange(len(a), dtype=np.uint64)[:, None] << np.uint64(32)
    return (np.isin(row | a, row | b) & (a != 0)).sum(axis=1)


def _words32(text: str | None) -> np.ndarray:
    return (word_hashes(text) | np.uint64(1)) & np.uint64(0xFFFFFFFF)


def _class(length: int) -> tuple[int, int]:
    """(number, least length) of the class of items of so many words; each class reaches up to a quarter beyond its least length."""
    number, low = 0, 1
    while (above := max(low + 1, low * 5 // 4 + 1)) <= length:
        number, low = number + 1, above
    return number, low


def _seeds(h: np.ndarray, n: int) -> np.ndarray:
    return windows(h, n).view(np.int64)


def _skipping(h: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of ``h`` that skip the word before their last."""
    if n < 2 or len(h) <= n:
        return np.zeros(0, np.int64)
    count = len(h) - n
    out = np.zeros(count, np.uint64)
    for k in range(n):
        at = k + (k == n - 1)
        out = mix(out * GOLDEN + h[at : at + count] + np.uint64(k + 1))
    return out.view(np.int64)


def least_seeds(length: int, k: int, threshold: float) -> int:
    """How many of an item's ``k``-word seeds, counted by place, a copy over the threshold has at least; 0 if it may have none."""
    bound = {2: threshold * length - 1, 3: (1.5 * threshold - 0.5) * length - 2}.get(k, 0)
    return max(0, math.ceil(bound - 1e-9))


def seed_words(length: int, n: int, threshold: float) -> int:
    """Of how many words an item's seeds are: ``n``, and of three only for items whose copies have some left."""
    low = _class(length)[1]
    return min(length, 2 if n == 3 and (low <= SHORT or not least_seeds(low, n, threshold)) else n)


def near_passages(h: np.ndarray, classes: list[tuple[int, int, int, int]], filters: dict[tuple[int, int], Bloom]) -> list[tuple[int, int, list[int]]]:
    """(class, passage, seeds) of the passages of a document that have enough different seeds of a class.

    Passages have twice ``span`` words, each beginning ``span`` words after the last; an alignment over the threshold has at most ``span`` words of the
    document. ``classes``: number, width of seeds, how many different ones it takes, and span.
    """
    grams, runs, run = {}, {}, mix(h + np.uint64(1))
    for k in range(1, max(c[1] for c in classes) + 1 if classes else 1):  # as ``windows`` has it, each run one word longer than the last
        runs[k] = run.view(np.int64)
        run = mix(run[:-1] * GOLDEN + h[k:] + np.uint64(k + 1)) if len(run) > 1 else run[:0]
    for k in {c[1] for c in classes}:
        # Places, widths with the skipped word, and seeds of what any item of this width may have.
        both = [(k, runs[k])]
        if k == 3 and len(h) > 3:
            both.append((4, mix(runs[2][: len(h) - 3].view(np.uint64) * GOLDEN + h[3:] + np.uint64(3)).view(np.int64)))
        at = [filters[-1, k].has(s.view(np.uint64)) for _, s in both]
        grams[k] = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, [np.full(len(x), w) for (w, _), x in zip(both, at)], [s[x] for (_, s), x in zip(both, at)])]
    out = []
    for c, k, kinds, span in classes:
        places, widths, seeds = grams[k]
        if len(seeds) < kinds:
            continue
        own = filters[c, k].has(seeds.view(np.uint64))
        if len(own) < kinds:
            continue
        places, widths, seeds = places[own], widths[own], seeds[own]
        passage = places // span
        also = (passage > 0) & (places % span + widths <= span)
        passage, seeds = np.append(passage, passage[also] - 1), np.append(seeds, seeds[also])
        few = np.bincount(passage)[passage] < kinds
        hit: dict[int, set[int]] = {}
        for p, seed in zip(passage[~few].tolist(), seeds[~few].tolist()):
            hit.setdefault(p, set()).add(seed)
        out += [(c, p, sorted(found)) for p, found in hit.items() if len(found) >= kinds]
    return out


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score): contaminated pairs, ``score`` the best alignment as a share of the item's words."""
    small_batches(docs.sparkSession)

    def cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t in zip(batch["item_id"], batch["text"]):
                h = _words32(t)
                if len(h):
                    k = seed_words(len(h), n, threshold)
                    seeds, times = np.unique(_seeds(h, k), return_counts=True)
                    need = max(1, least_seeds(len(h), k, threshold))
                    # How many different seeds it takes to have that many places.
                    kinds = int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), need)) + 1
                    out.append((key, _class(len(h))[0], k, h.astype(np.uint32).tobytes(), len(h), need, kinds, [{"seed": int(a), "times": int(b)} for a, b in zip(seeds, times)]))
            yield pd.DataFrame(out, columns=["item_id", "class", "k", "words", "length", "need", "kinds", "seeds"])

    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null")
    cut = store(named.mapInPandas(cut_items, "item_id long, class long, k long, words binary, length long, need long, kinds long, seeds array<struct<seed:long,times:long>>"), "items")
    # Items that repeat an id are each an item; seeds of both count for either.
    kept = cut.select("item_id", "class", "k", F.inline("seeds")).groupBy("item_id", "class", "k", "seed").agg(F.sum("times").alias("times"))
    kept = store(kept, "seeds")
    filters = _blooms(kept.select("class", "k", "seed").distinct(), {(r["class"], r["k"]): r["n"] for r in kept.groupBy("class", "k").agg(F.count_distinct("seed").alias("n")).collect()})
    classes = [
        (r["class"], r["k"], r["kinds"], max(1, math.ceil((2 - threshold) * r["longest"])))
        for r in cut.groupBy("class", "k").agg(F.max("length").alias("longest"), F.min("kinds").alias("kinds")).collect()
    ]

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    spans = {c[0]: c[3] for c in classes}

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(key, *row) for key, t in zip(batch["doc_id"], batch["text"]) for row in near_passages(_words32(t), classes, filters)]
            yield pd.DataFrame(out, columns=["doc_id", "class", "passage", "seeds"])

    place = ["doc_id", "class", "passage"]
    near = store(source.mapInPandas(passages, "doc_id long, class long, passage long, seeds array<long>"), "passages")
    spread = near.select(*place, F.explode("seeds").alias("seed"))
    # The rarest seeds of an item, so many that a copy has one of them.
    needs = cut.groupBy("item_id", "class", "k").agg(F.min("need").alias("need"))
    ranked = kept.join(spread.groupBy("class", "seed").agg(F.count("*").alias("n")), ["class", "seed"], "left").join(needs, ["item_id", "class", "k"])
    item = W.partitionBy("item_id", "class", "k")
    before = F.sum("times").over(item.orderBy(F.coalesce("n", F.lit(0)), "seed")) - F.col("times")
    probes = ranked.withColumns({"before": before, "all": F.sum("times").over(item)}).filter("before <= all - need and n is not null").select("class", "seed", "item_id", "k")
    probes = store(probes, "probes").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = spread.withColumn("salt", F.pmod(F.xxhash64("doc_id", "passage"), F.lit(SALTS)).cast("int")).join(probes, ["class", "seed", "salt"])
    met = store(met.select(*place, "item_id", "k").distinct(), "met")

    def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs that share as many seeds as a copy must."""
        for batch in batches:
            shared = [int(np.asarray(times)[np.isin(own, found)].sum()) for own, times, found in zip(batch["own"], batch["times"], batch["seeds"])]
            yield batch.loc[np.array(shared, np.int64) >= batch["need"].to_numpy(), [*place, "item_id"]]

    lists = kept.groupBy("item_id", "class", "k").agg(F.collect_list("seed").alias("own"), F.collect_list("times").alias("times")).join(needs, ["item_id", "class", "k"])
    tried = met.join(near, place).join(lists, ["item_id", "class", "k"]).select(*place, "item_id", "own", "times", "seeds", "need")
    pairs = store(tried.mapInPandas(enough, "doc_id long, class long, passage long, item_id long").distinct(), "candidates")
    drop(near, met)
    wanted = store(pairs.groupBy("doc_id").agg(F.collect_set(F.struct("class", "passage")).alias("places")), "wanted")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t, places in zip(batch["doc_id"], batch["text"], batch["places"]):
                h = _words32(t).astype(np.uint32)
                for q in places:
                    span = spans[q["class"]]
                    out.append((key, q["class"], q["passage"], h[q["passage"] * span : (q["passage"] + 2) * span].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "class", "passage", "passage_words"])

    own = source.join(wanted, "doc_id").mapInPandas(read, "doc_id long, class long, passage long, passage_words binary").filter("length(passage_words) > 0")
    tried = pairs.join(own, place).join(cut.select("item_id", "class", "words", "length"), ["item_id", "class"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["passage_words"].map(len).to_numpy() // 4
            batch, widths = batch.iloc[np.argsort(widths, kind="stable")], np.sort(widths)
            at = 0
            while at < len(batch):
                most = min(at + 256, len(batch))
                part = batch.iloc[at : min(most, at + max(1, CELLS // int(widths[most - 1])))]
                at += len(part)
                a, b = _padded(part["words"]), _padded(part["passage_words"])
                may = shared_words(a, b) >= threshold * part["length"].to_numpy()
                if not may.any():
                    continue
                part, got = part[may], align(a[may], b[may])
                out = part[["doc_id", "item_id"]].assign(score=got / part["length"].to_numpy())
                yield out[out["score"] >= threshold]

    scored = tried.select("doc_id", "item_id", "words", "length", "passage_words").mapInPandas(score, "doc_id long, item_id long, score double")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _padded(values: pd.Series) -> np.ndarray:
    rows = [np.frombuffer(v, np.uint32) for v in values]
    out = np.zeros((len(rows), max(map(len, rows))), np.uint32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a test item, or an edited copy of one."""
    found = contamination(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(found, F.col(doc_id).cast("long") == F.col("_leak_id"), "left_anti")
