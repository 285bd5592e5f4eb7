"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

A document is the set of its word shingles (or the multiset: weights are counts).
Every element owns a region (weight axis x rank axis) into which a Poisson process,
seeded by the element alone, throws darts; a dart within the element's weight hits
one coordinate of the signature, and each coordinate keeps its earliest dart. Two
documents agree on a coordinate with a chance of their weighted Jaccard similarity,
at a cost of n + k log k for n elements and k coordinates.

Equal word sequences are one class member from the start. Signatures are cut into
bands, and equal bands share a bucket. Hot buckets, leaders and texts are split: rows
that join on them carry a salt of the document, and the other side is repeated for
each salt. In each bucket every member is compared with
the smallest one by exact similarity of shingle sets; in buckets whose members are
then still in different components, the members outside the leader's component are
compared with all members, block by block. Pairs at or over the threshold link.

Defined results: null, empty and blank texts, and rows with a null id, are alone
(``class_id`` is the id itself); texts of fewer words than a shingle are one shingle
of all their words; rows that repeat an id and a text are one member; different texts
whose smallest ids are the same are one node, alike to all that one of them is alike
to; an empty table gives an empty result. Other columns are ignored by
:func:`classes` and carried by :func:`deduplicate`, which keeps one document of a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions.text import SPACE

from .common import drop, small_batches, store
from .graph import connected_components
from .words import GOLDEN, jaccard, mix, unpack, windows, word_hashes

BANDS, ROWS, SHINGLE, THRESHOLD = 24, 6, 5, 0.8
#: Most rows of either side of a block in which documents of a bucket are compared.
BLOCK = 256
#: In how many parts keys of unknown weight are split, and how many members of a bucket meet their leader in one part.
SALTS, MEETING = 8, 256
#: Poisson distribution of mean 1: how many darts a unit of area gets.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
UNIT = 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * UNIT


def signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """DartMinHash: a row of ``k`` dart ids for each non-empty set of element hashes.

    Darts are thrown up to a rank at which k (ln k + 4) of them are expected; a set
    that then lacks a coordinate is done again with twice the rank.
    """
    out = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    mass = np.array([w.sum() for w in weights]) if weights else sizes.astype(float)
    left, scale = np.flatnonzero(sizes), k * (np.log(k) + 4)
    while len(left):
        flat = np.concatenate([sets[i] for i in left])
        doc = np.repeat(left, sizes[left])
        weight = np.concatenate([weights[i] for i in left]) if weights else None
        top = np.zeros(len(sets))
        top[left] = scale / mass[left]
        # Unit areas: one for each started unit of rank and of weight.
        ranks = np.ceil(top[doc]).astype(np.int64)
        areas = ranks if weight is None else ranks * np.ceil(weight).astype(np.int64)
        owner = np.repeat(np.arange(len(flat)), areas)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(areas) - areas, areas)
        level, step = nth % ranks[owner], nth // ranks[owner]
        seed = mix(flat[owner] + mix((level.astype(np.uint64) << np.uint64(32)) + step.astype(np.uint64) + GOLDEN))
        darts = np.searchsorted(POISSON, _uniform(seed), side="right")
        area = np.repeat(np.arange(len(owner)), darts)
        count = np.arange(len(area)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(seed[area] + (count.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        rank = level[area] + _uniform(dart)
        place = mix(dart ^ GOLDEN)
        thrown_at = doc[owner[area]]
        hit = rank < top[thrown_at]
        if weight is not None:
            hit &= step[area] + _uniform(mix(place + GOLDEN)) < weight[owner[area]]
        rank, place, dart, thrown_at = rank[hit], place[hit], dart[hit], thrown_at[hit]
        # Earliest first: the rank in steps of 2**-28, then bits of the dart itself.
        value = ((rank * 2.0**28).astype(np.uint64) << np.uint64(20)) | (dart & np.uint64(0xFFFFF))
        np.minimum.at(out.reshape(-1), thrown_at * k + (place % np.uint64(k)).astype(np.int64), value)
        left = left[(out[left] == np.iinfo(np.uint64).max).any(axis=1)]
        scale *= 2
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        out = mix(out * GOLDEN + parts[:, :, r])
    return out.view(np.int64)


def _signed(docs: DataFrame, bands: int, rows: int, shingle: int, weighted: bool) -> DataFrame:
    """(doc_id, hash, words, bands): hashes of the text and of the word sequence, and band keys, the last two null for texts without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                found = [word_hashes(t) for t in part["text"]]
                runs = [windows(f, shingle) for f in found]
                pairs = [np.unique(r, return_counts=True) for r in runs]
                got = signatures([p[0] for p in pairs], bands * rows, [p[1].astype(float) for p in pairs] if weighted else None)
                keys = bands_of(got, bands, rows)
                same = [hashlib.md5(f.tobytes()).digest() if len(f) else None for f in found]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "hash": part["hash"].to_numpy(), "words": same, "bands": [k if s else None for k, s in zip(keys, same)]})

    return docs.withColumn("hash", F.xxhash64("text")).mapInPandas(sign, "doc_id long, hash long, words binary, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Shingle sets as 32-bit hashes: two different shingles of documents of n words are taken as one with a chance of n**2 / 2**32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(windows(word_hashes(t), shingle) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": found})

    return docs.mapInPandas(cut, "doc_id long, shingles binary")


def _salted(df: DataFrame, salts: int | Column = SALTS) -> DataFrame:
    """Every row once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts) - 1 if isinstance(salts, int) else salts - 1)))


def _salt(salts: int | Column = SALTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(salts) if isinstance(salts, int) else salts).cast("int")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least as similar as ``threshold``.

    ``pairs``: leader a, member b, and in how many ``parts`` the leader's members meet it.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [jaccard(x, y) >= threshold for x, y in zip(unpack(batch["sa"]), unpack(batch["sb"]))]
            yield batch.loc[hit, ["a", "b"]]

    leaders = _salted(pairs.groupBy("a").agg(F.max("parts").alias("parts")), F.col("parts")).drop("parts")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).join(leaders, "a")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    spread = pairs.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(3)), "parts").cast("int"))
    return spread.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "sa", "sb").mapInPandas(compare, "a long, b long")


def similar_rows(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i among ``rows`` and j among ``columns``, of pairs at or over ``threshold``.

    Intersections are products of 0/1 matrices, over at most 4096 elements at a time.
    """
    sizes = np.array([len(s) for s in sets])
    used = np.union1d(rows, columns)
    names, place = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    shared = np.zeros((len(rows), len(columns)), np.float32)
    owner = np.repeat(used, sizes[used])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    row_at, column_at = np.full(len(sets), -1), np.full(len(sets), -1)
    row_at[rows], column_at[columns] = np.arange(len(rows)), np.arange(len(columns))
    for low in range(0, len(names), 4096):
        cut = slice(*np.searchsorted(place, [low, low + 4096]))
        p, o = place[cut] - low, owner[cut]
        left, right = np.zeros((len(rows), 4096), np.float32), np.zeros((len(columns), 4096), np.float32)
        on = row_at[o] >= 0
        left[row_at[o[on]], p[on]] = 1
        on = column_at[o] >= 0
        right[column_at[o[on]], p[on]] = 1
        shared += left @ right.T
    union = sizes[rows][:, None] + sizes[columns][None, :] - shared
    hit = np.nonzero(shared.astype(np.float64) >= threshold * union)
    return rows[hit[0]], columns[hit[1]]


def _blockwise(members: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between components inside buckets: members outside the leader's component against all.

    ``members``: band, key, doc_id, component, outside, n_outside, n. A pair of blocks
    is one group of at most twice ``block`` rows; of the links between two components in
    it one is returned.
    """
    n_rows = F.ceil(F.col("n_outside") / block).cast("int")
    n_columns = F.ceil(F.col("n") / block).cast("int")
    spot = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = members.withColumns({"i": every(n_rows), "j": spot(n_columns, 1), "row": F.lit(False)})
    rows = members.filter("outside").withColumns({"j": every(n_columns), "i": spot(n_rows, 2), "row": F.lit(True)})
    both = columns.unionByName(rows).select("band", "key", "i", "j", "row", "doc_id", "component")
    keys = ["band", "key", "i", "j"]

    def links(group: pd.DataFrame) -> pd.DataFrame:
        found = unpack(group["shingles"])
        component, ids = group["component"].to_numpy(), group["doc_id"].to_numpy()
        rows, columns = np.flatnonzero(group["row"].to_numpy()), np.flatnonzero(~group["row"].to_numpy())
        if not len(rows) or not len(columns):
            return pd.DataFrame({"a": [], "b": []})
        a, b = similar_rows(found, rows, columns, threshold)
        new = component[a] != component[b]
        a, b = a[new], b[new]
        _, first = np.unique(np.stack([component[a], component[b]], 1), axis=0, return_index=True) if len(a) else (None, np.zeros(0, int))
        return pd.DataFrame({"a": ids[a[first]], "b": ids[b[first]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; a group may span batches."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, at in groupby(range(len(batch)), key=list(zip(*[batch[k] for k in keys])).__getitem__):
                at = list(at)
                part = batch.iloc[at[0] : at[-1] + 1]
                if held and any(held[-1][k].iloc[0] != part[k].iloc[0] for k in keys):
                    yield links(pd.concat(held)).astype("int64")
                    held = []
                held.append(part)
        if held:
            yield links(pd.concat(held)).astype("int64")

    full = both.join(sets, "doc_id").repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return full.sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def classes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, kept), one row for each row of ``docs``; ``class_id`` is the smallest id of the class."""
    return _classes(docs, **options).drop("hash")


def _classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, threshold: float = THRESHOLD, weighted: bool = False, block: int = BLOCK) -> DataFrame:
    """As :func:`classes`, with the ``hash`` of each text."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = store(_signed(source.filter("doc_id is not null"), bands, rows, shingle, weighted), "signed")
    usable = signed.filter("words is not null")
    first = store(usable.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "texts")
    spread = first.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("band", "key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("leader <> last").drop("last")
    members = spread.withColumn("salt", _salt()).join(_salted(shared), ["band", "key", "salt"]).drop("salt")
    members = store(members, "buckets")
    wanted = store(members.select("doc_id").distinct(), "wanted")
    sets = store(_sets(source.join(wanted, "doc_id", "left_semi"), shingle).dropDuplicates(["doc_id", "shingles"]), "sets")
    parts = F.ceil(F.max("n") / MEETING).cast("int").alias("parts")
    pairs = store(members.filter("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(parts), "pairs")
    links = store(_linked(pairs, sets, threshold), "links")
    found = store(connected_components(links), "components")
    placed = members.drop("n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = store(placed, "placed")
    # Every member has met the leader; buckets of the same members need one look.
    met = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    by_component = placed.groupBy("band", "key", "component").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *met)
    met = [F.bit_xor(f"x{k}").alias(f"x{k}") for k in (1, 2)]
    heads = by_component.groupBy("band", "key").agg(F.min_by("component", "doc_id").alias("lead"), F.count("*").alias("components"), F.sum("n").alias("n"), (F.sum("n") - F.min_by("n", "doc_id")).alias("n_outside"), *met)
    heads = heads.filter("components > 1 and n > 2").dropDuplicates(["n", "x1", "x2"]).select("band", "key", "lead", "n", "n_outside")
    split = placed.filter("doc_id <> leader").drop("leader").withColumn("salt", _salt()).join(_salted(heads), ["band", "key", "salt"]).drop("salt")
    split = split.withColumn("outside", F.expr("component <> lead")).drop("lead")
    more = _blockwise(split, sets, threshold, block)
    both = store(links.unionByName(more), "all-links")
    final = connected_components(both).withColumnRenamed("node", "doc_id")
    drop(members, wanted, sets, pairs, links, found, placed, both)
    # Texts with copies, or with a component, name the class of their rows; every other row is its own.
    named = first.join(final, "doc_id", "left").filter("copies > 1 or component is not null").select("words", F.coalesce("component", "doc_id").alias("class_id"))
    out = usable.select("doc_id", "hash", "words").withColumn("salt", _salt()).join(_salted(named), ["words", "salt"], "left")
    out = out.select("doc_id", "hash", F.coalesce("class_id", "doc_id").alias("class_id"))
    alone = signed.filter("words is null").select("doc_id", "hash").unionByName(source.filter("doc_id is null").select("doc_id", F.xxhash64("text").alias("hash")))
    out = out.unionByName(alone.withColumn("class_id", F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are not kept, and with one row for each id and text.

    Rows with a null id and rows without words are alone in their class and all stay. What
    goes is a table of ids; texts are shuffled only if that is too large to broadcast.
    """
    found = _classes(docs, doc_id=doc_id, text=text, **options).filter("doc_id is not null")
    marks = store(found.groupBy("doc_id", "hash").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "marks")
    own = [F.col("doc_id").alias("_near_id"), F.col("hash").alias("_near_hash")]
    drop, many = store(marks.filter("not kept").select(*own), "dropped"), store(marks.filter("kept").select(*own), "repeated")
    same = (F.col(doc_id).cast("long") == F.col("_near_id")) & (F.xxhash64(text) == F.col("_near_hash"))
    left = docs.join(drop, same, "left_anti")
    if many.isEmpty():
        return left
    once = left.join(many, same, "left_anti")
    number = F.row_number().over(W.partitionBy(F.col(doc_id), F.xxhash64(text)).orderBy(F.lit(0)))
    first = left.join(many, same, "left_semi").withColumn("_near_n", number)
    first = first.filter((F.col("_near_n") == 1) | F.col(text).isNull() | F.col(text).rlike(rf"\A{SPACE}*\z")).drop("_near_n")
    return once.unionByName(first)
