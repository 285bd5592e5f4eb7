"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, components.

Vectors compare only within a group (equal labels, equal length). Equal vectors are
one node with a count. Centroids are fitted by spherical k-means on at most ``sample``
nodes (smallest hash). Every node lies in the shell of its nearest cell that its angle to
the centroid gives. For a cosine of at least c two vectors are at most an
angle t apart, sin t = sqrt(1 - c*c). So a node is a guest of a shell of a smaller
number only if

* it lies within sin t of the plane between its own centroid and the shell's, and
* its angle to the shell's centroid is within t of the shell's angles,

and each pair over the threshold meets in exactly one shell: no link is lost. How much
this prunes depends on the vectors: those with clusters meet few shells, evenly spread
ones in many dimensions meet most, as they do by any exact bound. So the number of
cells (1, 4, 16, ... up to ``most_cells``), and whether cells have shells at all, are those that the sample finds cheapest:
the sum over the shells that a node visits of their sizes, ``block`` at least. The
choice sets the work, never the result.

Shells are cut into blocks of at most ``block`` nodes by hash, and pairs of blocks are
compared by one matrix product each, in double precision. A pair of blocks returns
how many vectors each node links with and a spanning forest of its links, never the
links themselves, so a large group of near copies costs rows in proportion to it.

Defined results: vectors that are null or zero or hold null or non-finite components,
and rows with a null label or id, link with nothing (``component_id`` is the own id,
``kept`` is true); a row that repeats an id counts as another vector, with links and a
component of its own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, drop, small_batches, store
from .graph import connected_components

THRESHOLD, SAMPLE, PER_CELL, MOST_CELLS, BLOCK, ROUNDS, PROBE = 0.93, 20_000, 100, 4_096, 1_024, 8, 1_024
#: Degrees: cells have one shell, or up to ``SHELLS`` shells.
THICKNESSES, SHELLS = (180.0, 6.0), 31
#: In how many parts rows of equal vectors, and of one shell, are dealt.
SALTS = 8


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """``k`` unit centroids of the unit rows of ``x``; fewer if there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[: max(1, k)]]
    for _ in range(rounds):
        nearest = np.concatenate([(x[at : at + 2_048] @ centroids.T).argmax(1) for at in range(0, len(x), 2_048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray
    thickness: float

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The shell (cell times ``SHELLS`` plus its number in the cell) of each row."""
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(x), 1_024):  # products of so many rows with all centroids at once
            near = x[at : at + 1_024] @ self.centroids.T
            home = near.argmax(1)
            angle = np.degrees(np.arccos(np.clip(near[np.arange(len(near)), home], -1, 1)))
            out[at : at + len(near)] = home * SHELLS + (angle / self.thickness).astype(np.int64)
        return out

    def guests(self, x: np.ndarray, shells: np.ndarray, threshold: float) -> list[np.ndarray]:
        """The smaller-numbered ones of ``shells`` (those that hold a row) that a partner of each row may lie in."""
        wide, reach = np.degrees(np.arccos(threshold)) + 1e-6, np.sqrt(1 - threshold * threshold) + 1e-9
        cell, least = shells // SHELLS, (shells % SHELLS) * self.thickness
        out: list[np.ndarray] = []
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            near, own = part @ self.centroids.T, self.homes(part)
            home = near.argmax(1)
            apart = np.sqrt(np.maximum(2 - 2 * self.centroids[home] @ self.centroids.T, 0))
            close = near[np.arange(len(part)), home][:, None] - near <= reach * apart
            angle = np.degrees(np.arccos(np.clip(near, -1, 1)))
            met = close[:, cell] & (angle[:, cell] >= least - wide) & (angle[:, cell] <= least + self.thickness + wide) & (shells < own[:, None])
            out += [shells[m] for m in met]
        return out


def cheapest_cells(x: np.ndarray, n: int, threshold: float, per_cell: int, most_cells: int, block: int = BLOCK) -> Cells:
    """The cells in which ``n`` vectors like the sample ``x``, in random order, are compared at the least cost."""
    best, least, k = None, np.inf, 1
    while k == 1 or k <= min(most_cells, n // per_cell, len(x) // 4):
        centroids = spherical_kmeans(x, k)
        for thickness in THICKNESSES:
            cells = Cells(centroids, thickness)
            shells, counts = np.unique(cells.homes(x), return_counts=True)
            size = np.maximum(counts * (n / len(x)), block)
            probe = x[:PROBE]
            visited = sum(size[np.searchsorted(shells, g)].sum() for g in cells.guests(probe, shells, threshold))
            cost = (visited + size[np.searchsorted(shells, cells.homes(probe))].sum() / 2) / len(probe)
            if cost < least:
                best, least = cells, cost
        k *= 4
    return best


def _compare(group: pd.DataFrame, threshold: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Links of one pair of blocks: (node, n) counts and (a, b) forest edges."""
    ids, count = group["node"].to_numpy(), group["n"].to_numpy()
    x, left, right = unit(group["v"]), group["left"].to_numpy(), group["right"].to_numpy()
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    hit = x[rows] @ x[columns].T >= threshold
    hit &= ids[rows][:, None] != ids[columns][None, :]
    links = np.zeros(len(ids), np.int64)
    links[rows] += hit @ count[columns]
    once = ~np.isin(columns, rows)
    links[columns[once]] += hit[:, once].T @ count[rows]
    # Smallest reachable node of the block, until nothing changes.
    label, far = ids.copy(), np.iinfo(np.int64).max
    rows_on, columns_on = hit.any(1), hit.any(0)
    while rows_on.any():
        before = label.copy()
        least = np.where(hit, label[columns][None, :], far).min(1)
        label[rows] = np.where(rows_on, np.minimum(label[rows], least), label[rows])
        least = np.where(hit, label[rows][:, None], far).min(0)
        label[columns] = np.where(columns_on, np.minimum(label[columns], least), label[columns])
        if (label == before).all():
            break
    on = links > 0
    edge = on & (label != ids)
    return pd.DataFrame({"node": ids[on], "n": links[on]}), pd.DataFrame({"a": label[edge], "b": ids[edge]})


def link_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, per_cell: int = PER_CELL, most_cells: int = MOST_CELLS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
    sound &= F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    sound &= F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False))
    plain = F.transform("v", lambda e: e + F.lit(0.0))  # no negative zeros
    marked = source.select("vec_id", "label", sound.alias("sound"), F.when(sound, plain).alias("v"))
    usable = marked.filter("sound").withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64("v", F.lit(1), "label")})
    key = ["k1", "k2"]
    named = store(usable.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label")), "vectors")
    # A node is named by its smallest id; vectors that share that id by a hash of theirs.
    shared = store(named.groupBy("vec_id").agg(F.count("*").alias("m")).filter("m > 1").select("vec_id", F.lit(True).alias("shared")), "shared-ids")
    nodes = named.join(shared, "vec_id", "left").withColumn("node", F.when(F.col("shared"), F.col("k1")).otherwise(F.col("vec_id")))
    nodes = store(nodes, "nodes")
    grouped = nodes.withColumn("part", F.concat_ws(":", F.size("v"), "label"))
    sizes = grouped.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))
    cells: dict[int, Cells] = {}
    for row in sizes.toLocalIterator():
        rows = bounded_sample(nodes.filter(F.size("v") == row["length"]).select("node", "v"), F.col("node"), sample).toPandas()
        cells[row["length"]] = cheapest_cells(unit(rows["v"]), row["n"] // row["labels"], threshold, per_cell, most_cells, block)

    def lie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, same in batch.groupby(batch["v"].map(len)):
                yield same.assign(cell=cells[length].homes(unit(same["v"])))[["part", "cell", "node", "n", "v"]]

    at_home = store(grouped.select("part", "node", "n", "v").mapInPandas(lie, "part string, cell long, node long, n long, v array<double>"), "homes")
    used: dict[int, list[int]] = {}  # at most ``SHELLS`` times ``most_cells`` for each length
    for row in at_home.select(F.size("v").alias("length"), "cell").distinct().toLocalIterator():
        used.setdefault(row["length"], []).append(row["cell"])
    shells = {length: np.array(sorted(found)) for length, found in used.items()}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, same in batch.groupby(batch["v"].map(len)):
                found = cells[length].guests(unit(same["v"]), shells[length], threshold)
                out = same.loc[np.repeat(same.index, list(map(len, found))), ["part", "node", "n", "v"]]
                yield out.assign(cell=np.concatenate(found))[["part", "cell", "node", "n", "v"]]

    visits = at_home.mapInPandas(visit, at_home.schema)
    placed = at_home.withColumn("guest", F.lit(False)).unionByName(visits.withColumn("guest", F.lit(True)))
    placed = store(placed, "cells")
    drop(at_home)
    loads = placed.groupBy("part", "cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"))
    loads = loads.select("part", "cell", F.ceil(F.col("homes") / block).cast("int").alias("hb"), F.ceil(F.col("guests") / block).cast("int").alias("gb")).filter("hb > 0")
    spot = lambda n: F.pmod(F.xxhash64("node", "cell"), F.greatest(n, F.lit(1))).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int"))
    own = dealt.join(loads.withColumn("salt", salts), ["part", "cell", "salt"]).drop("salt")
    own = own.withColumn("at", F.when(F.col("guest"), F.col("hb") + spot(F.col("gb"))).otherwise(spot(F.col("hb"))))
    # Home block i meets every home block j >= i and every guest block; a guest block meets home blocks only.
    every = F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1)
    meets = F.when(F.col("guest"), F.filter(every, lambda j: j < F.col("hb"))).otherwise(every)
    pairs = own.withColumn("other", F.explode(meets))
    pairs = pairs.select("part", "cell", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "node", "n", "v", "at")
    pairs = pairs.withColumns({"left": F.col("at") == F.col("i"), "right": F.col("at") == F.col("j")}).drop("at")
    keys = ["part", "cell", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pair of blocks; a pair may span batches."""
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            counts, edges = _compare(pd.concat(held, ignore_index=True), threshold)
            out = pd.concat([counts.assign(a=None, b=None), edges.assign(node=None, n=None)])
            return out[["node", "n", "a", "b"]].astype("Int64")

        for batch in batches:
            for key, at in groupby(range(len(batch)), key=list(zip(*[batch[k] for k in keys])).__getitem__):
                at = list(at)
                if held and key != last:
                    yield done()
                    held = []
                held.append(batch.iloc[at[0] : at[-1] + 1])
                last = key
        if held:
            yield done()

    dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    found = store(dealt.mapInPandas(compare, "node long, n long, a long, b long"), "links")
    drop(placed)
    counts = found.filter("node is not null").groupBy("node").agg(F.sum("n").alias("links"))
    components = connected_components(found.filter("a is not null").select("a", "b"))
    facts = nodes.select(*key, "vec_id", "shared", "node", "n").join(counts, "node", "left").join(components, "node", "left")
    facts = facts.filter("n > 1 or links is not null or shared").withColumn("component", F.coalesce("component", "node"))
    facts = store(facts.select(*key, "vec_id", "shared", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "facts")
    drop(named, nodes, shared, found)
    # Components with a node that is named by a hash take their smallest id; all others are named by it.
    hashed = store(facts.filter("shared").select("component").distinct(), "hashed")
    least = facts.join(hashed, "component", "left_semi").groupBy("component").agg(F.min("vec_id").alias("least"))
    facts = facts.join(least, "component", "left").select(*key, "n_links", F.coalesce("least", "component").alias("component_id"))
    salted = facts.withColumn("salt", salts)
    out = usable.select("vec_id", *key).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left")
    out = out.select("vec_id", "n_links", "component_id").unionByName(marked.filter("not sound").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
