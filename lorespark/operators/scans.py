"""Running numbers, sums and last values of a key's rows in order, also where one key has most of the rows.

As long as no key has more than ``HOT`` rows these are window functions. Beyond that, rows are sorted into
ranges of about equal size by key and order, so that a hot key's rows lie in many tasks; each range
adds up its rows of a key, the sums before each range (one row for each range and key) follow from a window
over those, and are joined to what every range counts by itself. The results are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.shared import store

#: Most rows of a key that one task sorts and walks.
HOT = 1_000_000


def has_hot_key(rows: DataFrame, keys: Sequence[str], most: int = HOT) -> bool:
    """Whether a key has more than ``most`` rows; counts are made in the tasks first, and one number comes back."""
    top = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (top or 0) > most


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``rows`` sorted by keys and order into ranges of about equal size and stored, with ``_range`` and ``_place``, which go up with the order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    return store(placed.withColumn("_range", F.shiftright("_place", 33)), "ranges")


def same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    """Equal in all columns, where null equals null."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], scans: Mapping[str, tuple[str, str | None]], hot: bool | None = None) -> DataFrame:
    """``rows`` with a column for each of ``scans``, name: (kind, column).

    Kinds: ``number`` counts the rows of a key from 1; ``before`` is the sum of a column over the rows before; ``total`` that over
    all rows of the key, or their number without a column; ``last`` the last value of a column that is not null up to
    this row. Null keys are one more key; ``order`` must be total for the result to be one. ``hot`` says
    whether a key has too many rows for a task, which is counted otherwise.
    """
    keys = list(keys)
    if not (has_hot_key(rows, keys) if hot is None else hot):
        own = W.partitionBy(*keys)
        along = own.orderBy(*order)
        return rows.withColumns({name: _window(kind, column, own, along) for name, (kind, column) in scans.items()})
    ranged = in_ranges(rows, keys, order)
    sums = {name: F.sum(column) if column else F.count("*") for name, (kind, column) in scans.items() if kind != "last"}
    lasts = {name: F.max_by(column, F.when(F.col(column).isNotNull(), F.col("_place"))) for name, (kind, column) in scans.items() if kind == "last"}
    parts = ranged.groupBy("_range", *keys).agg(*[v.alias(f"_own_{n}") for n, v in {**sums, **lasts}.items()])
    ahead = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    carried = {
        name: F.last(f"_own_{name}", ignorenulls=True).over(ahead) if kind == "last" else F.sum(f"_own_{name}").over(every) if kind == "total" else F.coalesce(F.sum(f"_own_{name}").over(ahead), F.lit(0))
        for name, (kind, _) in scans.items()
    }
    carry = parts.select("_range", *keys, *[v.alias(f"_carry_{n}") for n, v in carried.items()])
    joined = ranged.join(carry, same(ranged, carry, ["_range", *keys])).select(ranged["*"], *[carry[f"_carry_{n}"] for n in scans])
    inside = W.partitionBy("_range", *keys)
    along = inside.orderBy("_place")
    out = {}
    for name, (kind, column) in scans.items():
        own, before = _window(kind, column, inside, along), F.col(f"_carry_{name}")
        out[name] = before if kind == "total" else F.coalesce(own, before) if kind == "last" else before + own
    return joined.withColumns(out).drop("_range", "_place", *[f"_carry_{n}" for n in scans])


def _window(kind: str, column: str | None, own: W, along: W) -> Column:
    if kind == "number":
        return F.row_number().over(along).cast("long")
    if kind == "before":
        return F.coalesce(F.sum(column).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if kind == "total":
        return F.sum(column).over(own) if column else F.count("*").over(own)
    return F.last(column, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... over all of them in ``order``, which must be total.

    ``rows`` are evaluated once and stored. No window runs over all of them: a row's number is its place in its range
    after the numbers of the ranges before, of which there is one row each.
    """
    ranged = in_ranges(store(rows, "rows"), [], order)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + inside + 1).drop("_range", "_place", "_start")
