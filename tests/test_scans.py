"""Running numbers, sums and last values, and chunks, of keys too large for one task: the same as the plain walk."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import chunks, scans
from lorespark.operators import sequences as seq

ROWS = "k string, pos int, at double, v long"


def timeline(seed, n, hot=0.8):
    """Rows of a hot key, a few others and a null key, with nulls among starts and values, and starts that sometimes fall."""
    rng = np.random.default_rng(seed)
    out = []
    for pos in range(n):
        key = "hot" if rng.random() < hot else [None, "a", "b"][int(rng.integers(3))]
        at = float(np.round(pos * 3 + rng.normal(0, 20), 1))
        out.append((key, pos, None if rng.random() < 0.1 else at, None if rng.random() < 0.3 else int(rng.integers(-5, 9))))
    return out


def by_key(rows):
    return [list(of) for _, of in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1])), key=lambda r: r[0])]


@pytest.mark.parametrize("hot", [False, True])
def test_running_is_the_plain_walk(spark, hot):
    rows = timeline(1, 600)
    want = []
    for of in by_key(rows):
        last, before, total = None, 0, sum(r[3] or 0 for r in of)
        for number, r in enumerate(of, 1):
            last = last if r[3] is None else r[3]
            want.append((r[0], r[1], number, before, total, len(of), last))
            before += r[3] or 0
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    got = scans.running(frame, ["k"], ["pos"], {"n": ("number", None), "b": ("before", "v"), "t": ("total", "v"), "c": ("total", None), "l": ("last", "v")}, hot)
    assert got.columns == [*frame.columns, "n", "b", "t", "c", "l"]
    assert sorted(map(str, (tuple(r) for r in got.select("k", "pos", "n", "b", "t", "c", "l").collect()))) == sorted(map(str, want))
    assert scans.running(frame.limit(0), ["k"], ["pos"], {"n": ("number", None)}, hot).count() == 0


def test_rows_of_a_hot_key_lie_in_many_ranges(spark):
    rows = spark.range(40_000).select(F.lit("k").alias("k"), (F.col("id") * F.col("id") % 40_009).alias("pos"))
    sizes = [r["count"] for r in scans.in_ranges(rows, ["k"], ["pos"]).groupBy("_range").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 0.5 * 40_000
    assert scans.has_hot_key(rows, ["k"], 39_999) and not scans.has_hot_key(rows, ["k"], 40_000) and not scans.has_hot_key(rows.limit(0), ["k"])


def test_numbered_with_outliers_and_ties(spark):
    rows = [(1e12 if k == 0 else float(k % 3), k) for k in range(3_000)] + [(None, -1)]
    got = scans.numbered(spark.createDataFrame(rows, "lead double, id long"), ["lead", "id"], "n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert {(r["lead"], r["id"]): r["n"] for r in got} == {r: n for n, r in enumerate(want, 1)}
    ranges = scans.in_ranges(spark.createDataFrame(rows, "lead double, id long"), [], ["lead", "id"]).groupBy("_range").count().collect()
    assert max(r["count"] for r in ranges) < 2_000


def test_operators_give_the_same_for_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame(timeline(2, 400), ROWS).filter("at is not null and v > 0")
    points = rows.select("k", (F.col("at") + 4).alias("t"))
    found = []
    for most in (10**6, 3):
        for module in (seq, scans):
            monkeypatch.setattr(module, "has_hot_key", lambda rows, keys, hot=most < 10: hot)
        found.append([
            sorted(map(str, (tuple(r[c] for c in ("k", "pos", name)) for r in frame.collect())))
            for name, frame in {
                "snapped": seq.nearest(rows, points, ["k"], "at", "t", 4.0), "batch": seq.batches(rows, ["k"], ["pos"], 7), "shard": seq.shards(rows, ["k"], ["pos"], 3),
                "at": seq.evicted(rows, ["k"], "v", "at", "pos", 100), "v": seq.filled_forward(spark.createDataFrame(timeline(3, 300), ROWS), ["k"], ["pos"], "v"),
            }.items()
        ])
        assert all(found[-1])
    assert found[0] == found[1]


def walked(starts, width, anchor=None, chunk=0):
    out = []
    for at in starts:
        if anchor is None:
            anchor = at
        elif at is not None and at >= anchor + width:
            anchor, chunk = at, chunk + 1
        out.append((chunk, anchor))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_a_range_sums_up_to_what_a_walk_does(seed):
    rng = np.random.default_rng(seed)
    starts = [None if rng.random() < 0.1 else float(x) for x in (np.cumsum(rng.integers(-4, 9, 40)) if seed % 2 else rng.integers(0, 60, 40))]
    bounds, anchors, begun, first = chunks.transfer(starts, 10)
    assert bounds == sorted(bounds)
    assert (first[1], first[0]) == walked(starts, 10)[-1]
    for anchor in np.arange(-30, 260, 0.5):
        k = next((k for k, b in enumerate(bounds) if b >= anchor + 10), None)
        assert ((begun[k], anchors[k]) if k is not None else (0, anchor)) == walked(starts, 10, anchor)[-1]
    assert chunks.transfer([None, None], 10) == ([], [], [], None)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", [4, 5])
def test_chunks_of_a_hot_key(spark, hot, seed):
    rows = timeline(seed, 500)
    want = [(r[0], r[1], *state) for of in by_key(rows) for r, state in zip(of, walked([r[2] for r in of], 30))]
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    got = chunks.anchor_chunks(frame, ["k"], ["pos"], "at", 30, hot)
    assert got.columns == [*frame.columns, "chunk", "chunk_start"]
    assert sorted(map(str, (tuple(r) for r in got.select("k", "pos", "chunk", "chunk_start").collect()))) == sorted(map(str, want))


def test_chunks_of_one_large_key_run_in_many_tasks(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") * 7 % 1000 + F.col("id")).alias("at"))
    many = chunks.anchor_chunks(rows, ["k"], ["pos"], "at", 5_000, True).select("pos", "chunk", "chunk_start", F.spark_partition_id().alias("task"))
    plain = chunks.anchor_chunks(rows, ["k"], ["pos"], "at", 5_000, False).select("pos", "chunk", "chunk_start")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share a task
    tasks = many.select("task").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1 and many.drop("task").exceptAll(plain).count() == 0
