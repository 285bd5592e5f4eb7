"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a target number of words and a weight schedule over training
time 0..1, piecewise linear between knots. Its documents lie one after another
in a fixed pseudo-random order on the source's own word axis, which repeats up
to ``max_repeats`` times; the mix takes the first ``target`` words of that axis.
The schedule's integral is the demand that has accumulated by a time; inverting
it at a document's place on the word axis gives the time at which the document
is trained on, and documents are range-sorted by that time.

The pseudo-random order is that of a hash of the id and a digest of the text, so
reruns agree also where ids repeat or are null.

Defined results: a null or empty text has size 0, is never taken and has no
position; a null source is a source of its own, last in order; repeated rows are
separate documents; an empty table gives an empty mix. Columns other than the ones
named are carried along. Sources are tens or thousands: targets sort one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Knots (time, relative weight) of the curricula that sources take in turn: early, level, late.
CURRICULA = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(knots: tuple) -> Column:
    """A schedule's segments with its integral, scaled to 1 over the whole time."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / area
        values = {"t0": t0, "c0": done, "c1": done + part, "w0": w0 / area, "slope": (w1 - w0) / area / (t1 - t0)}
        out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
        done += part
    return F.array(*out)


def time_of(share: Column, rank: Column, curricula: tuple = CURRICULA) -> Column:
    """The time by which ``share`` of a source's demand has accumulated."""
    schedule = F.element_at(F.array(*map(_segments, curricula)), (rank % len(curricula) + 1).cast("int"))
    later = F.filter(schedule, lambda s: s["c1"] > share)
    s = F.coalesce(F.get(later, F.lit(0)), F.element_at(schedule, -1))
    need = share - s["c0"]
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["slope"] * need, F.lit(0.0)))
    return s["t0"] + F.when(need > 0, F.try_divide(2 * need, s["w0"] + root)).otherwise(0.0)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Targets of sources (columns ``source``, ``source_size``): weights in order of name, capped.

    The level at which uncapped sources share the rest follows from running sums
    over the sources in order of the level at which each is full; one row a source.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_repeats).cast("double")
    ranked = ranked.withColumns({"weight": weight, "cap": cap})
    full = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = full.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = lambda value: F.sum(value).over(whole) - F.coalesce(F.sum(value).over(before), F.lit(0.0))
    all_words = F.sum(F.col("source_size").cast("double")).over(whole)
    level = (all_words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left(F.col("weight"))
    ranked = ranked.withColumn("all_words", all_words).withColumn("capped", F.col("cap") <= level * F.col("weight"))
    kept = lambda value: F.coalesce(F.sum(F.when(F.col("capped"), value)).over(whole), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - kept(F.col("weight"))
    share = (F.col("all_words") - kept(F.col("cap"))) / F.when(open_weight > 0, open_weight)
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(share * F.col("weight"))).select("source", "source_size", "rank", "target")


def digest(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def plan(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: str, text_digest: str, weights: tuple = WEIGHTS, max_repeats: int = 3, curricula: tuple = CURRICULA) -> DataFrame:
    """Adds ``_mix``: struct(source_size, target, taken, passes: array of struct(take, position)).

    The running sum over a source, which may hold any share of the rows, is made in
    two steps: over 4096 hash buckets, then within each bucket.
    """
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col(text_digest)))
    named = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    keyed = docs.withColumns({"_mix_key": key, "_mix_source": named, "_mix_bucket": F.substring(key, 1, 3)})
    buckets = keyed.groupBy("_mix_source", "_mix_bucket").agg(F.sum(size).alias("_mix_words"))
    ordered = W.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.withColumn("_mix_offset", F.coalesce(F.sum("_mix_words").over(ordered), F.lit(0))).drop("_mix_words")
    sources = buckets.groupBy("_mix_source").agg(F.sum("_mix_words").alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("_mix_source").startswith("s"), F.expr("substring(_mix_source, 2)")))
    goals = targets(sources.select("source", "source_size"), weights, max_repeats)
    goals = goals.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_mix_source"), F.struct("source_size", "rank", "target").alias("_mix_goal"))
    offsets = offsets.join(goals, "_mix_source")
    within = W.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_key", size).rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.join(offsets, ["_mix_source", "_mix_bucket"]).withColumn("_mix_start", F.col("_mix_offset") + F.sum(size).over(within) - F.col(size))
    total, target = F.col("_mix_goal.source_size"), F.col("_mix_goal.target")

    def one(k: Column) -> Column:
        begin = k * total + F.col("_mix_start")
        take = F.greatest(F.lit(0).cast("long"), F.least(F.col(size), F.floor(target).cast("long") - begin))
        return F.struct(take.alias("take"), time_of(F.try_divide(begin + take / 2, target), F.col("_mix_goal.rank"), curricula).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long")), one), lambda p: p["take"] > 0)
    placed = placed.withColumn("_mix_passes", passes)
    taken = F.aggregate("_mix_passes", F.lit(0).cast("long"), lambda a, p: a + p["take"])
    mix = F.struct(total.alias("source_size"), target.alias("target"), taken.alias("taken"), F.col("_mix_passes").alias("passes"))
    return placed.select(*docs.columns, mix.alias("_mix"))


def range_sort(df: DataFrame, position: str, doc_id: str = "doc_id") -> DataFrame:
    """Documents in order of training position, over as many ranges as the session has shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(position).asc_nulls_last(), F.col(doc_id)]
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, one row for each pass over one, in training order, with the columns of ``docs``.

    A pass that the end of the target cuts is taken whole if the mix takes at least half of it.
    """
    text = F.col(options.pop("text", "text"))
    sized = docs.withColumns({"_mix_size": word_count(text), "_mix_digest": digest(text)})
    planned = plan(sized, size="_mix_size", text_digest="_mix_digest", **options)
    whole = F.filter("_mix.passes", lambda p: 2 * p["take"] >= F.col("_mix_size"))
    exploded = planned.select(*docs.columns, F.explode(whole).alias("_mix_pass")).withColumn("_mix_position", F.col("_mix_pass.position"))
    return range_sort(exploded, "_mix_position", options.get("doc_id", "doc_id")).select(*docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: its size, its source's size and target, the words taken, and its first position."""
    from .common import store

    doc_id, source = options.get("doc_id", "doc_id"), options.get("source", "source")
    text = options.pop("text", "text")
    sized = store(docs.select(doc_id, source, word_count(F.col(text)).alias("size"), digest(F.col(text)).alias("_digest")), "sizes")
    planned = plan(sized, size="size", text_digest="_digest", **options)
    flat = planned.select(doc_id, "size", "_mix.source_size", "_mix.target", "_mix.taken", F.get("_mix.passes", F.lit(0))["position"].alias("position"))
    return range_sort(flat, "position", doc_id).withColumn("position", F.round("position", 6))
