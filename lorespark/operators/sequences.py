"""Operators over ordered rows: chunks, spans, ranking, eviction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.text import collapse

from .chunks import anchor_chunks as anchor_chunks
from .scans import has_hot_key, running


def joined_text(text: str, order: Sequence[str]) -> Column:
    """Aggregate: texts in order, white space collapsed, empty ones left out, joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, collapse(F.coalesce(F.col(text), F.lit(""))).alias("_text"))))
    return F.array_join(F.filter(F.transform(ordered, lambda s: s["_text"]), lambda t: t != ""), " ")


def lead_durations(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, last_end: str) -> DataFrame:
    """``rows`` with ``duration``: to the next start, the last to ``last_end``; never negative."""
    following = F.lead(start).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("duration", F.greatest(F.coalesce(following, F.col(last_end)) - F.col(start), F.lit(0)))


def range_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points in [start, end) of spans of the same keys, as an equi-join on buckets of ``bucket`` units.

    A span is repeated once for each bucket that it touches, so buckets should be about as wide as spans.
    """
    slot = lambda c: F.floor(F.col(c) / bucket)
    spread = spans.filter(F.col(end) > F.col(start)).withColumn("_slot", F.explode(F.sequence(slot(start), F.floor((F.col(end) - 1) / bucket))))
    joined = points.withColumn("_slot", slot(at)).join(spread, [*keys, "_slot"])
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_slot")


def nearest(rows: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, target: str, tolerance: float) -> DataFrame:
    """``rows`` with ``snapped``: the nearest target within ``tolerance``, the smaller of two as near; else the own value.

    Both tables are read in order once upwards and once downwards, instead of a join of all pairs; the points of one key may be many.
    """
    points = targets.select(*keys, F.col(target).alias("_t")).distinct()
    both = rows.withColumn("_at", F.col(at)).withColumn("_t", F.lit(None).cast(points.schema["_t"].dataType))
    both = both.unionByName(points.withColumn("_at", F.col("_t")), allowMissingColumns=True).withColumn("_row", F.col("_t").isNull())
    hot = has_hot_key(both, keys)
    found = running(both, keys, ["_at", "_row"], {"_below": ("last", "_t")}, hot)
    found = running(found, keys, [F.desc("_at"), F.asc("_row")], {"_above": ("last", "_t")}, hot).filter("_row")
    down, up = F.col(at) - F.col("_below"), F.col("_above") - F.col(at)
    best = F.when(F.col("_above").isNull() | (down <= up), F.col("_below")).otherwise(F.col("_above"))
    snapped = F.when(F.least(down, up) <= tolerance, best).otherwise(F.col(at))
    return found.withColumn("snapped", snapped).drop("_at", "_t", "_row", "_below", "_above")


def label_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, prefixes: dict[str, str]) -> DataFrame:
    """``rows`` of the labels in ``prefixes`` with ``label_id``: prefix and three digits, counted by label in order."""
    prefix = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    number = F.row_number().over(W.partitionBy(*keys, label).orderBy(*order))
    return rows.filter(F.col(label).isin(*prefixes)).withColumn("label_id", F.format_string("%s%03d", F.try_element_at(prefix, F.col(label)), number))


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``batch``: 0 for the first ``size`` rows of a key, and so on."""
    return running(rows, keys, order, {"batch": ("number", None)}).withColumn("batch", F.floor((F.col("batch") - 1) / size))


def shards(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """``rows`` with ``shard``: contiguous parts of ceil(n / count) rows, the last ones smaller or missing."""
    counted = running(rows, keys, order, {"shard": ("number", None), "_n": ("total", None)})
    return counted.withColumn("shard", F.floor((F.col("shard") - 1) / F.ceil(F.col("_n") / count))).drop("_n")


def coalesced_spans(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, most: int) -> DataFrame:
    """At most ``most`` spans a key: neighbours together in groups of ceil(n / most)."""
    grouped = shards(rows, keys, order, most)
    return grouped.groupBy(*keys, "shard").agg(F.min_by(start, F.struct(*order)).alias("start"), F.max_by(end, F.struct(*order)).alias("end"), F.count("*").alias("spans"))


def fallback_chain(attempts: DataFrame, keys: Sequence[str], order: str, tier: str, ok: str, reason: str) -> DataFrame:
    """One row a key: the first tier that is ok (``error`` without one), and ``tier:reason`` of all before it."""
    first = F.min(F.when(F.col(ok), F.col(order)))
    tried = F.array_sort(F.collect_list(F.struct(order, tier, reason)))
    found = attempts.groupBy(*keys).agg(first.alias("_ord"), F.min_by(tier, F.when(F.col(ok), F.col(order))).alias("source"), tried.alias("_tried"))
    failed = F.filter("_tried", lambda t: F.col("_ord").isNull() | (t[order] < F.col("_ord")))
    reasons = F.array_join(F.transform(failed, lambda t: F.concat(t[tier], F.lit(":"), t[reason])), "; ")
    return found.select(*keys, F.coalesce("source", F.lit("error")).alias("source"), F.when(F.size(failed) > 0, reasons).alias("fallback_reason"))


def ranked_tracks(tracks: DataFrame, keys: Sequence[str], language: str, kind: str, position: str, wanted: Sequence[str]) -> DataFrame:
    """The best track of each key: the order of ``wanted``, then exact, longer and shorter codes, then made over recognized, then position.

    A key without a track in a wanted language has no row; with nothing wanted the first track wins.
    """
    code = F.lower(F.coalesce(language, F.lit("")))
    rank = F.lit(None).cast("int")
    for i, want in reversed(list(enumerate(w.lower() for w in wanted))):
        fit = F.when(code == want, 0).when(code.startswith(want + "-"), 1).when((code != "") & F.startswith(F.lit(want), F.concat(code, F.lit("-"))), 2)
        rank = F.coalesce(fit + 3 * i, rank)
    ranked = tracks.withColumn("_rank", rank if wanted else F.lit(0)).filter("_rank is not null")
    made = (F.coalesce(kind, F.lit("")) == "asr").cast("int") if wanted else F.lit(0)
    best = F.row_number().over(W.partitionBy(*keys).orderBy("_rank", made, position))
    return ranked.withColumn("_n", best).filter("_n = 1").drop("_rank", "_n")


def evicted(files: DataFrame, keys: Sequence[str], size: str, used: str, tie: str, cap: int) -> DataFrame:
    """The files to delete, least recently used first, until those of a key total ``cap`` at most."""
    counted = running(files, keys, [used, tie], {"_excess": ("total", size), "_before": ("before", size)})
    return counted.withColumn("_excess", F.col("_excess") - F.lit(cap)).filter("_excess > 0 and _before < _excess").drop("_excess", "_before")


def filled_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """``rows`` with nulls of ``column`` replaced by the last value before them."""
    return running(rows, keys, order, {"_filled": ("last", column)}).withColumn(column, F.col("_filled")).drop("_filled")


def neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    own = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"previous_{column}": F.lag(column).over(own), f"next_{column}": F.lead(column).over(own)})


def image_names(outcomes: DataFrame, key: str, order: Sequence[str], ok: str) -> DataFrame:
    """Names of captured images: by the number of successes before (``image``) and by position (``step_image``)."""
    own = W.partitionBy(key).orderBy(*order)
    done = F.coalesce(F.sum(F.col(ok).cast("int")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = F.format_string("pyt_%s_%02d", F.col(key).cast("string"), done)
    return outcomes.withColumns({"image": F.when(F.col(ok), named), "step_image": F.format_string("pyt_%s_h%02d", F.col(key).cast("string"), F.row_number().over(own) - 1)})


def unique_paths(files: DataFrame, folder: str, base: str, order: Sequence[str], extension: str) -> DataFrame:
    """``files`` with ``path``: in order, base.ext or else the first of base-2.ext, base-3.ext and so on that is still free in its folder.

    Bases can only meet if they differ in numbers at their end. Where a folder has one such
    base, its files are numbered by a window; the others, which are few, are walked in order,
    with the names that a task's present folder and bases have taken.
    """
    stem = F.regexp_replace(F.col(base), r"(-\d+)+\z", "")
    named = files.withColumn("_stem", F.when(stem == "", F.col(base)).otherwise(stem))
    group = W.partitionBy(folder, "_stem")
    named = named.withColumn("_mixed", F.min(base).over(group) != F.max(base).over(group))
    n = F.row_number().over(W.partitionBy(folder, base).orderBy(*order))
    plain = named.filter("not _mixed").withColumn("_name", F.concat(F.col(base), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")))
    mixed = named.filter("_mixed").withColumn("_name", F.lit(None).cast("string"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, following = None, set(), {}
        for batch in batches:
            names = []
            for *key, wanted in zip(batch[folder].to_pylist(), batch["_stem"].to_pylist(), batch[base].to_pylist()):
                if key != last:
                    last, taken, following = key, set(), {}
                name, number = wanted, following.get(wanted, 2)
                while name in taken:
                    name, number = f"{wanted}-{number}", number + 1
                taken.add(name)
                following[wanted] = number
                names.append(name)
            yield batch.set_column(batch.schema.names.index("_name"), "_name", pa.array(names, pa.string()))

    walked = mixed.repartition(folder, "_stem").sortWithinPartitions(folder, "_stem", *order).mapInArrow(walk, mixed.schema)
    out = plain.unionByName(walked)
    return out.withColumn("path", F.concat_ws("/", F.col(folder), F.concat("_name", F.lit("." + extension)))).drop("_stem", "_mixed", "_name")


def repaired_plan(steps: DataFrame, known: DataFrame, keys: Sequence[str], order: str, start: str, end: str, ids: str, duration: str, most: int) -> DataFrame:
    """Steps clamped to [0, duration] without empty ones, renumbered by start and cut after ``most``.

    An id of ``known`` (keys, ``insight_id``) belongs to the first step that names it in the
    order given, before steps are sorted and cut; other ids go.
    """
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col(duration))
    clean = steps.withColumns({"_start": clamp(start), "_end": clamp(end)}).filter("_end > _start")
    named = clean.select(*keys, F.col(order).alias("_step"), F.posexplode(ids).alias("_pos", "insight_id")).join(known.select(*keys, "insight_id").distinct(), [*keys, "insight_id"])
    first = F.row_number().over(W.partitionBy(*keys, "insight_id").orderBy("_step", "_pos"))
    claimed = named.withColumn("_n", first).filter("_n = 1").groupBy(*keys, F.col("_step").alias(order)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "insight_id"))), lambda s: s["insight_id"]).alias("_ids"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("_start", "_end", order)).cast("long")
    out = clean.join(claimed, [*keys, order], "left").withColumn("index", number).filter(F.col("index") <= most)
    return out.select(*keys, "index", F.col("_start").alias("start_sec"), F.col("_end").alias("end_sec"), F.coalesce("_ids", F.array().cast("array<string>")).alias("insight_ids"))
