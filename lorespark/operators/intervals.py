"""Repair of a talk's segments into a partition of its length.

Who owns a second follows from the segments that cover it, and from nothing else: the
first by start, end and position has the claim; another takes it over if it ends no
later than the one that has it and is not a lecture. So in the end the claim is with the one that ends first
of those that are not lectures (of equals the last), or with the very first if that ends before. Seconds that none covers belong to
the owner before them, those before the first segment to that. Runs of one owner are
spans; lectures shorter than ``FRAGMENT`` join the span before them, the first one that after it.

Owners change only at bounds of segments. Spark sorts a talk's segments by start; a task walks them once and holds
the open ones in two heaps, by order and by end, which give the owner at each bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequences import nearest

SNAP, FRAGMENT, LECTURE = 45, 20, "lecture"


PIECES = "at long, duration long, own struct<pos:long,label:string,summary:string>"


class _Open:
    """The open segments of a talk; ``at`` is the bound that is still to be told."""

    def __init__(self, duration: int):
        self.duration, self.at, self.ends, self.told = duration, None, [], []
        self.by_order: list[tuple] = []  # (number, end, own)
        self.by_end: list[tuple] = []  # (end, -number, own), without lectures

    def add(self, number: int, start: int, end: int, lecture: bool, own: dict) -> None:
        if self.at is not None and start > self.at:
            self.tell(start)
        self.at = start
        heappush(self.by_order, (number, end, own))
        heappush(self.ends, end)
        if not lecture:
            heappush(self.by_end, (end, -number, own))

    def tell(self, before: int | None = None) -> None:
        """Owners at the bounds up to ``before``, or at all that are left."""
        last = None
        while self.at is not None:
            if self.at != last and self.at < self.duration:
                self.told.append((self.at, self._owner()))
            last, self.at = self.at, None
            while self.ends and (before is None or self.ends[0] < before) and self.at is None:
                end = heappop(self.ends)
                self.at = end if end > last else None

    def _owner(self) -> dict | None:
        while self.by_order and self.by_order[0][1] <= self.at:
            heappop(self.by_order)
        while self.by_end and self.by_end[0][0] <= self.at:
            heappop(self.by_end)
        if not self.by_order:
            return None
        first = self.by_order[0]
        return self.by_end[0][2] if self.by_end and self.by_end[0][0] <= first[1] else first[2]


def owners(segments: DataFrame, key: str) -> DataFrame:
    """(key, at, duration, own): who owns the time from each bound of a talk's segments on; null where none is open."""
    names = [key, "start_sec", "end_sec", "pos", "label", "summary", "duration"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_, number = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for talk, start, end, pos, label, summary, duration in zip(*[batch[n].to_pylist() for n in names]):
                if open_ is None or talk != last:
                    if open_ is not None:
                        open_.tell()
                        out += [(last, at, open_.duration, own) for at, own in open_.told]
                    last, open_, number = talk, _Open(duration), 0
                open_.add(number, start, end, label == LECTURE, {"pos": pos, "label": label, "summary": summary})
                number += 1
                out += [(last, at, open_.duration, own) for at, own in open_.told]
                open_.told.clear()
            kind = batch.schema.field(key).type
            yield rows(out, kind)
        if open_ is not None:
            open_.tell()
            yield rows([(last, at, open_.duration, own) for at, own in open_.told], kind)

    def rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        own = pa.struct([("pos", pa.int64()), ("label", pa.string()), ("summary", pa.string())])
        kinds = {key: kind, "at": pa.int64(), "duration": pa.int64(), "own": own}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    kind = segments.schema[key].dataType.simpleString()
    ordered = segments.select(names).repartition(key).sortWithinPartitions(key, "start_sec", "end_sec", "pos")
    return ordered.mapInArrow(walk, f"`{key}` {kind}, {PIECES}")


def _with_ends(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` with ``end_sec``: where the next one starts, or the talk ends."""
    return spans.withColumn("end_sec", F.coalesce(F.lead("start_sec").over(W.partitionBy(key).orderBy("start_sec")), F.col("duration")))


def repaired_segments(segments: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, pos, start_sec, end_sec, label, summary): each talk's segments as a partition of its ``duration``.

    ``segments`` has key, pos, start_sec, end_sec, label, summary and duration, ``points`` key
    and start_sec. Bounds are clamped and snap to the nearest point within ``SNAP`` seconds;
    segments that are then empty, and those of a null key or duration, go.
    """
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("duration"))
    out = segments.select(key, "pos", "start_sec", "end_sec", "label", "summary", "duration").filter(F.col(key).isNotNull() & (F.col("duration") > 0))
    for bound in ("start_sec", "end_sec"):
        out = nearest(out.withColumn(bound, clamp(bound)), points.select(key, F.col("start_sec").cast("long").alias("point")), [key], bound, "point", SNAP).withColumn(bound, F.col("snapped")).drop("snapped")
    out = out.filter("end_sec > start_sec").withColumns({c: F.col(c).cast("long") for c in ("start_sec", "end_sec", "duration")})
    first = F.row_number().over(W.partitionBy(key).orderBy("start_sec", "end_sec", "pos")) == 1
    out = out.withColumn("start_sec", F.when(first, 0).otherwise(F.col("start_sec")).cast("long"))

    along = W.partitionBy(key).orderBy("at")
    pieces = owners(out, key).withColumn("own", F.last("own", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)))
    starts = pieces.withColumn("before", F.lag("own.pos").over(along)).filter("before is null or before <> own.pos")
    spans = _with_ends(starts.select(key, "duration", F.col("at").alias("start_sec"), "own.label", "own.summary"), key)

    order = W.partitionBy(key).orderBy("start_sec")
    short = F.col("label").eqNullSafe(LECTURE) & (F.col("end_sec") - F.col("start_sec") < FRAGMENT)
    number = F.row_number().over(order)
    spans = _with_ends(spans.withColumn("n", number).filter(~short | (F.col("n") == 1)).drop("end_sec"), key)
    spans = spans.withColumn("n", number).filter(~short | (F.col("n") > 1) | (F.col("end_sec") == F.col("duration")))
    place = number - 1
    return spans.select(key, place.cast("int").alias("pos"), F.when(place == 0, 0).otherwise(F.col("start_sec")).cast("long").alias("start_sec"), "end_sec", "label", "summary")
