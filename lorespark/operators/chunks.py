"""Chunks of a timeline that start anew at a row: each ends where a row starts ``width`` or more after its first.

Where a chunk ends depends on where it began, so a key's rows form one chain. For keys of up to
``scans.HOT`` rows a task walks the chain. Beyond that, a key's rows lie in ranges of about equal size, and every
range is summed up, without knowing what comes before it, as a map from the anchor that comes in to
the anchor that goes out and the number of chunks begun: whatever comes in, the first row that starts a
chunk is one that starts later than all rows of the range before it, and what follows depends on that row alone. The maps of a key are
composed in order (a search in each), which tells every range the anchor and chunk that it begins with, and then all ranges are walked
at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scans import has_hot_key, in_ranges, same

STATE = ["_anchor", "_chunk"]


def transfer(starts: Sequence[float | None], width: float) -> tuple[list, list, list, tuple | None]:
    """What a range of rows does to the anchor that comes in: (bounds, anchors, begun, first).

    An anchor a goes out as ``anchors[k]`` after ``begun[k]`` new chunks, k the first with ``bounds[k] >= a + width``, and
    as it is if there is none. ``first`` is (anchor, begun) for no anchor, null if no row has a start.
    """
    known = [s for s in starts if s is not None]
    out: list[tuple] = [()] * len(known)
    later: list[int] = []  # rows after this one that start later than all between, the nearest last
    for k in range(len(known) - 1, -1, -1):
        reach = known[k] + width
        low, high = 0, len(later)  # starts fall from the first entry to the last
        while low < high:
            middle = (low + high) // 2
            if known[later[middle]] >= reach:
                low = middle + 1
            else:
                high = middle
        following = later[low - 1] if low else None
        out[k] = (known[k], 0) if following is None else (out[following][0], out[following][1] + 1)
        while later and known[later[-1]] <= known[k]:
            later.pop()
        later.append(k)
    bounds, anchors, begun = [], [], []
    for k in reversed(later):
        anchor, count = out[k][0], out[k][1] + 1
        if anchors and (anchors[-1], begun[-1]) == (anchor, count):
            bounds[-1] = known[k]
        else:
            bounds.append(known[k])
            anchors.append(anchor)
            begun.append(count)
    return bounds, anchors, begun, out[0] if out else None


def anchor_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, width: float, hot: bool | None = None) -> DataFrame:
    """``rows`` with ``chunk`` (0, 1, ...) and ``chunk_start``: a chunk ends where a row starts ``width`` or more after its first.

    Rows are taken in the order given, never sorted by start, which may fall. Rows whose
    key is null are those of one more key; a row without a start belongs to the chunk
    it is met in. ``hot`` says whether a key has too many rows for a task, which is counted otherwise.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    keys = list(keys)
    if not (has_hot_key(rows, keys) if hot is None else hot):
        return _walked(rows.repartition(*keys).sortWithinPartitions(*keys, *order), keys, start, width, rows.schema)
    kind = rows.schema[start].dataType
    ranged = in_ranges(rows, keys, order)
    together = ["_range", *keys]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def row() -> pa.RecordBatch:
            bounds, anchors, begun, first = transfer(held, width)
            values = [*last, bounds, anchors, begun, first and first[0], first and first[1]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape)], schema=shape)

        for batch in batches:
            if last is None:
                at = batch.schema.field(start).type
                shape = pa.schema([*[batch.schema.field(k) for k in together], ("_bounds", pa.list_(at)), ("_anchors", pa.list_(at)), ("_begun", pa.list_(pa.int64())), ("_first", at), ("_first_begun", pa.int64())])
            for key, at in zip(zip(*[batch[k].to_pylist() for k in together]), batch[start].to_pylist()):
                if key != last and last is not None:
                    yield row()
                    held = []
                last = key
                held.append(at)
        if last is not None:
            yield row()

    fields = [ranged.schema[k] for k in together] + [T.StructField("_bounds", T.ArrayType(kind)), T.StructField("_anchors", T.ArrayType(kind)), T.StructField("_begun", T.ArrayType(T.LongType())), T.StructField("_first", kind), T.StructField("_first_begun", T.LongType())]
    grouped = ranged.repartition(*together).sortWithinPartitions(*together, "_place")
    maps = grouped.select(*together, start).mapInArrow(sum_up, T.StructType(fields))

    def compose(maps: pa.Table) -> pa.Table:
        """The anchor and chunk with which each range of a key begins."""
        maps = maps.sort_by("_range")
        anchor, chunk, begins = None, 0, []
        for bounds, anchors, begun, first, first_begun in zip(*[maps[f"_{c}"].to_pylist() for c in ("bounds", "anchors", "begun", "first", "first_begun")]):
            begins.append((anchor, chunk))
            if anchor is None:
                anchor, chunk = first, chunk + (first_begun or 0)
            elif (k := bisect_left(bounds, anchor + width)) < len(bounds):
                anchor, chunk = anchors[k], chunk + begun[k]
        return maps.select(together).append_column("_anchor", pa.array([b[0] for b in begins], maps.schema.field("_first").type)).append_column("_chunk", pa.array([b[1] for b in begins], pa.int64()))

    shape = T.StructType([*[ranged.schema[k] for k in together], T.StructField("_anchor", kind), T.StructField("_chunk", T.LongType())])
    begins = maps.groupBy(*keys).applyInArrow(compose, shape)
    both = ranged.join(begins, same(ranged, begins, together)).select(ranged["*"], *[begins[c] for c in STATE])
    walked = _walked(both.repartition(*together).sortWithinPartitions(*together, "_place"), together, start, width, both.schema)
    return walked.drop("_range", "_place", *STATE)


def _walked(rows: DataFrame, keys: list[str], start: str, width: float, schema: T.StructType) -> DataFrame:
    """Each task walks its sorted rows once and holds one batch; a key begins with the anchor and chunk in ``STATE``, if rows have it."""
    carried = set(STATE) <= set(schema.fieldNames())
    schema = T.StructType([*schema.fields, T.StructField("chunk", T.LongType()), T.StructField("chunk_start", schema[start].dataType)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk, anchor = None, 0, None
        for batch in batches:
            chunks, anchors = [], []
            begins = zip(*[batch[c].to_pylist() for c in STATE]) if carried else iter([(None, 0)] * batch.num_rows)
            for key, at, begin in zip(zip(*[batch[k].to_pylist() for k in keys]), batch[start].to_pylist(), begins):
                if key != last:
                    last, (anchor, chunk) = key, begin
                if anchor is None:
                    anchor = at
                elif at is not None and at >= anchor + width:
                    chunk, anchor = chunk + 1, at
                chunks.append(chunk)
                anchors.append(anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64()), pa.array(anchors, batch[start].type)], [*batch.schema.names, "chunk", "chunk_start"])

    return rows.mapInArrow(walk, schema)
