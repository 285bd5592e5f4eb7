"""Passages that repeat across documents: winnowed anchors, extended both ways to windows.

A window is ``length`` consecutive words. Of the ``gram``-word hashes inside a window the smallest (the
first of equals) is its anchor: winnowing, which picks about 2 of ``length - gram + 2`` places and picks
the same place in every copy of a window. So each window has exactly one anchor, copies of it meet at
that anchor, and the windows of a document that share an anchor occurrence are consecutive; all of them
together are that occurrence's context.

Documents join on anchors. An anchor's occurrences are told apart by their whole context; of those
with the same context, all but the ones in the document with the smallest id repeat in every window, and
nothing of them needs to be looked at. Only that first document of each different context is
extended, word by word to the left and to the right of the anchor, which gives its windows; those meet by
their hashes. The work is in proportion to occurrences: no pairs are formed, however many documents
share an anchor, and hot contexts and windows are counted in the tasks before they are shuffled. A window
repeats if a document with a smaller id holds it. Consecutive repeating windows are one maximal repeat.

Anchors, contexts and windows are 64-bit hashes and always compared two at a time, anchor and context or
anchor and window.

Defined results: words are runs of characters other than ASCII white space, unchanged; null, blank and
short texts have no window and keep all their words; rows with a null id take no part (they neither
repeat nor are repeated) and keep all theirs; rows with equal ids do not remove each other's words; rows
that repeat an id and a text get the same result; a window that occurs twice in one document only is no
repeat; an empty table gives an empty result. Other columns are ignored by :func:`repeats` and
:func:`repeat_report` and carried by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small_batches, store
from .words import GOLDEN, WordHashes, mix

LENGTH, GRAM = 50, 25
#: Most anchor occurrences whose contexts are hashed at once.
AT_ONCE = 10_000


class _Known(WordHashes):
    """Hashes of words given as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


KNOWN = _Known()


def split(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; ``bytes.split`` knows ASCII white space only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values, put together from runs of powers of two."""
    done, out, power = 0, None, h
    for k in range(size.bit_length()):
        if size >> k & 1:
            part = power[done : len(h) - size + done + 1] if len(h) >= size else power[:0]
            out = mix(part + np.uint64(k + 1)) if out is None else mix(out * GOLDEN + part)
            done += 1 << k
        if len(power) > 1 << k:
            power = mix(power[: -(1 << k)] * GOLDEN + power[1 << k :] + np.uint64(k))
        else:
            power = power[:0]
    return out


class Anchors:
    """The anchor occurrences of a document: hash, context, and the first and last window of each."""

    def __init__(self, h: np.ndarray, length: int, gram: int):
        count = max(len(h) - length + 1, 0)
        if not count:
            self.anchor = self.context = np.zeros(0, np.uint64)
            self.first = self.last = np.zeros(0, np.int64)
            return
        grams = runs(h, gram)
        place = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(axis=1) + np.arange(count)
        self.first = np.flatnonzero(np.diff(place, prepend=-1))
        self.last = np.append(self.first[1:], count) - 1
        place = place[self.first]
        self.anchor = grams[place]
        parts = [self._context(h, *(x[k : k + AT_ONCE] for x in (place, self.first, self.last)), length) for k in range(0, len(place), AT_ONCE)]
        self.context = np.concatenate(parts)

    @staticmethod
    def _context(h: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
        sizes = last - first + length
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        values = mix(h[inside + np.repeat(first, sizes)] + inside.astype(np.uint64) * GOLDEN)
        shape = (place - first).astype(np.uint64) << np.uint64(32) | sizes.astype(np.uint64)
        return mix(np.add.reduceat(values, starts) + mix(shape))


def _signed(source: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, hash, n_words, kept, anchors) of each row; ``kept`` is the digest of all its words."""
    kind = pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, found = [], [], []
            for text in batch["text"].to_pylist():
                words = split(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(Anchors(hashes(words), length, gram))
            flat = [np.concatenate([getattr(a, f.name) for a in found]) if found else np.zeros(0) for f in kind]
            rows = pa.StructArray.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int32), f.type) for x, f in zip(flat, kind)], fields=list(kind))
            ends = np.cumsum([0] + [len(a.first) for a in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, rows)], ["doc_id", "hash", "n_words", "kept", "anchors"])

    return source.mapInArrow(sign, "doc_id long, hash long, n_words long, kept string, anchors array<struct<anchor:long,context:long,first:int,last:int>>")


def _extended(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, hash, anchor, window, start): the windows of the ``wanted`` occurrences of each text."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch["text"].to_pylist()):
                h = hashes(split(text))
                found = Anchors(h, length, gram)
                if not len(found.first):
                    continue
                want = batch["wanted"][k].values
                want = mix(want.field("anchor").to_numpy().view(np.uint64)) + want.field("context").to_numpy().view(np.uint64)
                chosen = np.flatnonzero(np.isin(mix(found.anchor) + found.context, want))
                sizes = found.last[chosen] - found.first[chosen] + 1
                start = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(found.first[chosen], sizes)
                ids = [pa.array(np.full(len(start), batch[c][k].as_py(), np.int64)) for c in ("doc_id", "hash")]
                anchor, window = np.repeat(found.anchor[chosen], sizes), runs(h, length)[start]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.view(np.int64)) for x in (anchor, window)), pa.array(start.astype(np.int32))], ["doc_id", "hash", "anchor", "window", "start"])

    return texts.select("doc_id", "hash", "text", "wanted").mapInArrow(extend, "doc_id long, hash long, anchor long, window long, start int")


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text"))


def _repeating(source: DataFrame, signed: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, hash, windows): for each text with repeats the ranges (first, last) of its repeating windows, in no order."""
    spread = signed.filter("doc_id is not null").select("doc_id", "hash", F.inline("anchors"))
    contexts = store(spread.groupBy("anchor", "context").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("latest")), "contexts")
    anchors = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("owner").alias("least"), F.max("latest").alias("most"))
    anchors = store(anchors.filter("least <> most").select("anchor", "n"), "anchors")
    shared = store(contexts.join(anchors, "anchor"), "shared")
    drop(contexts, anchors)
    # Later documents repeat their first one's context whole.
    whole = spread.join(shared.filter("owner <> latest").select("anchor", "context", "owner"), ["anchor", "context"])
    whole = whole.filter("owner < doc_id").select("doc_id", "hash", "first", "last")
    # First documents of contexts that differ around an anchor.
    wanted = shared.filter("n > 1").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "context")).alias("wanted"))
    windows = store(_extended(source.join(wanted, "doc_id"), length, gram), "windows")
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("latest"))
    first = store(first.filter("owner <> latest").select("anchor", "window", "owner"), "first")
    part = windows.join(first, ["anchor", "window"]).filter("owner < doc_id").select("doc_id", "hash", F.col("start").alias("first"), F.col("start").alias("last"))
    found = store(whole.unionByName(part).groupBy("doc_id", "hash").agg(F.collect_list(F.struct("first", "last")).alias("windows")), "repeating")
    drop(shared, windows, first)
    return found


def _runs_of(windows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of runs of consecutive windows, from their ranges in any order."""
    first, last = (windows.values.field(f).to_numpy() for f in ("first", "last"))
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, first[1:] > reach[:-1] + 1)
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)] + 1


def _kept(words: list[bytes], windows: pa.StructScalar, length: int) -> list[bytes]:
    start, end = _runs_of(windows)
    change = np.bincount(start, minlength=len(words) + 1) - np.bincount(end - 1 + length, minlength=len(words) + 1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[: len(words)]) == 0).tolist()]


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end): the maximal repeats of each text, from word ``start`` up to before word ``end``."""
    small_batches(docs.sparkSession)
    source = _source(docs, doc_id, text)
    signed = store(_signed(source, length, gram), "signed")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, end = _runs_of(batch["windows"][k])
                ids = np.full(len(start), batch["doc_id"][k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, start, end - 1 + length)], ["doc_id", "start", "end"])

    return _repeating(source, signed, length, gram).mapInArrow(merge, "doc_id long, start long, end long")


def _cut(source: DataFrame, found: DataFrame, length: int, value: Callable[[list[bytes]], str]) -> DataFrame:
    """(doc_id, hash, n_removed, value) of the texts with repeats; ``value`` is made of the words that stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, values = [], []
            for k, t in enumerate(batch["text"].to_pylist()):
                words = split(t)
                left = _kept(words, batch["windows"][k], length)
                removed.append(len(words) - len(left))
                values.append(value(left))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], pa.array(removed, pa.int64()), pa.array(values, pa.string())], ["doc_id", "hash", "n_removed", "value"])

    both = source.join(found, ["doc_id", "hash"]).select("doc_id", "hash", "text", "windows")
    return both.mapInArrow(cut, "doc_id long, hash long, n_removed long, value string").dropDuplicates(["doc_id", "hash"])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs``, where texts with repeats are their remaining words, joined by one space; other texts are unchanged."""
    small_batches(docs.sparkSession)
    source = _source(docs, doc_id, text)
    found = _repeating(source, store(_signed(source, length, gram), "signed"), length, gram)
    new = _cut(source, found, length, lambda words: b" ".join(words).decode("utf-8", "surrogatepass"))
    new = store(new.select(F.col("doc_id").alias("_cut_id"), F.col("hash").alias("_cut_hash"), F.col("value").alias("_cut_text")), "cut")
    same = (F.col(doc_id).cast("long") == F.col("_cut_id")) & (F.xxhash64(text) == F.col("_cut_hash"))
    out = docs.join(new, same, "left")
    return out.withColumn(text, F.coalesce("_cut_text", text)).select(*docs.columns)


def repeat_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    source = _source(docs, doc_id, text)
    signed = store(_signed(source, length, gram), "signed")
    cut = _cut(source, _repeating(source, signed, length, gram), length, lambda words: hashlib.sha256(b" ".join(words)).hexdigest())
    out = signed.drop("anchors").join(cut, ["doc_id", "hash"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("value", "kept").alias("kept_sha256"))
