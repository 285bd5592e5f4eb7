"""Alignment of two tokenizers' ids over the same bytes.

Tokenizer A is byte-level BPE (``tokenizers``), tokenizer B a piece model (``sentencepiece``), which puts a
space before each text; A reads the text with that space. The tokens of a whole Arrow batch are laid
end to end, document after document, so that a token's end is a running sum of byte lengths. Ends of A and of
B are counted once for the batch; where both have one, texts are cut into groups, and tokens whose ends lie on a
cut are linked. Running sums over the batch, read at the documents' bounds, give the figures of each
document; nothing loops over tokens.

Each document keeps its different links and how often it has them. Summed over the corpus they are the table of
id pairs with their counts, at most one row for each pair that occurs; the highest count of each id of B follows from it.
Documents meet the table again to be scored. It is broadcast if it has at most ``BROADCAST`` pairs,
which is counted first, and joined by shuffle otherwise; rows are the same either way.

B's words are encoded once and remembered, as no piece of such a model goes on over the start of a word; a
model with such a piece, and texts of other letters, go to the library as they are.

Defined results: texts that are null or empty, or whose joined tokens of A or of B are other bytes than the text with
its space, have no tokens (figures 0, digest empty); strings of special tokens are plain text; rows that repeat an
id, and rows with a null id, each count and each get their row; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store
from .tokenbin import PLAIN, PRINTABLE, REMEMBERED, REMEMBERED_CHARS, Encoder

#: Most id pairs that are broadcast (about 50 MB in each executor).
BROADCAST = 1 << 20
#: A word of B: the blanks before it, and what follows up to the next.
CHUNK = re.compile(" +[^ ]*")
#: Fixed values of piece models: the character that stands for a blank, and names of single bytes.
BLANK, BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
_loaded: dict[tuple[type, str], object] = {}


class ByteEncoder(Encoder):
    """A: byte-level BPE; special tokens have no meaning in texts."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens, self.special = True, []
        spare = iter(range(256, 512))
        byte_of = {chr(b if b in PRINTABLE else next(spare)): b for b in range(256)}
        names = {k: v for v, k in self.tokenizer.get_vocab().items()}
        self.by_piece = self.by_piece and byte_of.keys() <= set(names.values())
        self.bytes = [bytes(map(byte_of.__getitem__, t)) if set(t := names.get(k, "")) <= byte_of.keys() else t.encode() for k in range(max(names) + 1)]

    def ids(self, text: str) -> np.ndarray | None:
        """The ids of a text with a space before it; none if they do not spell it."""
        text = " " + text
        found = np.frombuffer(self.encode(text), self.width)
        exact = self.by_piece or b"".join(map(self.bytes.__getitem__, found.tolist())) == text.encode()
        return found if exact else None


class Unspelled(Exception):
    """Pieces do not spell the word that they encode."""


class Words(dict):
    """Ids of words with the blanks before them."""

    def __init__(self, model: PieceEncoder):
        self.model, self.pack = model, partial(array, "H" if model.width.itemsize == 2 else "I")

    def __missing__(self, word: str) -> bytes:
        ids = self.model.library.encode(word[1:])  # the library puts the first blank there
        if b"".join(map(self.model.bytes.__getitem__, ids)) != word.encode():
            raise Unspelled
        found = self.pack(ids).tobytes()
        if len(word) <= REMEMBERED_CHARS and len(self) < REMEMBERED:
            self[word] = found
        return found


class PieceEncoder:
    """B: a piece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.bytes = [bytes.fromhex(m.group(1)) if (m := BYTE.fullmatch(n)) else n.replace(BLANK, " ").encode() for n in names]
        self.by_word = not any(BLANK in n.lstrip(BLANK) for n in names)
        self.width = np.dtype("<u2") if len(names) <= 1 << 16 else np.dtype("<u4")
        self.words = Words(self)

    def ids(self, text: str) -> np.ndarray | None:
        if self.by_word and PLAIN.fullmatch(text):
            try:
                return np.frombuffer(b"".join(map(self.words.__getitem__, CHUNK.findall(" " + text))), self.width)
            except Unspelled:
                pass
        ids = self.library.encode(text)
        return np.array(ids, self.width) if b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode() else None


def loaded(kind: type, path: str):
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def _sums(counts: np.ndarray) -> np.ndarray:
    """Running sums that begin with 0: the sum of [i, j) is at j less that at i."""
    return np.append(0, np.cumsum(counts))


@dataclass
class Batch:
    """The tokens of some texts: ids, byte length of every id, and how many tokens each text has, for A and B."""

    a: np.ndarray
    b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], path_a: str, path_b: str) -> Batch:
        coders = loaded(ByteEncoder, path_a), loaded(PieceEncoder, path_b)
        pairs = [tuple(c.ids(t) for c in coders) if t else (None, None) for t in texts]
        pairs = [(x, y) if x is not None and y is not None else (np.zeros(0, np.int64),) * 2 for x, y in pairs]
        ids = [np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64) for column in (zip(*pairs) if pairs else ((), ()))]
        sizes = [np.array([len(x) for x in c.bytes], np.int64) for c in coders]
        return cls(*ids, *sizes, *(np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1)))

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.size_a[self.a]), np.cumsum(self.size_b[self.b])

    @cached_property
    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens end at each byte."""
        top = int(self.ends[0][-1]) + 1 if len(self.a) else 1
        return np.bincount(self.ends[0], minlength=top), np.bincount(self.ends[1], minlength=top)

    @cached_property
    def cut(self) -> np.ndarray:
        return (self.counts[0] > 0) & (self.counts[1] > 0)

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token, numbered through the batch."""
        before = np.cumsum(self.cut) - self.cut
        return before[self.ends[0]], before[self.ends[1]]

    def per_text(self, at_cuts: np.ndarray | None = None) -> np.ndarray:
        """For each text the sum of what lies at its cuts; without ``at_cuts``, the number of them."""
        reach = np.append(0, self.ends[0])[_sums(self.n_a)]  # the byte where each text ends
        values = np.zeros(len(self.cut), np.int64)
        values[self.cut] = 1 if at_cuts is None else at_cuts
        values[0] = 0
        return np.diff(np.cumsum(values)[reach])

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, number at each cut): every token of A that ends at a cut with every token of B that does."""
        (ca, cb), spots = self.counts, np.flatnonzero(self.cut)
        many = (ca * cb)[spots]
        if len(many) and many.max() == 1:
            return self.a[self.cut[self.ends[0]]], self.b[self.cut[self.ends[1]]], many
        at = np.repeat(np.arange(len(spots)), many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        wide = cb[spots][at]
        first_a, first_b = (np.searchsorted(e, spots) for e in self.ends)
        return self.a[first_a[at] + nth // np.maximum(wide, 1)], self.b[first_b[at] + nth % np.maximum(wide, 1)], many

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different pairs of each text, how often it has them, end of each text's): a pair is a * (ids of B) + b."""
        a, b, many = self.links
        text = np.repeat(np.arange(len(self.n_a)), self.per_text(many))
        span = len(self.size_a) * len(self.size_b)
        found, n = np.unique(text * span + a * len(self.size_b) + b, return_counts=True)
        return found % span, n, np.searchsorted(found, np.arange(1, len(self.n_a) + 1) * span)

    def digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each text; empty without tokens."""
        if not len(self.a):
            return [""] * len(self.n_a)
        ga, gb = self.groups
        place_a = np.arange(len(ga)) + _sums(np.bincount(gb))[ga]
        place_b = np.arange(len(gb)) + _sums(np.bincount(ga))[gb + 1]
        ids, mark = np.zeros(len(ga) + len(gb), np.int64), np.full(len(ga) + len(gb), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[np.append(np.flatnonzero(np.diff(ga)), len(ga) - 1)]] = ord("|")
        mark[place_b[np.append(np.flatnonzero(np.diff(gb)), len(gb) - 1)]] = ord(";")
        table, digits = _decimals(max(len(self.size_a), len(self.size_b)))
        n = digits[ids]
        spelled = table[ids]
        spelled[np.arange(len(ids)), n] = mark
        flat = spelled[np.arange(table.shape[1]) <= n[:, None]].tobytes()
        bounds = _sums(n + 1)[_sums(self.n_a + self.n_b)].tolist()
        return [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds, bounds[1:])]


def _decimals(top: int, _made: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Digits of the numbers below ``top``, one row each with room for a mark, and how many they are."""
    if top not in _made:
        width = len(str(top))
        _made[top] = np.array([list(str(k).encode().ljust(width + 1)) for k in range(top)], np.uint8), np.array([len(str(k)) for k in range(top)])
    return _made[top]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,n:int>>"
GROUPS = "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>"
PAIR = pa.struct([("pair", pa.int64()), ("n", pa.int32())])


def groups(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, a_ends, b_ends): the ids of each text, and how many of them lie in its groups up to and with each."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = Batch.of(rows["text"].to_pylist(), path_a, path_b)
            columns = []
            for ids, n, group in zip((found.a, found.b), (found.n_a, found.n_b), found.groups):
                columns.append(pa.ListArray.from_arrays(_sums(n).astype(np.int32), ids.astype(np.int32)))
                last = np.flatnonzero(np.diff(group, append=-1)) + 1
                begins = _sums(n)[:-1]
                inside = np.searchsorted(begins, last - 1, side="right") - 1
                columns.append(pa.ListArray.from_arrays(_sums(found.per_text()).astype(np.int32), (last - begins[inside]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows["doc_id"], columns[0], columns[2], columns[1], columns[3]], ["doc_id", "a", "b", "a_ends", "b_ends"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, GROUPS)


def _aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """``ALIGNED``, one row for each row of ``docs``; ``row`` tells rows of the stored result apart."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = Batch.of(rows["text"].to_pylist(), path_a, path_b)
            pair, n, ends = found.pairs()
            pairs = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.StructArray.from_arrays([pa.array(pair), pa.array(n.astype(np.int32))], fields=list(PAIR)))
            figures = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.per_text(), found.per_text(found.links[2]))]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
            yield pa.RecordBatch.from_arrays([rows["row"], rows["doc_id"], *figures, pa.array(found.digests(), pa.string()), pairs], names)

    small_batches(docs.sparkSession)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return store(source.mapInArrow(align, ALIGNED), "aligned")


def _pair_table(aligned: DataFrame) -> DataFrame:
    """(pair, count): one row for each pair of ids that is linked anywhere."""
    return aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("count"))


def _best(counted: DataFrame, ids_b: int) -> DataFrame:
    """``counted`` with ``best``: whether no pair of the same id of B has a higher count."""
    own = counted.withColumn("b_id", F.col("pair") % ids_b)
    top = own.groupBy("b_id").agg(F.max("count").alias("top"))  # at most one row for each id of B
    return own.join(F.broadcast(top), "b_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _ids_b(path_b: str) -> int:
    return len(loaded(PieceEncoder, path_b).bytes)


def id_pairs(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, count, best): which ids of the tokenizers end together, how often, and whether it is the id of B's most frequent link."""
    table = _best(store(_pair_table(_aligned(docs, path_a, path_b, doc_id, text)), "pairs"), ids := _ids_b(path_b))
    return table.select(F.expr(f"pair div {ids}").cast("int").alias("a_id"), (F.col("pair") % ids).cast("int").alias("b_id"), "count", "best")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each row of ``docs``."""
    aligned = _aligned(docs, path_a, path_b, doc_id, text)
    table = store(_best(store(_pair_table(aligned), "pairs"), _ids_b(path_b)), "table")
    own = F.broadcast(table) if table.count() <= broadcast else table
    linked = aligned.select("row", F.inline("pairs")).join(own, "pair")
    scored = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = aligned.drop("pairs").join(scored, "row", "left")
    figures = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *figures, "groups_sha256")
