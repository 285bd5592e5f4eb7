"""Token ids as canonical, length-limited Huffman codes in independent blocks.

One pass encodes whole texts where they lie and counts the ids; the ids, a fraction
of the text's bytes, are then range-partitioned and sorted by document id and packed
into blocks of whole documents with at least ``block_tokens`` ids (a longer document
has a block of its own). The counts give code lengths of at most ``max_bits`` (more
only if there are more ids than such codes) by package-merge; codes are canonical, so
lengths alone restore them.

File format: a folder with three Parquet tables. ``codebook``: (symbol, bits), one
row for every id that occurs. ``blocks``: (shard, block, begin, doc_ids, doc_tokens,
every, bit_offsets, payload), files and rows in ascending order of document ids;
``begin`` is the number of ids in the shard's blocks before it, ``payload`` the bit
string, most significant bit first, and ``bit_offsets`` the place of every
``every``-th id, so decoders can start there. ``shards``: (shard, offset), the number
of ids in all shards before it. Blocks are rows, so Spark's own writer commits them
and lost tasks are run anew.

Defined results: null and empty texts are just the end id; null ids sort first;
rows with equal ids follow the hash of their ids; an empty table gives empty
tables. Columns other than the id and the text are not part of the format.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, small_batches, store

#: Fixed values of byte-level BPE: how it cuts a text (here for Latin letters only, on which all Unicode
#: versions agree), and the printable character that stands for each byte.
LATIN = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMERIC = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECE = re.compile(rf" ?[{LATIN}]+| ?[{NUMERIC}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LATIN}{NUMERIC}]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u201f\u2026]*")
PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: Most pieces whose ids a worker remembers, and the longest piece it does so for.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
_encoders: dict[str, Encoder] = {}


class Pieces(dict):
    """Ids of the pieces that byte-level BPE encodes one by one, asked of the library's model once for each distinct piece."""

    def __init__(self, tokenize: Callable[[str], list], width: np.dtype):
        spare = iter(range(256, 512))
        self.letters = {b: chr(b if b in PRINTABLE else next(spare)) for b in range(256)}
        self.tokenize, self.pack = tokenize, partial(array, "H" if width.itemsize == 2 else "I")

    def __missing__(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        spelled = piece.replace(" ", self.letters[32]) if plain else piece.encode().decode("latin-1").translate(self.letters)
        found = self.pack([t.id for t in self.tokenize(spelled)]).tobytes()
        if len(piece) <= REMEMBERED_CHARS and len(self) < REMEMBERED:
            self[piece] = found
        return found


class Encoder:
    """Encodes whole texts by the tokenizers library.

    A text of Latin letters is cut into the pieces that byte-level BPE encodes one by
    one, and the library's model is asked once for each distinct piece (of the first
    ``REMEMBERED``); every other text, and every other kind of tokenizer, goes to the
    library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        config = json.loads(self.tokenizer.to_str())
        cutter = config["pre_tokenizer"] or {}
        self.by_piece = config["model"]["type"] == "BPE" and config["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        self.special = [t["content"] for t in config["added_tokens"]]
        self.pieces = Pieces(self.tokenizer.model.tokenize, self.width)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_piece and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code with none over ``max_bits`` (or what ``n`` codes need), by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, is_leaf = np.empty(0), []
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        is_leaf.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        used = int(leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, codes): symbols by length, then value, and the code of each in that order."""
    order = np.lexsort((symbols, lengths))
    bits = lengths[order]
    top = int(bits[-1]) if len(bits) else 1
    steps = np.left_shift(1, top - bits)
    return order, (np.cumsum(steps) - steps) >> (top - bits)


class Codec:
    """Encodes and decodes id arrays with the code that ``symbols`` and ``lengths`` define."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, every: int):
        self.every, self.top = every, int(lengths.max(initial=1))
        order, codes = canonical_codes(symbols, lengths)
        self.code = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
        self.bits = np.zeros_like(self.code)
        self.code[symbols[order]], self.bits[symbols[order]] = codes, lengths[order]
        spans = np.left_shift(1, self.top - lengths[order])
        size = 1 << self.top
        self.symbol_at, self.bits_at = np.zeros(size, np.int64), np.ones(size, np.int64)
        self.symbol_at[: spans.sum()] = np.repeat(symbols[order], spans)
        self.bits_at[: spans.sum()] = np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bit string, place of every ``every``-th id); codes are added up in 64-bit words, of which each spans two at most."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        begins = ends - bits
        word, room = begins >> 6, 64 - (begins & 63) - bits
        code, over = self.code[ids].view(np.uint64), np.flatnonzero(room < 0)
        shift = np.maximum(room, 0).astype(np.uint64)
        part = code << shift
        part[over] = code[over] >> (-room[over]).astype(np.uint64)
        total = int(ends[-1])
        out = np.zeros((total >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(part, first)
        out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (total + 7) // 8], begins[:: self.every]

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All runs between checkpoints at once, one id of each run a step."""
        data = np.frombuffer(payload + bytes(4), np.uint8).astype(np.int64)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        place = np.array(offsets, np.int64)
        out = np.zeros((self.every, len(place)), np.int64)
        last, mask, shift = len(window) - 1, (1 << self.top) - 1, 32 - self.top
        for step in range(min(self.every, n)):
            key = (window[np.minimum(place >> 3, last)] >> (shift - (place & 7))) & mask
            out[step] = self.symbol_at[key]
            place += self.bits_at[key]
        out = out.T
        return out.reshape(-1)[:n]


ENCODED = "doc_id long, ids binary, counts binary"
BLOCKS = "shard int, block int, begin long, doc_ids array<long>, doc_tokens array<long>, every int, bit_offsets array<long>, payload binary"
LONGS = pa.list_(pa.int64())
BLOCK_TYPES = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("begin", pa.int64()), ("doc_ids", LONGS), ("doc_tokens", LONGS), ("every", pa.int32()), ("bit_offsets", LONGS), ("payload", pa.binary())])
SHARDS = "shard int, offset long"


def encode_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(doc_id, ids, counts): the ids of each document, and at a task's end one row with the counts of all its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder.of(tokenizer), ["doc_id", "ids", "counts"]
        end, total = np.array([end_id], encoder.width).tobytes(), np.zeros(0, np.int64)
        for batch in batches:
            ids = [encoder.encode(t) + end for t in batch["text"].to_numpy(zero_copy_only=False)]
            got = np.bincount(np.frombuffer(b"".join(ids), encoder.width))
            total, got = (total, got) if len(total) >= len(got) else (got, total)
            total[: len(got)] += got
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, ENCODED)


def counts_of(encoded: DataFrame) -> pd.DataFrame:
    """(symbol, n) of all ids: at most one row for each id of the vocabulary."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for counts in batch["counts"]:
                n = np.frombuffer(counts, "<i8")
                symbols = np.flatnonzero(n)
                yield pd.DataFrame({"symbol": symbols.astype(np.int32), "n": n[symbols]})

    found = encoded.filter("counts is not null").select("counts").mapInPandas(parts, "symbol int, n long")
    return found.groupBy("symbol").agg(F.sum("n").alias("n")).toPandas().sort_values("symbol")


def packed_blocks(encoded: DataFrame, width: str, symbols: np.ndarray, lengths: np.ndarray, *, every: int, block_tokens: int, shards: int) -> DataFrame:
    """``BLOCKS`` of the encoded documents, in ascending order of document ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard, size = Codec(symbols, lengths, every), TaskContext.get().partitionId(), np.dtype(width).itemsize
        held: list[tuple[int | None, bytes]] = []
        block = begin = tokens = 0

        def cut() -> pa.RecordBatch:
            payload, places = codec.encode(np.frombuffer(b"".join([h[1] for h in held]), width))
            row = (shard, block, begin, [h[0] for h in held], [len(h[1]) // size for h in held], every, places, payload)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES.types)], BLOCK_TYPES.names)

        for batch in batches:
            for key, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                held.append((key, ids))
                tokens += len(ids) // size
                if tokens >= block_tokens:
                    yield cut()
                    held, block, begin, tokens = [], block + 1, begin + tokens, 0
        if held:
            yield cut()

    order = [F.col("doc_id"), F.xxhash64("ids")]
    rows = encoded.filter("counts is null").select("doc_id", "ids")
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, max_bits: int = 16, every: int = 128, block_tokens: int = 1 << 16, shards: int | None = None, **options) -> None:
    """Write the format described above to the folder ``path``.

    The driver holds a count for each id of the vocabulary.
    """
    if every < 1 or block_tokens < 1:
        raise ValueError("every and block_tokens must be positive")
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = store(encode_documents(docs, tokenizer, **options), "tokens")
    counted = counts_of(encoded)
    symbols = counted["symbol"].to_numpy(np.int64)
    lengths = code_lengths(counted["n"].to_numpy(np.int64), max_bits)
    book = spark.createDataFrame(pd.DataFrame({"symbol": symbols.astype(np.int32), "bits": lengths.astype(np.int32)}), "symbol int, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    blocks = packed_blocks(encoded, Encoder.of(tokenizer).width.str, symbols, lengths, every=every, block_tokens=block_tokens, shards=shards)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    written = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = written.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).coalesce(1).write.parquet(f"{path}/shards")


def _codebook(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    book = spark.read.schema("symbol int, bits int").parquet(f"{path}/codebook").toPandas().sort_values("symbol")
    return book["symbol"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)


def _decoded(spark: SparkSession, path: str, name_of: str, kind: pa.DataType, column_of: Callable[[np.ndarray], object]) -> DataFrame:
    symbols, lengths = _codebook(spark, path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch[name][k] for name in ("doc_ids", "doc_tokens", "every", "bit_offsets", "payload", "begin", "offset")}
                every, sizes = row["every"].as_py(), row["doc_tokens"].values.to_numpy()
                if codec is None or codec.every != every:
                    codec = Codec(symbols, lengths, every)
                ends, start = np.cumsum(sizes), row["offset"].as_py() + row["begin"].as_py()
                ids = codec.decode(row["payload"].as_py(), row["bit_offsets"].values.to_numpy(), int(ends[-1]))
                found = [column_of(ids[e - n : e]) for n, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start + ends - sizes), pa.array(sizes), pa.array(found, kind)], ["doc_id", "start", "n_tokens", name_of])

    offsets = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(offsets), "shard").mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {name_of} {'long' if kind == pa.int64() else 'array<int>'}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder that :func:`write_tokens` has written: doc_id, start, n_tokens, ids."""
    return _decoded(spark, path, "ids", pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_tokens`, with the crc32 of the ids as little-endian unsigned 32-bit integers in their place."""
    return _decoded(spark, path, "ids_crc32", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def token_report(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` as tokens to the shared folder, read the files back, and return their digest."""
    path = new_path(docs.sparkSession, "tokenbin")
    write_tokens(docs, path, tokenizer, **options)
    return digest(docs.sparkSession, path)
