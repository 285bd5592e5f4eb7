"""Importance resampling of documents toward a target distribution, in DataFrame functions only.

Runs of one to ``n`` words are features, and a feature falls into one of ``buckets`` buckets by the
crc32 of its bytes. Feature arrays are exploded and counted by bucket, once over all documents and
once over all target texts; both are tables of at most ``buckets`` rows, whatever the corpus. A
bucket's gain is the log-ratio of its smoothed shares. The gain table is broadcast (it is that
small), joined to the exploded features again and summed by document; Gumbel noise, drawn from the
document's id, makes the highest scores a sample without replacement in proportion to the weights.

Ranks need no global window: rows are range-partitioned and sorted by score, a row's place in its
partition comes from ``monotonically_increasing_id`` of the sorted rows, and the number of rows in
the partitions before it is added (one row a partition is broadcast for that).

A document's exploded rows lie in one task, so sums are formed there before the shuffle, which moves
one row a document. Rows that repeat an id and a text are summed as one group and divided again.

Defined results: null and empty texts, and texts without a word, have no features and weight 0; a
null id is drawn like the empty id and sorts last; repeated rows each get a row (and a rank) of
their own; without target texts all counts ``t`` are 0; an empty table gives an empty result. Other
columns are ignored by :func:`scores` and :func:`ranks`, carried by :func:`resample`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store

#: Words: letters a-z, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, "2024"


def words_of(text: Column) -> Column:
    """The words of a text, with A to Z in lower case; none for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def grams_of(words: Column, n: int) -> Column:
    """All runs of one to ``n`` words, joined by one space."""

    def runs(k: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) >= k, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *map(runs, range(2, n + 1))) if n > 1 else words


def bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """(bucket, n): at most one row for each bucket."""
    words = texts.select(words_of(F.col(text)).alias("words"))  # a column of its own, as its runs refer to it again and again
    grams = words.select(F.explode(grams_of(F.col("words"), n)).alias("gram"))
    return grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), one row for each bucket: the smoothed log-ratio of target to documents, in thousandths."""
    s = bucket_counts(docs, text, n, buckets).select("bucket", F.col("n").alias("s"))
    t = bucket_counts(target, target_text, n, buckets).select("bucket", F.col("n").alias("t"))
    both = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    own = {c: F.col(c).cast("double") for c in "st"}
    every = {c: F.sum(c).over(W.partitionBy()).cast("double") for c in "st"}  # over ``buckets`` rows
    ratio = (own["t"] + 1) * (every["s"] + buckets) / ((own["s"] + 1) * (every["t"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, the same for an id on every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, hash, n_words, n_features, weight, score), one row for each row of ``docs``; ``hash`` is that of the text."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gains = store(gain_table(source, target, target_text=target_text, n=n, buckets=buckets).coalesce(1), "gains")
    cut = source.select("doc_id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("words"))
    cut = cut.select("doc_id", "hash", F.size("words").cast("long").alias("n_words"), grams_of(F.col("words"), n).alias("grams"))
    keys = ["doc_id", "hash", "n_words", "n_features"]
    long = cut.withColumn("n_features", F.size("grams").cast("long")).select(*keys, F.explode_outer("grams").alias("gram"))
    long = long.select(*keys, bucket(F.col("gram"), buckets).alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = long.groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"), F.count("*").alias("rows"))
    copies = F.expr("rows div greatest(n_features, 1)")
    weight = F.expr("sum div (rows div greatest(n_features, 1))")
    weighed = summed.select(*keys, weight.alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    return weighed.drop("copy").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranks(scored: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the ``percent`` % with the highest scores of all documents of ``least_words`` words or more, null for all others."""
    spark = scored.sparkSession
    scored = store(scored, "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("hash")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # An id counts from the first row of its task, whose number stands in its upper bits.
    placed = able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = store(placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_place")).drop("_id"), "places")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    drawn = percent * placed.count() // 100
    rank = F.col("_before") + F.col("_place") + 1
    ranked = placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= drawn, rank)).select(*scored.columns, "rank")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn; of equal rows all, if one of them is."""
    found = ranks(scores(docs, target, doc_id=doc_id, text=text, **options), percent=percent, least_words=least_words).filter("rank is not null")
    drawn = store(found.select(F.col("doc_id").alias("_drawn_id"), F.col("hash").alias("_drawn_hash")).distinct(), "drawn")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_drawn_id")) & (F.xxhash64(text) == F.col("_drawn_hash"))
    return docs.join(drawn, same, "left_semi")


def resample_report(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    return ranks(scores(docs, target, **options), percent=percent, least_words=least_words).select("doc_id", "n_features", "weight", "score", "rank")
