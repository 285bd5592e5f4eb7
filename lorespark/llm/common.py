"""Small helpers shared by the operators: tables in the shared folder, batches, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.shared import clear as clear
from lorespark.shared import drop as drop
from lorespark.shared import new_path as new_path
from lorespark.shared import shared_dir as shared_dir
from lorespark.shared import store as store


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Keep Arrow batches small, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def bounded_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``key``: the same rows on every run.

    Used only to fit classifiers and centroids; ``limit`` is each fit's documented bound.
    Counts by hash prefix come first, so that tasks return about ``limit`` rows in all,
    however many tasks there are, and not as many each.
    """
    keyed = df.withColumn("_sample_key", F.md5(F.coalesce(key.cast("string"), F.lit(""))))
    near = keyed.filter(F.substring("_sample_key", 1, 8) <= _prefix(keyed.select("_sample_key"), limit))
    return near.orderBy("_sample_key", key).limit(limit).drop("_sample_key")


def _prefix(keys: DataFrame, limit: int) -> str:
    """Eight digits of a hash up to which at least ``limit`` rows lie (all, if there are fewer) and few more; the driver sees at most 65,536 counts at once."""
    found = ""
    for at in (1, 5):
        digits = F.substring("_sample_key", at, 4).alias("digits")
        counts = keys.filter(F.col("_sample_key").startswith(found)).groupBy(digits).agg(F.count("*").alias("n")).collect()
        for row in sorted(counts):
            if row["n"] >= limit:
                break
            limit -= row["n"]
        else:
            return found + "f" * (8 - len(found))
        found += row["digits"]
        if row["n"] <= 2 * limit:
            break
    return found.ljust(8, "f")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod
