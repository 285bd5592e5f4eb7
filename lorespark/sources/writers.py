"""Writers of statistics, alerts, caches and notes; each appends or replaces whole partitions by Spark's own commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lorespark.functions import text
from lorespark.operators.rollups import first_rows


def write_stats(stats: DataFrame, path: str) -> None:
    """A line of JSON for each video, in a folder for each day; titles and channels are sanitized."""
    clean = {c: text.sanitize(F.col(c), 4000)["text"] for c in ("channel", "title", "playlist_title", "fallback_reason", "error") if c in stats.columns}
    stats.withColumns(clean).withColumn("stat_date", F.to_date("retrieved_at")).write.mode("append").partitionBy("stat_date").json(path)


def sanitize_alerts(rows: DataFrame, key: str, column: str, context: str) -> DataFrame:
    """Alerts for texts that lose five characters or more to cleaning; a fingerprint stands for the text."""
    safe = text.sanitize(F.col(column), 1 << 30)
    found = rows.select(key, F.lit(context).alias("context"), F.char_length(column).alias("before_len"), safe.alias("safe"), text.fingerprint(F.col(column)).alias("sample"))
    found = found.filter("safe.removed >= 5")
    return found.select(key, "context", "before_len", F.char_length("safe.text").alias("after_len"), F.col("safe.removed").alias("removed"), "sample")


def write_alerts(rows: DataFrame, path: str, key: str, column: str, context: str) -> None:
    """A line of JSON for each alert."""
    sanitize_alerts(rows, key, column, context).write.mode("append").json(path)


def _hadoop(spark: SparkSession, path: str):
    """(path, its file system) of the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _claimed(spark: SparkSession, path: str) -> int:
    """A snapshot number that no other writer has: files are created only if they are not there yet, and the next number is tried if one is."""
    folder, system = _hadoop(spark, f"{path}/_claims")
    system.mkdirs(folder)
    number = max([int(f.getPath().getName()) for f in system.listStatus(folder)], default=0) + 1
    while not system.createNewFile(_hadoop(spark, f"{path}/_claims/{number:08d}")[0]):
        number += 1
    return number


def read_cache(spark: SparkSession, path: str, schema: str | StructType, key: str = "key") -> DataFrame:
    """The entries of a cache, one a key: that of the first snapshot which has it. An absent cache is empty; a path that cannot be read is an error."""
    target, system = _hadoop(spark, path)
    empty = spark.createDataFrame([], schema)
    if not system.exists(target) or not any(f.getPath().getName().startswith("snapshot=") for f in system.listStatus(target)):
        return empty
    rows = spark.read.schema(StructType([*empty.schema.fields, StructField("snapshot", LongType())])).parquet(path)
    return first_rows(rows, [key], ["snapshot"]).select(empty.columns)


def write_cache(entries: DataFrame, path: str, order: str, key: str = "key") -> None:
    """Adds entries to a cache by content key; of equal keys the first by ``order``.

    Keys that the cache has already are left as they are, so a second run adds nothing. Each write is a snapshot: its files are
    written out of sight, then it takes the next free number and is moved to it, so any number of writers may run at
    once and none loses a key. A key that two of them add at the same time is in both snapshots; :func:`read_cache` has the first.
    """
    spark = entries.sparkSession
    new = first_rows(entries.filter(F.col(key).isNotNull()), [key], [order])
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    new.join(read_cache(spark, path, entries.schema, key).select(key), key, "left_anti").select(entries.columns).write.parquet(staged)
    source, system = _hadoop(spark, staged)
    if not system.rename(source, _hadoop(spark, f"{path}/snapshot={_claimed(spark, path):08d}")[0]):
        raise OSError(f"could not move {staged} into the cache")


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as rows of (folder, filename, unit, content), in a folder for each unit."""
    notes.select("folder", "filename", "unit", "content").write.mode("append").partitionBy("unit").parquet(path)


def rendered_sheet(rows: DataFrame, key: str = "path") -> DataFrame:
    """Sheets as text, one row a file: the reverse of reading them."""
    line = F.concat_ws("\t", "system_term", F.nullif(F.col("user_correction"), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_pos", line.alias("line")))), lambda s: s["line"])
    sections = rows.groupBy(key, "section_pos", "video_id", "title").agg(F.array_join(lines, "\n").alias("body"))
    block = F.concat(F.lit("## ["), "video_id", F.lit("] "), "title", F.lit("\n"), "body")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("section_pos", block.alias("block")))), lambda s: s["block"])
    return sections.groupBy(key).agg(F.concat(F.array_join(blocks, "\n\n"), F.lit("\n")).alias("content"))
