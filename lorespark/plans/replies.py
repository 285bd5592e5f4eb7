"""Queries over models' replies, made from the driver tables with the slips that models make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import replies
from lorespark.functions.python import json_object

from .registry import query, table


@query("""
SELECT event_id, CASE event_id % 5 WHEN 2 THEN 12 WHEN 1 THEN 12 ELSE event_id END AS start_sec, event_id + 30 AS end_sec,
       CASE event_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'tips' ELSE 'lecture' END AS label, left(event_type || ' seen', 4000) AS summary
FROM events WHERE event_id % 5 NOT IN (3, 4)""")
def reply_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose start is a number, a fraction, a string, a truth value or missing."""
    n = F.col("event_id") % 5
    start = F.when(n == 1, '"start_sec": 12.7,').when(n == 2, '"start_sec": "12.7",').when(n == 3, '"start_sec": true,').when(n == 4, "").otherwise(F.concat(F.lit('"start_sec": '), "event_id", F.lit(",")))
    label = F.when(F.col("event_id") % 3 == 0, " QA ").when(F.col("event_id") % 3 == 1, "Tips").otherwise("chat")
    raw = F.concat(F.lit('Sure: {"segments": [7, {'), start, F.lit('"end_sec": '), F.col("event_id") + 30, F.lit(', "label": "'), label, F.lit('", "summary": "'), "event_type", F.lit(' seen"}, null]} done'))
    rows = table(spark, sf_dir, "events").select("event_id", replies.segments(json_object(raw)).alias("found"))
    return rows.select("event_id", F.inline("found"))


@query("""
SELECT conv_id, turn AS idx, CASE WHEN turn = 0 THEN 'again' ELSE role END AS text FROM conversations WHERE conv_id % 7 <> 0""")
def reply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections in lists, objects and fences; index 0 comes twice, and every seventh batch holds one bad item."""
    item = F.concat(F.lit('{"idx": '), "turn", F.lit(', "text": "'), "role", F.lit('"}'))
    bad = F.when(F.col("conv_id") % 7 == 0, ', {"idx": "1", "text": "x"}').otherwise("")
    listed = table(spark, sf_dir, "conversations").withColumn("item", item).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    body = F.concat(F.lit("["), "items", F.lit(', {"idx": 0, "text": "again"}'), bad, F.lit("]"))
    whole = F.concat(F.lit('{"corrections": '), body, F.lit(', "terms": [" a ", 3, ""]}'))
    raw = F.when(F.col("conv_id") % 3 == 0, body).when(F.col("conv_id") % 3 == 1, whole).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    return listed.select("conv_id", F.explode(replies.corrections(raw)["corrections"]).alias("idx", "text"))


@query("""
SELECT s_suppkey, 't001' AS topic_id, s_name AS label, 3 - s_suppkey % 3 AS duplication_count,
       CASE s_suppkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'supporting' ELSE 'unique' END AS category, len(s_name) AS length, 1 AS excerpts FROM supplier""")
def reply_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without ids, counts and known categories, which follow from their place and their sources."""
    sources = F.array_join(F.slice(F.array(F.lit('"a"'), F.lit('"b"'), F.lit('"c"')), 1, 3 - (F.col("s_suppkey") % 3).cast("int")), ",")
    raw = F.concat(F.lit('{"topics": [{"label": "'), "s_name", F.lit('", "category": "Other", "source_videos": ['), sources, F.lit('], "excerpts": [3, {"quote": "q"}]}]}'))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(replies.topics(raw)))
    return rows.select("s_suppkey", "topic_id", "label", "duplication_count", "category", F.char_length("label").cast("long").alias("length"), F.size("excerpts").alias("excerpts"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END AS index, p_name AS label, 0 AS start_sec, p_size AS end_sec, 'q1,q2' AS ids FROM part""")
def reply_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"steps": [{"index": '), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("null"), F.lit(', "label": "'), "p_name", F.lit('", "start_sec": 0, "end_sec": "'), "p_size", F.lit('", "insight_ids": ["q1", "", null, "q2"]}]}'))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.inline(replies.steps(raw)))
    return rows.select("p_partkey", "index", "label", "start_sec", "end_sec", F.array_join("insight_ids", ",").alias("ids"))


@query("""
SELECT o_orderkey, o_orderkey % 3 = 0 AS needs_revision, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE o_orderpriority END AS summary FROM orders""")
def reply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that ask for revision with fixes, without them, or cannot be read (which asks for none)."""
    needs = (F.col("o_orderkey") % 3 == 0).cast("string")
    good = F.concat(F.lit('{"needs_revision": '), needs, F.lit(', "summary": "'), "o_orderpriority", F.lit('", "fixes": [{"target": "moc"}]}'))
    no_fix = F.concat(F.lit('{"needs_revision": true, "summary": "'), "o_orderpriority", F.lit('", "fixes": ["x"]}'))
    raw = F.when((F.col("o_orderkey") % 4 == 3) & (F.col("o_orderkey") % 3 != 0), "no json").when((F.col("o_orderkey") % 4 == 3), F.concat(F.lit('{"needs_revision": true, "fixes": [{"target": "a"}]}'))).when(F.col("o_orderkey") % 3 != 0, no_fix).otherwise(good)
    return table(spark, sf_dir, "orders").select("o_orderkey", replies.review(raw).alias("r")).select("o_orderkey", "r.needs_revision", "r.summary")
