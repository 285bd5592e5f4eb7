"""Queries over timelines: events of users and turns of conversations stand in for captions of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import sequences as seq

from .registry import query, table

DAY = 86_400_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us``, microseconds since 1970."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


CHUNKS = """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, value, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT user_id, n, us, us AS anchor, CAST(0 AS BIGINT) AS chunk FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.us, CASE WHEN e.us >= w.anchor + 86400000000 THEN e.us ELSE w.anchor END,
         w.chunk + CASE WHEN e.us >= w.anchor + 86400000000 THEN 1 ELSE 0 END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "us", "ts")
    return seq.anchor_chunks(rows, ["user_id"], ["ts", "event_id"], "us", DAY)


@query(CHUNKS + """
SELECT user_id, count(DISTINCT chunk) AS chunks, count(*) AS events, max(us - anchor) AS longest_us
FROM walk GROUP BY user_id""")
def caption_chunk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a day's length that start anew at an event: their number and longest extent by user."""
    chunks = _chunked(spark, sf_dir)
    return chunks.groupBy("user_id").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("events"), F.max(F.col("us") - F.col("chunk_start")).alias("longest_us")).orderBy("user_id")


@query(CHUNKS + """
, starts AS (SELECT user_id, chunk, min(anchor) AS start_us, max(us) AS last_us FROM walk GROUP BY ALL),
ends AS (SELECT *, max(last_us) OVER (PARTITION BY user_id) AS end_us FROM starts)
SELECT user_id, chunk, start_us,
       CAST(greatest(coalesce(lead(start_us) OVER (PARTITION BY user_id ORDER BY chunk), end_us) - start_us, 0) AS BIGINT) AS duration
FROM ends""")
def chunk_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each chunk lasts: to the start of the next, the last one to the user's last event."""
    ends = _chunked(spark, sf_dir).groupBy("user_id", "chunk").agg(F.first("chunk_start").alias("start_us"), F.max("us").alias("_last"))
    last = ends.groupBy("user_id").agg(F.max("_last").alias("end_us"))
    return seq.lead_durations(ends.join(last, "user_id"), ["user_id"], ["chunk"], "start_us", "end_us").select("user_id", "chunk", "start_us", "duration")


@query("""
WITH RECURSIVE walk AS (
  SELECT conv_id, turn, text, turn * 15 AS start, turn * 15 AS anchor, CAST(0 AS BIGINT) AS chunk
  FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id)
  UNION ALL
  SELECT c.conv_id, c.turn, c.text, c.turn * 15, CASE WHEN c.turn * 15 >= w.anchor + 30 THEN c.turn * 15 ELSE w.anchor END,
         w.chunk + CASE WHEN c.turn * 15 >= w.anchor + 30 THEN 1 ELSE 0 END
  FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
SELECT conv_id, chunk, CAST(min(start) AS BIGINT) AS start_sec, printf('%02d:%02d', CAST(min(start) // 60 AS INT), CAST(min(start) % 60 AS INT)) AS label,
       trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\\s+', ' ', 'g')) AS text
FROM walk GROUP BY conv_id, chunk""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, one every 15 seconds, as chunks of 30 seconds with their text."""
    from lorespark.functions.times import mmss

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 15).alias("start_sec"))
    chunks = seq.anchor_chunks(turns, ["conv_id"], ["turn"], "start_sec", 30)
    out = chunks.groupBy("conv_id", "chunk").agg(F.min("start_sec").alias("start_sec"), seq.joined_text("text", ["turn"]).alias("text"))
    return out.withColumn("label", mmss(F.col("start_sec")))


SPANS = "SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day, (epoch_us(ts) // 86400000000) * 86400000000 + (user_id % 7) * 3600000000 AS start_us, (epoch_us(ts) // 86400000000) * 86400000000 + (user_id % 7 + 12) * 3600000000 AS end_us FROM events"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("us") / DAY)
    hour = F.lit(3_600_000_000)
    return events(spark, sf_dir).select("user_id", day.alias("day"), (day * DAY + F.col("user_id") % 7 * hour).alias("start_us"), (day * DAY + (F.col("user_id") % 7 + 12) * hour).alias("end_us")).distinct()


@query(f"""
SELECT s.user_id, s.day, count(*) AS events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY epoch_us(ts), event_id) AS ids
FROM ({SPANS}) s JOIN events e ON e.user_id = s.user_id AND epoch_us(e.ts) >= s.start_us AND epoch_us(e.ts) < s.end_us
GROUP BY s.user_id, s.day""")
def range_join_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that lie in spans of half a day, by user."""
    points = events(spark, sf_dir).select("user_id", "event_id", "us")
    joined = seq.range_join(points, _spans(spark, sf_dir), ["user_id"], "us", "start_us", "end_us", DAY)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id"))), lambda s: s["event_id"].cast("string"))
    return joined.groupBy("user_id", "day").agg(F.count("*").alias("events"), F.array_join(ids, ",").alias("ids"))


@query("""
WITH b AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
p AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
r AS (SELECT b.event_id, b.us, p.t, row_number() OVER (PARTITION BY b.event_id ORDER BY abs(p.t - b.us), p.t) AS n
      FROM b LEFT JOIN p ON p.user_id = b.user_id)
SELECT event_id, us, CASE WHEN abs(t - us) <= 7200000000 THEN t ELSE us END AS snapped FROM r WHERE n = 1""")
def nearest_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signup moved to the user's nearest view within two hours, the earlier of two as near."""
    e = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    views = e.filter("event_type = 'view'").select("user_id", F.col("us").alias("t"))
    return seq.nearest(e.filter("event_type = 'signup'"), views, ["user_id"], "us", "t", 7_200_000_000).select("event_id", "us", "snapped")


@query("""
SELECT conv_id, turn, printf('%s%03d', CASE role WHEN 'user' THEN 'q' ELSE 'p' END,
       row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)) AS label_id
FROM conversations WHERE role IN ('user', 'assistant')""")
def timeline_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return seq.label_ids(turns, ["conv_id"], ["turn"], "role", {"user": "q", "assistant": "p"}).select("conv_id", "turn", "label_id")


@query("""
WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT doc_id, CAST(i // 10 AS BIGINT) AS batch, CAST(i // CAST(ceil(c / 3.0) AS BIGINT) AS BIGINT) AS shard FROM n""")
def batches_and_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return seq.shards(seq.batches(docs, ["source"], ["doc_id"], 10), ["source"], ["doc_id"], 3).select("doc_id", "batch", "shard")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM (%s)),
g AS (SELECT *, CAST(i // CAST(ceil(c / 5.0) AS BIGINT) AS BIGINT) AS shard FROM n)
SELECT user_id, shard, arg_min(start_us, day) AS "start", arg_max(end_us, day) AS "end", count(*) AS spans FROM g GROUP BY ALL""" % SPANS)
def coalesced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.coalesced_spans(_spans(spark, sf_dir), ["user_id"], ["day"], "start_us", "end_us", 5)


@query("""
WITH t AS (
  SELECT user_id, day, tier, max(value) > 60 AS ok, CASE tier WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS ord
  FROM (SELECT user_id, epoch_us(ts) // 86400000000 AS day, event_type AS tier, value FROM events) GROUP BY user_id, day, tier),
m AS (SELECT *, min(CASE WHEN ok THEN ord * 10 + tier_n END) OVER (PARTITION BY user_id, day) AS first
      FROM (SELECT *, CASE tier WHEN 'signup' THEN 1 ELSE 0 END AS tier_n FROM t))
SELECT user_id, day, coalesce(max(CASE WHEN ord * 10 + tier_n = first THEN tier END), 'error') AS source,
       string_agg(tier || ':quiet', '; ' ORDER BY ord, tier_n) FILTER (first IS NULL OR ord * 10 + tier_n < first) AS fallback_reason
FROM m GROUP BY user_id, day""")
def fallback_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind of event in order that had a value over 60 that day, and the kinds that had none."""
    order = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 10).when(F.col("event_type") == "purchase", 20).when(F.col("event_type") == "signup", 31).otherwise(30)
    tiers = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day"), F.col("event_type").alias("tier"), order.alias("ord")).agg((F.max("value") > 60).alias("ok"))
    return seq.fallback_chain(tiers.withColumn("reason", F.lit("quiet")), ["user_id", "day"], "ord", "tier", "ok", "reason")


@query("""
WITH t AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '-X' ELSE lang END AS code, CASE WHEN doc_id % 2 = 0 THEN 'asr' ELSE '' END AS kind FROM documents),
r AS (SELECT *, CASE WHEN lower(code) = 'fr' THEN 0 WHEN lower(code) LIKE 'fr-%' THEN 1 WHEN lower(code) = 'de-x' THEN 3 WHEN lower(code) LIKE 'de-x-%' THEN 4 WHEN lower(code) = 'de' THEN 5 END AS rank FROM t)
SELECT source, doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, kind = 'asr', doc_id) AS n FROM r WHERE rank IS NOT NULL) WHERE n = 1""")
def caption_track_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's documents as caption tracks the best for French, then for a variant of German."""
    docs = table(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("-X"))).otherwise(F.col("lang"))
    tracks = docs.select("source", "doc_id", code.alias("code"), F.when(F.col("doc_id") % 2 == 0, "asr").otherwise("").alias("kind"))
    return seq.ranked_tracks(tracks, ["source"], "code", "kind", "doc_id", ["fr", "de-X"]).select("source", "doc_id", "code")


@query("""
WITH s AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source) - 60000 AS excess,
  coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars % 97, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, n_chars FROM s WHERE excess > 0 AND before < excess""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cached files: which go, least recently used first, to bring a source to 60,000 characters."""
    files = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("n_chars") % 97).alias("used"))
    return seq.evicted(files, ["source"], "n_chars", "used", "doc_id", 60_000).select("source", "doc_id", "n_chars")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS head,
       lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
FROM conversations""")
def section_heads_and_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the question it belongs to and the roles before and after."""
    turns = table(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.left("text", F.lit(20))))
    filled = seq.filled_forward(turns, ["conv_id"], ["turn"], "head")
    return seq.neighbours(filled, ["conv_id"], ["turn"], "role").select("conv_id", "turn", "head", "previous_role", "next_role")


@query("""
WITH o AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER w - 1 AS pos,
  coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN ok THEN printf('pyt_%s_%02d', CAST(user_id AS VARCHAR), CAST(done AS BIGINT)) END AS image,
       printf('pyt_%s_h%02d', CAST(user_id AS VARCHAR), pos) AS step_image FROM o""")
def capture_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return seq.image_names(outcomes, "user_id", ["ts", "event_id"], "ok").select("event_id", "image", "step_image")


@query("""
SELECT doc_id, source || '/' || lang || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path
FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""")
def collision_free_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.unique_paths(table(spark, sf_dir, "documents"), "source", "lang", ["doc_id"], "md").select("doc_id", "path")


@query("""
WITH steps AS (
  SELECT user_id, event_id, (epoch_us(ts) // 1000000) % 7200 - 600 AS s, (epoch_us(ts) // 1000000) % 7200 - 600 + CAST(floor(value * 10) AS BIGINT) AS e,
         event_id % 11 AS a, event_id % 7 AS b FROM events),
clean AS (SELECT *, least(greatest(s, 0), 6000) AS s2, least(greatest(e, 0), 6000) AS e2 FROM steps),
live AS (SELECT * FROM clean WHERE e2 > s2),
ids AS (SELECT user_id, event_id, 0 AS pos, a AS iid FROM live UNION ALL SELECT user_id, event_id, 1, b FROM live),
claimed AS (SELECT user_id, event_id, string_agg('i' || iid, ',' ORDER BY pos) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, iid ORDER BY event_id, pos) AS n FROM ids WHERE iid < 9) WHERE n = 1 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s2, e2, event_id) AS index FROM live)
SELECT r.user_id, r.index, s2 AS start_sec, e2 AS end_sec, coalesce(c.ids, '') AS ids
FROM ranked r LEFT JOIN claimed c USING (user_id, event_id) WHERE index <= 30""")
def repaired_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of a plan with two insight ids each: clamped, each id with the first step that names it, 30 steps at most."""
    at = F.floor(F.col("us") / 1_000_000) % 7200 - 600
    insight = lambda n: F.concat(F.lit("i"), (F.col("event_id") % n).cast("string"))
    steps = events(spark, sf_dir).select("user_id", "event_id", at.alias("s"), (at + F.floor(F.col("value") * 10)).alias("e"), F.array(insight(11), insight(7)).alias("ids"), F.lit(6000).cast("long").alias("duration"))
    known = steps.select("user_id").distinct().withColumn("insight_id", F.explode(F.array(*[F.lit(f"i{k}") for k in range(9)])))
    out = seq.repaired_plan(steps, known, ["user_id"], "event_id", "s", "e", "ids", "duration", 30)
    return out.withColumn("ids", F.array_join("insight_ids", ",")).drop("insight_ids")
