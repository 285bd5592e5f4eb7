"""Queries over groups: cost and token totals, topic merges, coverage, deduplication, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import times
from lorespark.operators import rollups as ops

from .registry import query, table
from .timeline import DAY, events

MONEY = "decimal(18,6)"


@query("""
WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN CAST(value AS DECIMAL(18,6)) END AS c2, CASE WHEN event_id % 3 = 0 THEN CAST(value / 2 AS DECIMAL(18,6)) END AS c4,
  CASE WHEN event_id % 2 = 0 THEN event_type END AS m FROM events),
l AS (SELECT event_id, 'stage_02' AS stage, c2 AS cost, m AS model FROM r UNION ALL SELECT event_id, 'stage_04', c4, m FROM r UNION ALL SELECT event_id, 'synthesis', NULL, m FROM r),
s AS (SELECT * FROM l WHERE cost IS NOT NULL)
SELECT stage, CAST(sum(cost) AS VARCHAR) AS cost, arg_min(coalesce(model, '?'), event_id) AS model FROM s GROUP BY stage
UNION ALL SELECT 'total', CAST(sum(cost) AS VARCHAR), NULL FROM s""")
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs with a cost for each stage, null for some: totals by stage and over all."""
    model = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    runs = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value").cast(MONEY)).alias("c2"), F.when(F.col("event_id") % 3 == 0, (F.col("value") / 2).cast(MONEY)).alias("c4"), F.lit(None).cast(MONEY).alias("cs"), model.alias("m")
    )
    out = ops.cost_breakdown(runs, [("stage_02", "c2", "m"), ("stage_04", "c4", "m"), ("synthesis", "cs", "m")], "event_id")
    return out.withColumn("cost", F.col("cost").cast(MONEY).cast("string"))


@query("""
SELECT user_id, epoch_us(ts) // 86400000000 AS day, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN event_id % 100 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id % 10 END) AS BIGINT) AS tokens_out,
       arg_max(event_type, event_id) AS text, count(*) AS attempts FROM events GROUP BY ALL""")
def call_retry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries of a call as one row: null where no attempt has a count."""
    calls = events(spark, sf_dir).select(
        "user_id", F.floor(F.col("us") / DAY).alias("day"), "event_id", F.col("event_type").alias("text"),
        F.when(F.col("event_type").isin("view", "click"), F.col("event_id") % 100).alias("tokens_in"), F.when(F.col("event_type") == "purchase", F.col("event_id") % 10).alias("tokens_out"),
    )
    return ops.call_totals(calls, ["user_id", "day"], ["tokens_in", "tokens_out"], "event_id", "text")


@query("""
WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN '  ' || lower(p_type) WHEN p_partkey % 50 = 7 THEN ' ' ELSE p_type END AS label,
  'v' || (p_size % 4 + length(p_type)) AS src, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS summary,
  CASE p_partkey % 5 WHEN 0 THEN [p_brand, p_brand, lower(p_brand)] WHEN 1 THEN NULL ELSE [lower(p_brand), p_brand] END AS aliases FROM part),
k AS (SELECT *, lower(trim(label)) AS key FROM t WHERE trim(label) <> ''),
g AS (SELECT key, min(pos) AS first, arg_min(label, pos) AS label, coalesce(arg_min(summary, pos) FILTER (summary <> ''), '') AS summary,
  coalesce(string_agg(src || ' ' || pos || ': ' || summary, ',' ORDER BY pos) FILTER (summary <> ''), '') AS excerpts FROM k GROUP BY key),
sources AS (SELECT key, string_agg(src, ',' ORDER BY pos) AS source_videos, count(*) AS dup FROM (SELECT key, src, min(pos) AS pos FROM k GROUP BY ALL) GROUP BY key),
a AS (SELECT key, pos, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS p FROM k),
met AS (
  SELECT key, alias, pos * 10 + p AS met_at FROM a JOIN g USING (key) WHERE pos = first
  UNION ALL SELECT key, alias, met_at FROM (SELECT key, alias, min(pos * 10 + p) AS met_at, min(pos) AS pos FROM a GROUP BY ALL) JOIN g USING (key) WHERE pos > first),
aliases AS (SELECT key, string_agg(alias, ',' ORDER BY met_at) AS aliases FROM met GROUP BY key)
SELECT printf('t%03d', row_number() OVER (ORDER BY first)) AS topic_id, label, coalesce(aliases, '') AS aliases, source_videos, dup AS duplication_count,
       CASE WHEN dup >= 3 THEN 'core' WHEN dup = 2 THEN 'supporting' ELSE 'unique' END AS category, summary, excerpts
FROM g JOIN sources USING (key) LEFT JOIN aliases USING (key)""")
def topic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as topic labels with noise in case and space: one topic each, with its sources."""
    noisy = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.lower("p_type"))).when(F.col("p_partkey") % 50 == 7, " ").otherwise(F.col("p_type"))
    n, src = F.col("p_partkey") % 5, F.concat(F.lit("v"), (F.col("p_size") % 4 + F.char_length("p_type")).cast("string"))
    aliases = F.when(n == 0, F.array("p_brand", "p_brand", F.lower("p_brand"))).when(n != 1, F.array(F.lower("p_brand"), "p_brand"))
    quote = F.struct(src.alias("video_id"), F.col("p_partkey").cast("string").alias("range_str"), F.col("p_name").alias("quote"))
    topics = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), noisy.alias("label"), F.array(src, src).alias("source_videos"), aliases.alias("aliases"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise("").alias("summary"), F.when(F.col("p_partkey") % 4 == 0, F.array(quote)).alias("excerpts"),
    )
    out = ops.merged_topics(topics, ["pos"])
    quoted = F.transform("excerpts", lambda e: F.concat(e["video_id"], F.lit(" "), e["range_str"], F.lit(": "), e["quote"]))
    return out.withColumns({"aliases": F.array_join("aliases", ","), "source_videos": F.array_join("source_videos", ","), "excerpts": F.array_join(quoted, ",")})


@query("""
SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45 AND l_returnflag = 'R') AS covered FROM part""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as topics: which ones the returned large orders use."""
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return ops.coverage(table(spark, sf_dir, "part"), used, "p_partkey")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) OR o_orderkey % 10 = 3""")
def checkpoint_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos: those without lines are still to do, and one in ten is forced."""
    orders = table(spark, sf_dir, "orders")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.remaining(orders, done, orders.filter("o_orderkey % 10 = 3"), "o_orderkey").select("o_orderkey")


@query("""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text without case and outer space is new, the first of each."""
    return ops.first_of_each_text(table(spark, sf_dir, "documents"), F.lower(F.trim("text")), "doc_id", ["doc_id", "source"])


@query("""
WITH r AS (SELECT p_partkey, lower(p_name) AS fold_key, p_type, p_size > 25 AS corrected FROM part)
SELECT fold_key, min(p_partkey) AS first_seen, arg_min(p_partkey, (CASE WHEN corrected THEN 0 ELSE 1 END) * 1000000000 + p_partkey) AS p_partkey,
       arg_min(p_type, (CASE WHEN corrected THEN 0 ELSE 1 END) * 1000000000 + p_partkey) AS p_type FROM r GROUP BY fold_key""")
def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as terms: a corrected row replaces the first."""
    return ops.known_pairs(table(spark, sf_dir, "part"), F.lower("p_name"), F.col("p_size") > 25, "p_partkey", ["p_partkey", "p_type"])


GLOSSARY = (("THE", ("thee", "tthe", "that")), ("AND", ("andd", "of")), ("Offf", ("off",)), ("Error", ("er",)))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:thee|tthe|that|andd|of|off|er)\\b')) AS surface, generate_subscripts(regexp_extract_all(text, '(?i)\\b(?:thee|tthe|that|andd|of|off|er)\\b'), 1) AS pos FROM documents),
c AS (SELECT *, CASE WHEN lower(surface) IN ('thee', 'tthe', 'that') THEN 'THE' WHEN lower(surface) IN ('andd', 'of') THEN 'AND' WHEN lower(surface) = 'off' THEN 'Offf' ELSE 'Error' END AS canonical FROM w),
s AS (SELECT doc_id, canonical, string_agg(surface, '、' ORDER BY pos) AS surfaces, min(pos) AS first FROM (SELECT doc_id, canonical, surface, min(pos) AS pos FROM c GROUP BY ALL) GROUP BY doc_id, canonical),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS rank FROM s)
SELECT doc_id, canonical, surfaces, rank, printf('f%03d', row_number() OVER (ORDER BY doc_id, rank)) AS finding_id FROM r WHERE rank <= 20""")
def fidelity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a glossary of frequent words: which spellings they use instead of the canonical one, numbered over all of them."""
    found = ops.fidelity(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text", GLOSSARY, 20)
    return ops.finding_ids(found, ["doc_id", "rank"])


@query("SELECT o_orderkey, o_orderpriority, printf('f%03d', row_number() OVER (ORDER BY o_orderkey)) AS finding_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as findings, numbered over all of them."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderpriority")
    return ops.finding_ids(urgent, ["o_orderkey"])


@query("""
SELECT source, count(*) AS bodies, CAST(sum(length(text)) AS BIGINT) AS chars, max(lim) AS body_limit, count(*) FILTER (length(text) > lim) AS cut
FROM (SELECT source, text, CAST(floor(100000.0 / count(*) OVER (PARTITION BY source)) AS BIGINT) AS lim FROM documents) GROUP BY source""")
def synthesis_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.preflight(table(spark, sf_dir, "documents"), "source", "text", 100_000)


@query("""
SELECT source, lang, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, CAST(sum(n_chars) // 60 AS BIGINT) AS minutes
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""")
def source_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and language: how many documents, labelled, good and toxic ones, and minutes at 60 characters."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source", "lang").agg(
        F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.floor(F.sum("n_chars") / 60).alias("minutes")
    )


@query("""
SELECT CAST(user_id AS BIGINT) AS user_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
       count(*) FILTER (event_type = 'view') AS lecture, count(*) FILTER (event_type = 'click') AS qa, CAST(sum(coalesce(CASE WHEN event_id % 4 > 0 THEN event_id % 600 END, 0)) // 60 AS BIGINT) AS minutes FROM events GROUP BY user_id""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes, failures, labels and minutes of each user's events; unknown durations count as 0."""
    duration = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 600)
    kinds = {"lecture": F.col("event_type") == "view", "qa": F.col("event_type") == "click"}
    return ops.run_totals(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error", kinds, duration)


@query("""
SELECT event_id, CASE WHEN p IS NULL THEN NULL ELSE CAST(round(CAST(event_id % 5000 AS DECIMAL(20,2)) * p + CAST(event_id % 700 AS DECIMAL(20,2)) * p * 1.25 + CAST(event_id % 900 AS DECIMAL(20,2)) * p * 0.10 + CAST(event_id % 300 AS DECIMAL(20,2)) * q) AS BIGINT) END AS cost_micros
FROM events LEFT JOIN (VALUES ('view', 1.00, 5.00), ('click', 3.00, 15.00), ('purchase', 15.00, 75.00)) v(event_type, p, q) USING (event_type)""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a call by a price table, in millionths; null for kinds without a price."""
    prices = spark.createDataFrame([("view", "1.00", "5.00"), ("click", "3.00", "15.00"), ("purchase", "15.00", "75.00")], "event_type string, p string, q string")
    joined = table(spark, sf_dir, "events").join(prices, "event_type", "left")
    money = lambda c: F.col(c).cast("decimal(10,2)")
    n = lambda k: F.col("event_id") % k
    return joined.select("event_id", times.cost_micros(n(5000), n(700), n(900), n(300), money("p"), money("q")).alias("cost_micros"))


@query("""
SELECT c.conv_id, c.turn, CASE WHEN c.turn % 3 = 0 AND length(c.text) % 4 > 0 THEN '* ' || c.text ELSE c.text END AS text FROM conversations c""")
def corrections_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn has a correction, some of which are empty and leave the turn as it is."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    fixed = turns.filter("turn % 3 = 0").withColumn("text", F.when(F.char_length("text") % 4 > 0, F.concat(F.lit("* "), "text")).otherwise(""))
    return ops.corrections_applied(turns, fixed, ["conv_id", "turn"], "text")


@query("""
SELECT d.doc_id, sha256(d.lang || chr(0) || d.source || chr(0) || CAST(d.doc_id AS VARCHAR) || chr(0)) AS key, l.doc_id IS NOT NULL AS hit, CASE WHEN l.doc_id IS NOT NULL THEN l.quality * 10 + l.toxic ELSE d.n_chars END AS value
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a cache of answers under content keys: only requests without one are computed."""
    docs = table(spark, sf_dir, "documents")
    key = times.llm_key(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("key")
    requests = docs.select("doc_id", key, F.col("n_chars"))
    cache = requests.join(table(spark, sf_dir, "labels"), "doc_id").select("key", (F.col("quality") * 10 + F.col("toxic")).cast("long").alias("value"))
    out = ops.cached_or_computed(requests.select("key", "n_chars"), cache, "key", "value", lambda m: m.withColumn("value", F.col("n_chars")))
    return requests.select("doc_id", "key").join(out, "key").select("doc_id", "key", "hit", "value")


@query("""
SELECT n_regionkey, n_name, string_agg(s_name, ',' ORDER BY s_suppkey) AS notes FROM (
  SELECT n_regionkey, n_name, s_suppkey, s_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0) WHERE n <= 2 GROUP BY ALL""")
def reviewed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes before the rank: of each nation the two richest suppliers that are not in debt."""
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ranked = rich.withColumn("n", F.expr("row_number() over (partition by n_nationkey order by s_acctbal desc, s_suppkey)")).filter("n <= 2")
    names = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: s["s_name"])
    return ranked.groupBy("n_regionkey", "n_name").agg(F.array_join(names, ",").alias("notes"))


@query("""
SELECT o.o_orderkey, string_agg(CAST(p_partkey AS VARCHAR) || ':' || p_type, ',' ORDER BY l_linenumber, p_partkey, l_suppkey) AS links
FROM orders o JOIN lineitem ON l_orderkey = o.o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o.o_orderkey""")
def insight_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that an array names, exploded and looked up: the parts of each order, in its order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ids"))
    named = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", F.explode("ids").alias("id")).join(table(spark, sf_dir, "part"), F.col("id.l_partkey") == F.col("p_partkey"))
    links = F.transform(F.array_sort(F.collect_list(F.struct("id.l_linenumber", "p_partkey", "id.l_suppkey", "p_type"))), lambda s: F.concat_ws(":", s["p_partkey"].cast("string"), s["p_type"]))
    return named.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(links, ",").alias("links"))
