"""Queries over notes, sheets, plans and gates, on the driver tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import notes as parts
from lorespark.operators import glossary, runs
from lorespark.operators import notes as files
from lorespark.shared import new_path
from lorespark.sources.files import read_note_files, write_note_files

from .registry import query, table


def _maker():
    return F.concat(F.lit("m"), (F.col("p_partkey") % 5).cast("string"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a sheet for each maker: a section for each brand, a row for each part, corrected in every third size."""
    part = table(spark, sf_dir, "part")
    section = F.substring("p_brand", 7, 2).cast("int")
    return part.select(_maker().alias("path"), section.alias("section_pos"), F.col("p_brand").alias("video_id"), F.lit("old").alias("title"), F.col("p_partkey").cast("int").alias("row_pos"), F.col("p_name").alias("system_term"), F.when(F.col("p_size") % 3 == 0, F.upper("p_type")).otherwise("").alias("user_correction"))


SHEET = """
sheet AS (SELECT 'm' || p_partkey % 5 AS path, CAST(substr(p_brand, 7) AS INT) AS section_pos, p_brand AS video_id, CAST(p_partkey AS INT) AS row_pos, p_name AS system_term,
                 CASE WHEN p_size % 3 = 0 THEN upper(p_type) ELSE '' END AS user_correction FROM part)"""


@query(f"""
WITH {SHEET},
c AS (SELECT *, lower(trim(user_correction)) AS ck, lower(trim(system_term)) AS sk, section_pos * CAST(100000000 AS BIGINT) + row_pos AS place FROM sheet WHERE user_correction <> '' AND lower(user_correction) <> lower(system_term)),
e AS (SELECT path, ck, min(place) AS first, arg_min(user_correction, place) AS canonical FROM c GROUP BY path, ck),
a AS (SELECT path, ck, string_agg(term, ',' ORDER BY place) AS aliases FROM (SELECT path, ck, sk, min(place) AS place, arg_min(system_term, place) AS term FROM c GROUP BY path, ck, sk) GROUP BY path, ck)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY first) - 1 AS INT) AS entry_pos, canonical, aliases FROM e JOIN a USING (path, ck)""")
def correction_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected rows of sheets as glossary entries."""
    found = glossary.correction_entries(_sheet(spark, sf_dir))
    return found.select("path", "entry_pos", "canonical", F.array_join("aliases", ",").alias("aliases"))


@query(f"""
WITH {SHEET},
t AS (SELECT 'm' || p_partkey % 5 AS path, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'new' END AS video_id, p_partkey AS pos, lower(p_type) AS term FROM part),
f AS (SELECT path, video_id, term, min(pos) AS pos FROM t GROUP BY ALL),
v AS (SELECT DISTINCT path, video_id FROM t),
own AS (SELECT s.* FROM sheet s JOIN v USING (path, video_id)),
fresh AS (SELECT f.* FROM f WHERE NOT EXISTS (FROM own o WHERE o.path = f.path AND o.video_id = f.video_id AND lower(o.system_term) = f.term)),
numbered AS (SELECT path, video_id, term, coalesce((SELECT max(row_pos) + 1 FROM own o WHERE o.path = fresh.path AND o.video_id = fresh.video_id), 0) + row_number() OVER (PARTITION BY path, video_id ORDER BY pos) - 1 AS row_pos FROM fresh),
last AS (SELECT path, max(section_pos) AS last FROM sheet GROUP BY path)
SELECT path, section_pos, video_id, CASE WHEN EXISTS (FROM v WHERE v.path = sheet.path AND v.video_id = sheet.video_id) THEN 'fresh' ELSE 'old' END AS title, row_pos, system_term, user_correction FROM sheet
UNION ALL
SELECT path, coalesce((SELECT min(section_pos) FROM own o WHERE o.path = numbered.path AND o.video_id = numbered.video_id), last + 1) AS section_pos, video_id, 'fresh', CAST(row_pos AS INT), term, '' FROM numbered JOIN last USING (path)""")
def upserted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New terms put into the sections of their videos, and one new section for each maker."""
    terms = table(spark, sf_dir, "part").select(_maker().alias("path"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("new").alias("video_id"), F.lit("fresh").alias("title"), F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), F.lower("p_type")).alias("term"))
    return glossary.upserted_terms(_sheet(spark, sf_dir), terms)


@query()
def merged_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each maker's corrections merged into a glossary of its types; who owns a spelling depends on all before it, which SQL cannot say."""
    entries = glossary.correction_entries(_sheet(spark, sf_dir)).select(F.col("path").alias("book"), "entry_pos", "canonical", "aliases", F.lit("").alias("reading"), F.lit("part").alias("category"))
    types = table(spark, sf_dir, "part").groupBy(_maker().alias("book"), F.initcap("p_type").alias("canonical")).agg(F.min("p_partkey").cast("int").alias("entry_pos"), F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    base = types.withColumns({"reading": F.lit(""), "category": F.lit("type")})
    return glossary.merged_glossaries(base, entries)


@query("""
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'lang: "' || coalesce(lang, '') || '"' || chr(10) || 'source: "' || coalesce(source, '') || '"' || chr(10) || '---' || chr(10) || text
  WHEN 1 THEN '---' || chr(10) || 'source: "x"' || chr(10) || 'lang: "' || coalesce(lang, '') || '"' || chr(10) || '---' || chr(10) || text ELSE text END) AS note
FROM documents WHERE doc_id % 3 <> 2 OR NOT starts_with(text, '---')""")
def frontmatter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language put into notes that have the field, that lack it, and that have no frontmatter."""
    docs = table(spark, sf_dir, "documents").filter((F.col("doc_id") % 3 != 2) | ~F.col("text").startswith("---"))
    source = F.coalesce("source", F.lit(""))
    old = F.concat(F.lit('---\nlang: \\1 old\nsource: "'), source, F.lit('"\n---\n'), "text")
    note = F.when(F.col("doc_id") % 3 == 0, old).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('---\nsource: "x"\n---\n'), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(parts.with_field(note, "lang", F.coalesce("lang", F.lit("")))).alias("note"))


@query("""
SELECT doc_id, CASE WHEN length(b) > 50000 THEN 'summary has ' || length(b) || ' characters' WHEN doc_id % 4 = 1 THEN 'heading missing: ## 要点タイムライン' WHEN doc_id % 4 = 2 THEN 'no time range' END AS error
FROM (SELECT doc_id, '## 全体サマリ' || chr(10) || text || CASE WHEN doc_id % 4 = 1 THEN '' ELSE chr(10) || '## 要点タイムライン' END || CASE WHEN doc_id % 4 = 2 THEN '' ELSE chr(10) || '### [00:10 ~ 01:20] x' END AS b FROM documents)""")
def summary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that are too long, lack a heading or lack a time range."""
    n = F.col("doc_id") % 4
    body = F.concat(F.lit("## 全体サマリ\n"), "text", F.when(n == 1, "").otherwise("\n## 要点タイムライン"), F.when(n == 2, "").otherwise("\n### [00:10 ~ 01:20] x"))
    return table(spark, sf_dir, "documents").select("doc_id", parts.summary_error(body).alias("error"))


@query("""
WITH k AS (SELECT DISTINCT o_custkey AS talk, o_orderkey AS insight_id FROM orders)
SELECT talk, insight_id FROM k WHERE insight_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3) AND insight_id % 5 <> 0""")
def insights_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as insights of customers: which are in no step and not listed as unassigned."""
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("talk"), F.col("o_orderkey").alias("insight_id"))
    steps = known.join(table(spark, sf_dir, "lineitem").filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("insight_id")), "insight_id", "left_semi")
    return runs.left_over(known, steps, known.filter("insight_id % 5 = 0"), ["talk"])


@query("""SELECT 'm' || p_partkey % 5 AS book, p_name AS stem FROM part GROUP BY p_partkey % 5, p_name HAVING bool_and(p_size % 4 = 0)""")
def orphan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as notes of their maker that its overviews do not link to."""
    part = table(spark, sf_dir, "part")
    overviews = part.filter("p_size % 4 <> 0").select(_maker().alias("book"), F.concat(F.lit("see [["), "p_name", F.lit("]] and [x]")).alias("body"))
    return runs.orphans(part.select(_maker().alias("book"), F.col("p_name").alias("stem")), overviews, "book", "stem", "body")


@query("""
SELECT s_nationkey AS book, printf('%02d_', s_suppkey) || s_name AS old, printf('%02d_', s_suppkey) || upper(s_name) AS new FROM supplier WHERE s_suppkey % 2 = 0""")
def label_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of chapters whose label the glossary has changed."""
    before = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("book"), F.col("s_suppkey").alias("chapter_index"), F.col("s_name").alias("label"))
    after = before.withColumn("label", F.when(F.col("chapter_index") % 2 == 0, F.upper("label")).otherwise(F.col("label")))
    return runs.label_rewrites(before, after, ["book", "chapter_index"])


@query("""
SELECT o_orderdate AS day, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS video_ids
FROM (SELECT DISTINCT o_orderdate, o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_orderdate""")
def finding_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent orders as the videos that a day's findings name."""
    found = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day"), F.when(F.col("o_orderpriority") == "1-URGENT", "04").otherwise("05").alias("scope"), F.col("o_custkey").alias("video_id"))
    return runs.targets(found, ["day"]).select("day", F.array_join(F.transform("video_ids", lambda v: v.cast("string")), ",").alias("video_ids"))


@query("""
WITH b AS (SELECT DISTINCT user_id, event_type FROM events),
r AS (SELECT user_id, min(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS rank FROM b GROUP BY user_id)
SELECT * FROM r WHERE rank < 9""")
def reviewed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as folders that hold a reviewed note of each of their users: the best folder of each user."""
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    found = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    video = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 10, "0"))
    note = F.concat(F.lit('---\nvideo_id: "'), video, F.lit('"\nreviewed: '), F.lit("True"), F.lit("\n---\nbody"))
    fresh = F.concat(F.lit('---\nvideo_id: "'), video, F.lit('"\nreviewed: false\n---\nbody'))
    notes = found.select(F.col("event_type").alias("folder"), F.concat(F.col("user_id").cast("string"), F.lit(".md")).alias("filename"), note.alias("content"))
    notes = notes.unionByName(found.select(F.lit("newest").alias("folder"), F.lit("a.md").alias("filename"), fresh.alias("content")).distinct())
    folders = found.select(F.col("event_type").alias("name"), rank.alias("rank")).distinct().unionByName(spark.createDataFrame([("newest", -1)], "name string, rank int"))
    return runs.reviewed_notes(notes, folders).select(F.substring("video_id", 2, 10).cast("long").alias("user_id"), "rank")


@query("""
SELECT source, sha256(string_agg('## VIDEO: v' || doc_id || ': ' || coalesce(nullif(lang, ''), 'Untitled') || chr(10) || chr(10) || left(text, CAST(400000 // n AS INT)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS content_sha
FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL) GROUP BY source""")
def materials_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the videos of a playlist: one block of all their texts, which share a budget of characters."""
    docs = table(spark, sf_dir, "documents").filter("source is not null").withColumnRenamed("source", "playlist")
    videos = docs.select("playlist", F.col("doc_id").alias("pos"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("lang").alias("title"))
    bodies = docs.select("playlist", (F.col("doc_id") * 2).alias("pos"), F.coalesce("text", F.lit("")).alias("body"))
    return files.materials(videos, bodies).select(F.col("playlist").alias("source"), F.sha2("content", 256).alias("content_sha"))


@query(r"""
SELECT unit, folder, filename, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS content_sha FROM (
  SELECT unit, 'base/' || dir || '/2024-05-06-0708 ' || p_brand AS folder, '2024-05-06-0708 ' || p_name || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS filename,
         '---' || chr(10) || 'date: 2024-05-06 07:08' || chr(10) || 'title: "' || p_name || '"' || chr(10) || 'URL: "https://www.youtube.com/watch?v=' || vid || '"' || chr(10) || 'playlist: "' || p_type || '/' || p_brand || '"' || chr(10)
         || 'video_id: "' || vid || '"' || chr(10) || CASE WHEN unit = 'summary' THEN 'reviewed: "false"' || chr(10) ELSE '' END || 'tags: [memo, youtube]' || chr(10) || '---' || chr(10) AS content
  FROM (SELECT *, printf('v%010d', p_partkey) AS vid, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)
  CROSS JOIN (VALUES ('scripts', '01_Scripts_Processing_Unit'), ('summary', '02_Summary_Processing_Unit'), ('capture', '03_Capture_Processing_Unit')) AS u(unit, dir))""")
def placeholder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as videos: their first notes written as files to the shared folder and read back."""
    videos = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.format_string("v%010d", "p_partkey").alias("video_id"), F.col("p_name").alias("title"), F.concat_ws("/", "p_type", "p_brand").alias("playlist_title")
    )
    path = new_path(spark, "notes")
    write_note_files(files.placeholder_notes(videos, F.lit("2024-05-06 07:08:00").cast("timestamp"), "base"), path)
    unit = F.when(F.col("folder").contains("/01_"), "scripts").when(F.col("folder").contains("/02_"), "summary").otherwise("capture")
    return read_note_files(spark, path).select(unit.alias("unit"), "folder", "filename", "size", F.sha2("content", 256).alias("content_sha"))


@query(r"""
WITH f AS (SELECT o_custkey % 50 AS b, o_custkey % 3 + 1 AS it, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'pedagogy' ELSE 'fidelity' END AS p, o_orderpriority = '1-URGENT' AS high FROM orders),
lines AS (SELECT b, it, count(*) AS n, count(*) FILTER (high) AS h, count(*) FILTER (p = 'coverage') AS c, count(*) FILTER (p = 'pedagogy') AS d, count(*) FILTER (p = 'fidelity') AS e,
  coalesce(string_agg(chr(10) || '  - [' || p || '] order ' || o_orderkey || ' (→ 05)', '' ORDER BY printf('f%09d', o_orderkey)) FILTER (high), '') AS l FROM f GROUP BY ALL)
SELECT 'book' || b || '/_meta/evaluation/summary.md' AS path, sha256('# 評価サマリ' || chr(10) || chr(10) || '- ループ実行回数: ' || count(*) || string_agg(chr(10) || chr(10) || '## ループ ' || it || chr(10) || '- blocking(high): ' || h || ' / 全 finding: ' || n
  || chr(10) || '- coverage: ' || c || ' / pedagogy: ' || d || ' / fidelity: ' || e || chr(10) || '- 04 再生成: v' || it || chr(10) || '- 05 再合成: ' || CASE WHEN it = 1 THEN 'あり' ELSE 'なし' END || l, '' ORDER BY it) || chr(10)) AS content_sha
FROM lines GROUP BY b""")
def evaluation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of evaluations in three loops: the report of each."""
    n = F.col("o_orderkey") % 3
    found = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("book"), (F.col("o_custkey") % 50).cast("string")).alias("folder"), (F.col("o_custkey") % 3 + 1).cast("int").alias("iteration"), F.format_string("f%09d", "o_orderkey").alias("finding_id"),
        F.when(n == 0, "coverage").when(n == 1, "pedagogy").otherwise("fidelity").alias("perspective"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("severity"),
        F.lit("05").alias("target_scope"), F.lit("").alias("target_video_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
    )
    loops = found.select("folder", "iteration").distinct().withColumns({
        "regenerated_video_ids": F.array(F.concat(F.lit("v"), F.col("iteration").cast("string"))), "synthesis_rerun": F.col("iteration") == 1, "stop_reason": F.lit(None).cast("string"),
    })
    return files.evaluation_summaries(loops, found).select("path", F.sha2("content", 256).alias("content_sha"))
