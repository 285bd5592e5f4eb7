"""Queries whose helpers are Python, over whole tables; tests hold them against golden values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import python as py
from lorespark.operators import intervals, sequences

from .registry import query, table
from .rollups import GLOSSARY
from .scalars import _dirty


@query("SELECT lower(trim(p_name)) AS fold_key, count(*) AS parts, min(p_partkey) AS first FROM part GROUP BY ALL")
def term_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by their folded form."""
    parts = table(spark, sf_dir, "part").withColumn("fold_key", py.fold_term(F.upper("p_name")))
    return parts.groupBy("fold_key").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))


@query(r"SELECT doc_id, sha256(text) AS text_sha FROM documents")
def lookalike_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with Cyrillic letters put into Latin words come back as they were; lone Cyrillic words are no mixture."""
    docs = table(spark, sf_dir, "documents")
    mixed = F.replace("text", F.lit("he"), F.lit("hе"))
    return docs.select("doc_id", F.sha2(py.fold_lookalikes(mixed), 256).alias("text_sha"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:thee|tthe|that)\b', 'THE', 'g'),
  '(?i)\b(?:andd|of)\b', 'AND', 'g'), '(?i)\boff\b', 'Offf', 'g'), '(?i)\ber\b', 'Error', 'g')) AS text_sha, CAST(0 AS BIGINT) AS left FROM documents""")
def glossary_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant spellings rewritten; a second scan finds none."""
    from lorespark.operators.rollups import fidelity

    docs = table(spark, sf_dir, "documents").select("doc_id", py.rewritten_terms(F.col("text"), GLOSSARY).alias("text"))
    left = fidelity(docs, "doc_id", "text", GLOSSARY, 20).groupBy("doc_id").agg(F.count("*").alias("left"))
    return docs.join(left, "doc_id", "left").select("doc_id", F.sha2("text", 256).alias("text_sha"), F.coalesce("left", F.lit(0)).alias("left"))


@query(r"SELECT page_id, sha256(regexp_replace(html, '(?i)<(?:script|iframe|object|embed|style)[^>]*>', '', 'g')) AS text_sha, NULL::VARCHAR AS error FROM pages")
def body_sanitizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("html", F.lit("<% secret %>"))
    rows = table(spark, sf_dir, "pages").withColumn("r", py.safe_body(body, F.array(F.lit("keep.webp"))))
    return rows.select("page_id", F.sha2("r.text", 256).alias("text_sha"), "r.error")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects inside prose, fences and next to smaller ones."""
    n, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(n == 0, props).when(n == 1, F.concat(F.lit("Here: "), props, F.lit(" done {"))).when(n == 2, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(F.concat(F.lit("{} "), props))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(py.json_object(raw), "$.k").cast("long").alias("k"))


@query("SELECT conv_id, CAST(turn AS INT) AS pos, CAST(turn * 15 AS DOUBLE) AS start, CAST(15 AS DOUBLE) AS duration, role || ' & ' || turn AS text FROM conversations")
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as caption files of either form, parsed back."""
    turn = F.col("turn").cast("string")
    said = F.concat("role", F.lit("  &amp;amp;\n"), turn)
    seconds = F.concat(F.lit('<text start="'), (F.col("turn") * 15).cast("string"), F.lit('" dur="15">'), said, F.lit("</text>"))
    millis = F.concat(F.lit('<p d="15000" t="'), (F.col("turn") * 15000).cast("string"), F.lit('"><s>'), said, F.lit("</s></p>"))
    cue = F.when(F.col("conv_id") % 2 == 0, seconds).otherwise(millis)
    files = table(spark, sf_dir, "conversations").withColumn("cue", cue).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cue"))), lambda s: s["cue"]), "").alias("body"))
    xml = F.concat(F.lit('<?xml version="1.0"?><timedtext>'), "body", F.lit("</timedtext>"))
    return files.select("conv_id", F.inline(py.caption_cues(xml)))


@query("""
WITH s AS (SELECT conv_id, turn AS pos, CASE role WHEN 'user' THEN 'qa' WHEN 'system' THEN 'tips' ELSE 'lecture' END AS label, left(text, 20) AS summary,
                  turn * 60 + length(text) % 50 - 20 AS a, turn * 60 + length(text) % 50 - 20 + length(text) % 300 AS b FROM conversations),
c AS (SELECT conv_id, pos, label, summary, least(greatest(a, 0), 600) AS a, least(greatest(b, 0), 600) AS b FROM s),
p AS (SELECT DISTINCT conv_id, turn * 30 AS point FROM conversations),
n AS (SELECT conv_id, pos, label, summary, a, b, (SELECT arg_min(point, abs(point - a) * 10000 + point) FROM p WHERE p.conv_id = c.conv_id) AS pa,
             (SELECT arg_min(point, abs(point - b) * 10000 + point) FROM p WHERE p.conv_id = c.conv_id) AS pb FROM c),
k AS (SELECT conv_id, pos, label, summary, CASE WHEN abs(pa - a) <= 45 THEN pa ELSE a END AS a, CASE WHEN abs(pb - b) <= 45 THEN pb ELSE b END AS b FROM n),
g AS (SELECT conv_id, pos, label, summary, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY a, b, pos) = 1 THEN 0 ELSE a END AS a, b FROM k WHERE b > a),
cut AS (SELECT DISTINCT conv_id, unnest([a, b]) AS place FROM g),
held AS (SELECT cut.conv_id, place, list_sort(list({'a': a, 'b': b, 'pos': pos, 'label': label, 'summary': summary})) AS l
         FROM cut JOIN g ON g.conv_id = cut.conv_id AND a <= place AND place < b GROUP BY ALL),
own AS (SELECT conv_id, place, list_reduce(l, lambda x, y: CASE WHEN y.b <= x.b AND y.label <> 'lecture' THEN y ELSE x END) AS o FROM held),
full_ AS (SELECT cut.conv_id, cut.place, last_value(o IGNORE NULLS) OVER (PARTITION BY cut.conv_id ORDER BY cut.place) AS o FROM cut LEFT JOIN own USING (conv_id, place) WHERE cut.place < 600),
runs AS (SELECT conv_id, place, o FROM full_ QUALIFY lag(o.pos) OVER (PARTITION BY conv_id ORDER BY place) IS DISTINCT FROM o.pos),
r1 AS (SELECT *, coalesce(lead(place) OVER w, 600) AS stop, row_number() OVER w AS n FROM runs WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
r2 AS (SELECT conv_id, place, o FROM r1 WHERE o.label <> 'lecture' OR stop - place >= 20 OR n = 1),
r3 AS (SELECT *, coalesce(lead(place) OVER w, 600) AS stop, row_number() OVER w AS n FROM r2 WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
r4 AS (SELECT conv_id, place, stop, o FROM r3 WHERE o.label <> 'lecture' OR stop - place >= 20 OR n > 1 OR stop = 600)
SELECT conv_id, CAST(row_number() OVER w - 1 AS INT) AS pos, CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE place END AS BIGINT) AS start_sec, CAST(stop AS BIGINT) AS end_sec, o.label AS label, o.summary AS summary
FROM r4 WINDOW w AS (PARTITION BY conv_id ORDER BY place)""")
def segment_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as overlapping segments of a talk, repaired into a partition of its length."""
    turns = table(spark, sf_dir, "conversations")
    label = F.when(F.col("role") == "user", "qa").when(F.col("role") == "system", "tips").otherwise("lecture")
    start = F.col("turn") * 60 + F.char_length("text") % 50 - 20
    segments = turns.select("conv_id", F.col("turn").alias("pos"), start.alias("start_sec"), (start + F.char_length("text") % 300).alias("end_sec"), label.alias("label"), F.left("text", F.lit(20)).alias("summary"), F.lit(600).cast("long").alias("duration"))
    points = turns.select("conv_id", (F.col("turn") * 30).alias("start_sec"))
    return intervals.repaired_segments(segments, points, "conv_id")


@query(r"""
SELECT p_partkey, printf('%02d_', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) || p_type || ' ' || p_name || '.md' AS filename,
       CASE WHEN p_partkey % 9 = 0 THEN 'Clippings/Inbox' ELSE p_brand || '/' || p_name END AS path FROM part""")
def chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of parts as chapters, by brand, and paths that stay in their folder."""
    parts = table(spark, sf_dir, "part").withColumn("number", F.expr("row_number() over (partition by p_brand order by p_partkey)"))
    path = F.concat_ws("/", F.when(F.col("p_partkey") % 9 == 0, "..").otherwise("."), "p_brand", "p_name")
    return parts.select("p_partkey", py.short_filename(F.concat_ws(": ", "p_type", "p_name"), F.col("number")).alias("filename"), py.safe_path(path).alias("path"))


@query()
def compressed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of turns without fillers and stuttered words."""
    from lorespark.functions.text import compress

    turns = table(spark, sf_dir, "conversations").withColumn("start_sec", F.col("turn") * 15)
    chunks = sequences.anchor_chunks(turns.select("conv_id", "turn", "text", "start_sec"), ["conv_id"], ["turn"], "start_sec", 30)
    said = chunks.groupBy("conv_id", "chunk").agg(sequences.joined_text("text", ["turn"]).alias("text"))
    return said.withColumn("text", compress(F.concat(F.lit("えー so so so "), "text")))


@query(r"""
SELECT doc_id, sha256(CASE doc_id % 4 WHEN 1 THEN regexp_replace(replace(text, ' a', ' а'), ' а([A-Za-zÀ-ɏ])', ' a\1', 'g')
  WHEN 2 THEN replace(text, '. ', '.</UNTRUSTED_content x>') ELSE text END) AS text_sha FROM documents""")
def hidden_text_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty texts without invisible characters, look-alikes folded outside of link targets."""
    from lorespark.functions.text import strip_invisible

    return _dirty(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(py.fold_lookalikes(strip_invisible(F.col("dirty")), targets=False), 256).alias("text_sha"))
