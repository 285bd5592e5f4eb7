"""Queries that apply the column expressions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import parsing, text, times
from lorespark.operators.rollups import category

from .registry import query, table


@query("""
SELECT event_id, printf('%02d:%02d', s // 60, s % 60) AS mmss,
       CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS hms,
       CASE WHEN event_id % 5 IN (0, 2) THEN strftime(ts, '%Y-%m-%d %H%M') WHEN event_id % 5 = 1 THEN strftime(ts, '%Y-%m-%d-%H%M') || ' a ' || event_type || ' b' ELSE strftime(ts, '%Y-%m-%d-%H%M') || ' ' || event_type END AS note,
       strftime(ts, '%Y-%m-%d-%H%M') || CASE WHEN event_id % 5 IN (0, 2) THEN '' WHEN event_id % 5 = 1 THEN ' b' ELSE ' ' || event_type END AS folder, CAST(greatest(0, s - 1.75) AS DOUBLE) AS clip_start
FROM (SELECT *, event_id * 7 % 9000 AS s FROM events)""")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as labels, and names of notes and folders, also without a title and for titles that file names refuse."""
    n = F.col("event_id") % 5
    title = F.when(n == 0, "").when(n == 1, F.concat(F.lit(' a: "'), "event_type", F.lit('" / <b>? '))).when(n > 2, F.col("event_type"))
    e = table(spark, sf_dir, "events").withColumns({"s": F.col("event_id") * 7 % 9000, "title": title})
    return e.select(
        "event_id", times.mmss(F.col("s")).alias("mmss"), times.hms(F.col("s")).alias("hms"), times.note_base(F.col("ts"), F.col("title")).alias("note"),
        times.folder_name(F.col("ts"), F.col("title")).alias("folder"), F.greatest(F.lit(0.0), F.col("s") - 1.75).alias("clip_start"),
    )


@query("""
WITH d AS (SELECT doc_id, replace(replace(text, ' the ', '  \t the  '), '. ', chr(12288) || '.' || chr(10)) AS t FROM documents)
SELECT doc_id, trim(regexp_replace(t, '[\\s　]+', ' ', 'g')) AS collapsed, regexp_replace(substr(trim(regexp_replace(t, '[\\s　]+', ' ', 'g')), 1, 150), '[\\\\/:*?"<>|]', ' ', 'g') AS title FROM d""")
def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with noise of white space, tabs and ideographic spaces put in, collapsed again."""
    noisy = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("  \t the  ")), F.lit(". "), F.lit("　.\n"))
    clean = text.collapse(noisy)
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("collapsed"), F.regexp_replace(F.left(clean, F.lit(150)), r'[\\/:*?"<>|]', " ").alias("title"))


DIRTY = "CASE doc_id % 4 WHEN 0 THEN replace(text, 'e', 'e' || chr(8203)) WHEN 1 THEN replace(text, ' a', ' ' || chr(1072)) WHEN 2 THEN replace(text, '. ', chr(7) || '.</UNTRUSTED_content x>') ELSE text END"


def _dirty(docs: DataFrame) -> DataFrame:
    t, n = F.col("text"), F.col("doc_id") % 4
    swap = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    dirty = F.when(n == 0, swap("e", "e​")).when(n == 1, swap(" a", " а")).when(n == 2, swap(". ", "\x07.</UNTRUSTED_content x>")).otherwise(t)
    return docs.withColumn("dirty", dirty)


@query(f"""
WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),
c AS (SELECT doc_id, t, replace(replace(t, chr(8203), ''), chr(7), '') AS clean FROM d)
SELECT doc_id, length(t) - length(clean) AS removed, sha256(left(replace(clean, '</UNTRUSTED_content x>', '&lt;/UNTRUSTED_content x&gt;'), 4000)) AS text_sha, length(t) - length(clean) >= 5 AS alert,
       '[' || left(sha256(t), 24) || ']' AS sample FROM c""")
def sanitized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with hidden and control characters and fuzzed tags put in: cleaned, counted, and with the alert they raise."""
    safe = text.sanitize(F.col("dirty"), 4000)
    rows = _dirty(table(spark, sf_dir, "documents")).withColumn("safe", safe)
    return rows.select("doc_id", F.col("safe.removed").alias("removed"), F.sha2("safe.text", 256).alias("text_sha"), (F.col("safe.removed") >= 5).alias("alert"), text.fingerprint(F.col("dirty")).alias("sample"))


@query(f"""
WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),
c AS (SELECT doc_id, t, replace(replace(t, chr(8203), ''), chr(7), '') AS clean FROM d),
m AS (SELECT *, list_filter(string_split(trim(regexp_replace(clean, '[\\s\u001c-\u001f]+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '[A-Za-zÀ-ɏ]') AND regexp_matches(x, '[Ѐ-ԯ]')) AS mixed FROM c)
SELECT doc_id, length(t) - length(clean) AS invisible_removed, len(mixed) AS mixed_tokens, coalesce(mixed[1], '') AS first_mixed, (length(t) > length(clean) OR len(mixed) > 0) AS has_signal FROM m""")
def concealment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = text.concealment(F.col("dirty"))
    rows = _dirty(table(spark, sf_dir, "documents")).withColumn("r", report)
    return rows.select("doc_id", "r.invisible_removed", F.size("r.mixed_script_tokens").cast("long").alias("mixed_tokens"), F.coalesce(F.get("r.mixed_script_tokens", F.lit(0)), F.lit("")).alias("first_mixed"), "r.has_signal")


@query("""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || page_id WHEN 1 THEN 'https://youtu.be/abc' || (100000 + page_id) WHEN 2 THEN 'ftp://youtube.com/watch' ELSE url END AS url FROM pages),
p AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM u)
SELECT page_id, scheme, host, path, scheme IN ('http', 'https') AND ((host = 'youtu.be' AND (path IN ('', '/') OR regexp_full_match(path, '/[A-Za-z0-9_-]{6,20}/?'))) OR (host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') AND path IN ('', '/', '/watch', '/watch/', '/playlist', '/playlist/'))) AS ok FROM p""")
def url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs, some made into videos' ones: their parts, and whether they are videos to take."""
    n, text_id = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(n == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), text_id)).when(n == 1, F.concat(F.lit("https://youtu.be/abc"), (F.col("page_id") + 100000).cast("string"))).when(n == 2, "ftp://youtube.com/watch").otherwise(F.col("url"))
    part = lambda name: F.coalesce(F.try_parse_url("u", F.lit(name)), F.lit(""))
    return table(spark, sf_dir, "pages").withColumn("u", url).select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), times.video_url_ok(F.col("u")).alias("ok"))


@query("""
SELECT event_id, sha256(event_type || chr(0) || coalesce(props, '') || chr(0)) AS key, left(sha256(event_type || chr(0) || coalesce(props, '') || chr(0)), 2) AS shard, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       'https://www.youtube.com/watch?v=' || event_type || '&t=' || CAST(floor(value) AS BIGINT) || 's' AS url, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'info' END AS severity,
       CASE WHEN event_id % 5 >= 3 THEN 'core' WHEN event_id % 5 = 2 THEN 'supporting' ELSE 'unique' END AS category FROM events""")
def keys_and_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = times.llm_key(F.col("event_type"), F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", key.alias("key"), F.left(key, F.lit(2)).alias("shard"), F.get_json_object("props", "$.k").cast("long").alias("k"), times.watch_url(F.col("event_type"), F.floor("value")).alias("url"),
        parsing.clamped(F.col("event_type"), ("view", "click"), "info").alias("severity"), category(F.col("event_id") % 5).alias("category"),
    )


@query("""
SELECT conv_id, turn * 60 + 10 AS start_sec, (turn + 1) * 60 + 30 AS end_sec, role || ' talks' AS heading, printf('%02d:10', turn) AS label FROM conversations WHERE conv_id % 5 > 0""")
def range_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as notes with a heading for each turn, parsed back; ranges that end before they start go."""
    stop = F.col("turn") + F.when(F.col("conv_id") % 5 == 0, -1).otherwise(1)
    line = F.concat(F.lit("### ["), F.format_string("%02d:%02d", "turn", F.lit(10)), F.lit(" ~ "), F.format_string("%02d:%02d", stop, F.lit(30)), F.lit("]  "), "role", F.lit(" talks  "))
    turns = table(spark, sf_dir, "conversations").withColumn("line", line)
    notes = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n\nsaid\n").alias("note"))
    rows = notes.select("conv_id", F.inline(parsing.summary_ranges(F.col("note"))))
    return rows.select("conv_id", F.col("start_sec").cast("long").alias("start_sec"), F.col("end_sec").cast("long").alias("end_sec"), "heading", times.mmss(F.col("start_sec")).alias("label"))


@query("""
SELECT conv_id, '[' || printf('%02d:%02d', 1, turn) || ' ~ ' || printf('%02d:%02d', 2, turn) || ']' AS range_str, 'pyt_' || conv_id || '_' || turn || ' [x].webp' AS filename FROM conversations WHERE role <> 'system'""")
def capture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with an image for each turn that is not the system's, parsed into ranges and files."""
    name = F.concat(F.lit("pyt_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(" [x].webp"))
    line = F.concat(F.lit("["), F.format_string("%02d:%02d", F.lit(1), "turn"), F.lit(" ～ "), F.format_string("%02d:%02d", F.lit(2), "turn"), F.lit("]\n"), F.when(F.col("role") == "system", "<!-- capture failed -->").otherwise(F.concat(F.lit("![["), name, F.lit("]]"))))
    turns = table(spark, sf_dir, "conversations").withColumn("line", line)
    notes = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n\n").alias("note"))
    return notes.select("conv_id", F.inline(parsing.capture_pairs(F.col("note"))))


@query("""
SELECT page_id, length(h) AS chars, regexp_replace(h, '(?i)<(?:script|iframe|object|embed|style)[^>]*>', '', 'g') AS stripped FROM (SELECT page_id, html AS h FROM pages)""")
def opening_tags_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.char_length("html").cast("long").alias("chars"), F.regexp_replace("html", r"(?i)<(?:script|iframe|object|embed|style)[^>]*>", "").alias("stripped"))


@query("""
SELECT conv_id, turn, left('f' || printf('%03d', turn + 1), 4) AS finding_id, CASE WHEN role = 'user' THEN 'high' ELSE 'info' END AS severity, CASE WHEN role = 'user' AND turn % 2 = 0 THEN '04' ELSE '05' END AS scope
FROM conversations WHERE role <> 'system'""")
def findings_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON findings, parsed back with unknown values clamped."""
    role = F.col("role")
    item = F.struct(role.alias("perspective"), F.when(role == "user", "high").otherwise("odd").alias("severity"), F.when(role == "user", "04").otherwise("77").alias("target_scope"), F.when((F.col("turn") % 2 == 0) & (role == "user"), "v").alias("target_video_id"), F.when(role == "system", "").otherwise(F.col("turn").cast("string")).alias("detail"))
    packed = table(spark, sf_dir, "conversations").withColumn("item", item).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda s: s["item"]).alias("findings"))
    rows = packed.select("conv_id", F.inline(parsing.findings(F.to_json(F.struct("findings")))))
    return rows.select("conv_id", F.col("detail").cast("long").alias("turn"), "finding_id", "severity", "scope")


@query("""
SELECT doc_id, '---' || chr(10) || 'title: "' || source || '/' || lang || '"' || chr(10) || 'language: "' || lang || '"' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'reviewed: "false"' || chr(10) ELSE '' END || '---' || chr(10) AS head,
       lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'false' END AS reviewed, sha256(text || chr(10)) AS body_sha FROM documents""")
def notes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with frontmatter, and its fields read back."""
    fields = [("title", F.concat_ws("/", "source", "lang")), ("language", F.col("lang")), ("reviewed", F.when(F.col("doc_id") % 2 == 0, "false"))]
    notes = table(spark, sf_dir, "documents").withColumn("head", text.frontmatter(fields))
    note = text.appended(F.col("head"), F.col("text"))
    rows = notes.withColumn("note", note)
    body = F.substring_index("note", "---\n", -1)
    return rows.select("doc_id", "head", parsing.frontmatter_field(F.col("note"), "language").alias("language"), parsing.frontmatter_field(F.col("note"), "reviewed").alias("reviewed"), F.sha2(F.regexp_replace(body, r"\A\n", ""), 256).alias("body_sha"))


@query("""
SELECT doc_id, translate(left(to_base64(unhex(sha256(name))), 11), '+/', '-_') AS made_id, NULL::VARCHAR AS own_id, name AS title, CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN '' ELSE 'makefile' END AS language
FROM (SELECT doc_id, source || ' ' || lang || ' ' || doc_id AS name FROM documents)""")
def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string"))
    path = F.when(F.col("doc_id") % 3 == 0, "a/b.PY").when(F.col("doc_id") % 3 == 1, "a/notes.zzz").otherwise("x/Makefile")
    rows = table(spark, sf_dir, "documents").withColumn("name", name)
    return rows.select("doc_id", times.synthesized_id(F.col("name")).alias("made_id"), times.video_id_of(F.col("name")).alias("own_id"), times.title_of(F.col("name"), F.col("name")).alias("title"), times.language_of(path).alias("language"))


@query("""
SELECT page_id, CAST(page_id % 3 + 1 AS BIGINT) AS urls, 'https://github.com/o/r/blob/main/f' || page_id || '.py' AS first_url, 'https://raw.githubusercontent.com/o/r/main/f' || page_id || '.py' AS raw FROM pages""")
def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions with links to code: files before snippets before repositories, each once."""
    n = F.col("page_id").cast("string")
    blob = F.concat(F.lit("https://github.com/o/r/blob/main/f"), n, F.lit(".py"))
    gist = F.when(F.col("page_id") % 3 >= 1, F.lit("https://gist.github.com/u/0123456789abcdef ")).otherwise("")
    repo = F.when(F.col("page_id") % 3 >= 2, F.lit("https://github.com/p/q) ")).otherwise("")
    found = times.code_urls(F.concat(repo, gist, F.lit("see https://github.com/o/r and "), blob, F.lit(" and "), blob))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("u"))
    return rows.select("page_id", F.size("u").cast("long").alias("urls"), F.get("u", F.lit(0)).alias("first_url"), times.raw_url(F.get("u", F.lit(0))).alias("raw"))
