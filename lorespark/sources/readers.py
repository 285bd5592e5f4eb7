"""Readers of notes, sheets, glossaries and media folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions import parsing, text, times
from lorespark.operators.rollups import first_rows
from lorespark.operators.sequences import filled_forward
from lorespark.schemas import GLOSSARY


def parse_glossary(content: str) -> list[tuple]:
    """Entries of a glossary file; any unknown key, wrong type or blank term is an error."""
    data = json.loads(content)
    if not isinstance(data, dict) or set(data) - {"version", "entries"}:
        raise ValueError("a glossary is an object of version and entries")
    if type(data.get("version", 1)) is not int or not isinstance(data.get("entries"), list):
        raise ValueError("version must be an integer and entries a list")
    out = []
    for i, entry in enumerate(data["entries"]):
        if not isinstance(entry, dict) or set(entry) - {"canonical", "aliases", "reading", "category"}:
            raise ValueError(f"entry {i} has unknown keys")
        terms = [entry.get("canonical"), *entry.get("aliases", [])]
        if not all(isinstance(t, str) and t.strip() for t in terms) or not isinstance(entry.get("aliases", []), list):
            raise ValueError(f"entry {i} has a blank term")
        out.append((i, terms[0], terms[1:], entry.get("reading", ""), entry.get("category", "")))
    return out


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A glossary file (small: one document) as a table of ``GLOSSARY``."""
    row = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse_glossary(row["value"]), GLOSSARY)


def noun_sheets(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Rows of tab-separated sheets: ``## [id] title`` opens a section, rows before one and comments go.

    (key, section_pos, video_id, title, row_pos, system_term, user_correction)
    """
    lines = files.select(key, F.posexplode(F.split(content, r"\r?\n")).alias("row_pos", "line"))
    head = r"\A##\s*\[([^\]]*)\]\s*(.*)\z"
    is_head = F.col("line").rlike(head)
    lines = lines.withColumns({"head": F.when(is_head, F.col("line")), "section_pos": F.sum(is_head.cast("int")).over(W.partitionBy(key).orderBy("row_pos")) - 1})
    rows = filled_forward(lines, [key], ["row_pos"], "head").filter(~F.col("line").startswith("#") & (F.trim("line") != "") & F.col("head").isNotNull())
    left = text.strip_space(F.substring_index("line", "\t", 1))
    right = F.when(F.col("line").contains("\t"), text.strip_space(F.expr("substring(line, locate('\t', line) + 1)"))).otherwise("")
    out = rows.select(key, "section_pos", F.regexp_extract("head", head, 1).alias("video_id"), F.regexp_extract("head", head, 2).alias("title"), "row_pos", left.alias("system_term"), right.alias("user_correction"))
    return out.filter("system_term <> ''")


def local_media(files: DataFrame, path: str = "path") -> DataFrame:
    """Videos of a folder listing by name: the id from the name or made from it, the first of each id."""
    name = F.element_at(F.split(path, "/"), -1)
    listed = files.withColumn("name", name).filter(F.col("name").rlike(rf"(?i)\.{times.EXTENSION}\z"))
    stem = F.regexp_replace("name", r"\.[^.]+\z", "")
    named = listed.withColumn("video_id", F.coalesce(times.video_id_of(stem), times.synthesized_id(F.col("name"))))
    named = named.withColumn("title", times.title_of(stem, F.col("video_id")))
    return first_rows(named, ["video_id"], ["name"]).select("video_id", "title", "name", path)


def trusted_notes(notes: DataFrame, content: str = "content") -> DataFrame:
    """``notes`` with the id their frontmatter proves and their body; others go."""
    found = notes.withColumn("video_id", parsing.trusted_video_id(F.col(content)))
    return found.filter("video_id is not null").withColumn("body", text.without_frontmatter(F.col(content)))


def existing_bodies(notes: DataFrame, videos: DataFrame) -> DataFrame:
    """Bodies of notes for ``videos`` in the order of those (``pos``): of several notes the last by name; empty ones go."""
    latest = trusted_notes(notes).groupBy("video_id").agg(F.max_by("body", "filename").alias("body"))
    return videos.select("pos", "video_id").join(latest, "video_id").filter("body <> ''").orderBy("pos")


def candidate_folders(folders: DataFrame, unit_date: str, canonical: str, title: str, name: str = "name") -> DataFrame:
    """Dated folders that may hold a unit, best first: the canonical one, the same day's by title, older ones of exactly the title.

    Later days, and names whose date does not exist, do not count.
    """
    day = F.regexp_extract(name, r"\A(\d{4}-\d{2}-\d{2})(?:-\d{4})?(?:\s|\z)", 1)
    dated = folders.withColumn("day", F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")).filter("day is not null")
    rest = F.trim(F.regexp_replace(name, r"\A\d{4}-\d{2}-\d{2}(?:-\d{4})?", ""))
    wanted = F.to_date(F.lit(unit_date))
    tier = F.when(F.col(name) == canonical, 0).when((F.col("day") == wanted) & rest.contains(title), 1).when((F.col("day") < wanted) & (rest == title), 2)
    return dated.withColumn("tier", tier).filter("tier is not null").withColumn("rank", F.row_number().over(W.orderBy("tier", F.desc(name)))).orderBy("rank")


def resolved_folder(folders: DataFrame, unit_date: str, canonical: str, title: str, name: str = "name", modified: str = "modified") -> DataFrame:
    """The folder of a unit: the canonical one, else of the same day's whose title holds ``title`` the one modified last; no row if there is none."""
    found = candidate_folders(folders, unit_date, canonical, title, name).filter("tier <= 1")
    return found.orderBy("tier", F.desc(modified), F.desc(name)).limit(1).drop("day", "tier", "rank")


def collected_bodies(files: DataFrame, folder: str, videos: DataFrame) -> DataFrame:
    """Bodies of the notes in ``folder`` for ``videos``, as :func:`existing_bodies`; ``files`` as the data source of notes reads them, to which the folder is pushed."""
    return existing_bodies(files.filter(F.col("folder") == folder), videos)


def playlist_videos(extracts: DataFrame) -> DataFrame:
    """Videos of extracted playlists or single videos, as rows of ``VIDEOS`` with the playlist's position; entries without an id go.

    ``extracts``: playlist_title, and entries, an array of struct(id, title, url, duration, channel, uploader, upload_date). Titles stay as they are.
    """
    rows = extracts.select("playlist_title", F.posexplode("entries").alias("pos", "e")).filter(F.coalesce("e.id", F.lit("")) != "")
    url = F.coalesce(F.nullif(F.col("e.url"), F.lit("")), times.watch_url(F.col("e.id")))
    channel = F.coalesce(F.nullif(F.col("e.channel"), F.lit("")), F.col("e.uploader"))
    title = F.coalesce("e.title", F.lit(""))
    return rows.select("pos", F.col("e.id").alias("video_id"), title.alias("title"), url.alias("url"), F.col("e.duration").cast("int").alias("duration"), channel.alias("channel"), F.col("e.upload_date").alias("upload_date"), "playlist_title")


def video_chapters(details: DataFrame, chapters: str = "chapters") -> DataFrame:
    """(video_id, pos, title, start_seconds) of the chapters in a JSON list; one that is malformed goes, the others stay."""
    listed = F.try_variant_get(F.try_parse_json(chapters), "$", "array<variant>")
    rows = details.select("video_id", F.posexplode(listed).alias("pos", "c")).filter(F.schema_of_variant("c").startswith("OBJECT"))
    begin = F.try_variant_get("c", "$.start_time", "variant")
    number = F.when(begin.isNull() | (F.schema_of_variant(begin) == "VOID"), F.lit(0.0)).otherwise(F.try_variant_get("c", "$.start_time", "string").try_cast("double"))
    named = rows.select("video_id", "pos", text.strip_space(F.try_variant_get("c", "$.title", "string")).alias("title"), number.alias("start_seconds"))
    return named.filter("title <> '' and start_seconds is not null and not isnan(start_seconds)")
