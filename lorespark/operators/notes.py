"""Notes and reports as rows of (path, content), ready to be written as files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import blocks, notes, times

from .sequences import unique_paths

#: Fixed values of the note format: folders of the units that get a note before there is anything to say.
PLACEHOLDERS = {"scripts": "01_Scripts_Processing_Unit", "summary": "02_Summary_Processing_Unit", "capture": "03_Capture_Processing_Unit"}


def placeholder_notes(videos: DataFrame, ran_at: Column, base: str, units: Mapping[str, str] = PLACEHOLDERS) -> DataFrame:
    """(video_id, unit, path, content): a note of frontmatter alone for each video (pos, video_id, title, playlist_title) and unit; summaries wait for review.

    Names that meet in a folder are numbered.
    """
    # Names are the same in every unit, so they are numbered once; few and short rows of videos are dealt to all cores before they grow.
    dealt = videos.repartition(4 * videos.sparkSession.sparkContext.defaultParallelism, "video_id")
    named = unique_paths(dealt.withColumns({"_folder": times.folder_name(ran_at, F.col("playlist_title")), "_base": times.note_base(ran_at, F.col("title"))}), "_folder", "_base", ["pos", "video_id"], "md")
    spread = named.withColumn("unit", F.explode(F.array(*[F.lit(u) for u in units])))
    extra = {"playlist": F.coalesce("playlist_title", F.lit("")), "video_id": F.col("video_id"), "reviewed": F.when(F.col("unit") == "summary", "false")}
    head = notes.note_head(ran_at, F.col("title"), times.watch_url(F.col("video_id")), extra=extra)
    place = F.concat_ws("/", F.lit(base), F.element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), F.col("unit")), "path")
    return spread.select("video_id", "unit", place.alias("path"), head.alias("content"))


def materials(videos: DataFrame, bodies: DataFrame, group: str = "playlist", budget: int = blocks.MATERIALS) -> DataFrame:
    """(group, content): the parts of a group's videos (group, pos, video_id, title) with their ``bodies`` (group, pos, body), zipped by position.

    Every video shares the budget of characters evenly. A group whose numbers of videos and bodies differ is an error.
    """
    sizes = [t.groupBy(group).agg(F.count("*").alias(n)) for t, n in ((videos, "_videos"), (bodies, "_bodies"))]
    counts = sizes[0].join(sizes[1], group, "full")
    differ = F.coalesce("_videos", F.lit(0)) != F.coalesce("_bodies", F.lit(0))
    counts = counts.withColumn("_videos", F.when(differ, F.raise_error(F.concat(F.lit("numbers of videos and bodies differ: "), group))).otherwise(F.col("_videos")))
    both = zipped_by_position(videos, bodies, group).join(counts.select(group, "_videos"), group)
    part = blocks.material(F.col("video_id"), F.col("title"), F.col("body"), F.floor(F.lit(budget) / F.col("_videos")).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", part.alias("part")))), lambda s: s["part"])
    return both.groupBy(group).agg(F.array_join(ordered, "\n\n---\n\n").alias("content"))


def zipped_by_position(videos: DataFrame, bodies: DataFrame, group: str) -> DataFrame:
    """The first video of a group with its first body, and so on, whatever their ``pos`` are."""
    from .scans import running

    left = running(videos, [group], ["pos", "video_id"], {"_place": ("number", None)}).drop("pos")
    right = running(bodies, [group], ["pos", "body"], {"_place": ("number", None)}).select(group, "_place", "body")
    return left.join(right, [group, "_place"])


def synthesis_meta(plans: DataFrame, folder: str = "folder") -> DataFrame:
    """(path, content): the JSON of each synthesis: profile, topics, chapters, coverage, the reviewer's status and, if any, what it says (reviewer)."""
    pick = lambda items, *fields: F.transform(items, lambda t: F.struct(*[t[f].alias(f) for f in fields]))
    topics = pick(F.col("topics"), "topic_id", "label", "aliases", "source_videos", "duplication_count", "category", "summary")
    chapters = pick(F.col("chapters"), "index", "label", "category", "topic_ids")
    coverage = F.struct("covered_topic_ids", "missing_topic_ids")
    plain = F.struct("profile", topics.alias("topics"), chapters.alias("chapters"), coverage.alias("coverage"), "reviewer_status")
    reviewed = F.struct("profile", topics.alias("topics"), chapters.alias("chapters"), coverage.alias("coverage"), "reviewer_status", "reviewer")
    content = F.when(F.col("reviewer").isNull(), blocks.json_text(plain)).otherwise(blocks.json_text(reviewed))
    return plans.select(F.concat(folder, F.lit("/_meta/duplicate_score.json")).alias("path"), content.alias("content"))


#: What a finding is in reports.
FINDING = ("finding_id", "perspective", "severity", "target_scope", "target_video_id", "topic_ids", "chapter_index", "description", "suggested_fix")
PERSPECTIVES = ("coverage", "pedagogy", "fidelity")


def evaluation_loops(iterations: DataFrame, findings: DataFrame, folder: str = "folder") -> DataFrame:
    """(path, content): a JSON for each loop of an evaluation.

    ``iterations``: folder, iteration, summaries (map by perspective), regenerated_video_ids, synthesis_rerun, stopped, stop_reason; ``findings``: folder, iteration and ``FINDING``.
    """
    keys = [folder, "iteration"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("finding_id", F.struct(*FINDING).alias("f")))), lambda s: s["f"])
    both = iterations.join(findings.groupBy(*keys).agg(listed.alias("_all"), F.count_if(F.col("severity") == "high").alias("_blocking")), keys, "left")
    of = lambda p: F.struct(F.coalesce(F.try_element_at("summaries", F.lit(p)), F.lit("")).alias("summary"), F.coalesce(F.filter("_all", lambda f: f["perspective"] == p), F.array()).alias("findings")).alias(p)
    payload = F.struct("iteration", F.struct(*map(of, PERSPECTIVES)).alias("perspectives"), F.coalesce("_blocking", F.lit(0)).alias("blocking_count"), "regenerated_video_ids", "synthesis_rerun", "stopped", "stop_reason")
    return both.select(F.format_string("%s/_meta/evaluation/loop_%d.json", folder, "iteration").alias("path"), blocks.json_text(payload).alias("content"))


def evaluation_summaries(iterations: DataFrame, findings: DataFrame, folder: str = "folder") -> DataFrame:
    """(path, content): for each evaluation a note of its loops, what they found and redid, and every finding that blocks."""
    keys = [folder, "iteration"]
    target = F.coalesce(F.nullif(F.col("target_video_id"), F.lit("")), F.col("target_scope"))
    line = F.when(F.col("severity") == "high", F.concat(F.lit("\n  - ["), "perspective", F.lit("] "), "description", F.lit(" (→ "), target, F.lit(")")))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("finding_id", line.alias("line"))))), lambda s: s["line"]), "")
    counts = [F.count_if(F.col("perspective") == p).cast("string").alias(p) for p in PERSPECTIVES]
    found = findings.groupBy(*keys).agg(F.count("*").cast("string").alias("_n"), F.count_if(F.col("severity") == "high").cast("string").alias("_high"), ordered.alias("_lines"), *counts)
    both = iterations.join(found, keys, "left")
    n = lambda c: F.coalesce(c, F.lit("0"))
    redone = F.when(F.size("regenerated_video_ids") > 0, F.concat(F.lit("\n- 04 再生成: "), F.array_join("regenerated_video_ids", ", "))).otherwise("")
    why = F.when(F.coalesce("stop_reason", F.lit("")) != "", F.concat(F.lit("\n- 停止理由: "), "stop_reason")).otherwise("")
    block = F.concat(
        F.lit("\n\n## ループ "), F.col("iteration").cast("string"), F.lit("\n- blocking(high): "), n("_high"), F.lit(" / 全 finding: "), n("_n"),
        F.lit("\n- coverage: "), n("coverage"), F.lit(" / pedagogy: "), n("pedagogy"), F.lit(" / fidelity: "), n("fidelity"), redone,
        F.lit("\n- 05 再合成: "), F.when(F.col("synthesis_rerun"), "あり").otherwise("なし"), why, F.coalesce("_lines", F.lit("")),
    )
    loops = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("iteration", block.alias("b")))), lambda s: s["b"]), "")
    out = both.groupBy(folder).agg(F.concat(F.lit("# 評価サマリ\n\n- ループ実行回数: "), F.count("*").cast("string"), loops, F.lit("\n")).alias("content"))
    return out.select(F.concat(folder, F.lit("/_meta/evaluation/summary.md")).alias("path"), "content")


def step_notes(steps: DataFrame, ran_at: Column) -> DataFrame:
    """(path, content): a note for each step (folder, filename, video_id, index, label, start_sec, end_sec, embed, body, insights).

    A line with the step's range comes first, then the clip if there is one, then the body; an insight (label, start_sec, summary, quote) whose bracketed time the body lacks follows it.
    """
    url = F.concat(times.watch_url(F.col("video_id")), F.lit("&t="), F.col("start_sec").cast("string"))
    missing = F.filter("insights", lambda i: ~notes.woven_in(F.col("body"), i["start_sec"]))
    added = F.transform(missing, lambda i: notes.callout(i["label"], i["start_sec"], i["summary"], i["quote"]))
    body = F.concat_ws("\n\n", F.when(F.size(added) > 0, F.regexp_replace("body", r"\s+\z", "")).otherwise(F.col("body")), F.when(F.size(added) > 0, F.array_join(added, "\n\n")))
    line = F.concat(F.lit("["), times.hms(F.col("start_sec")), F.lit(" 〜 "), times.hms(F.col("end_sec")), F.lit("]("), url, F.lit(")"))
    embed = F.when(F.coalesce("embed", F.lit("")) != "", F.concat(F.lit("![["), "embed", F.lit("]]")))
    head = notes.note_head(ran_at, F.col("label"), url, tags=("memo", "youtube", "handson"), extra={"video_id": F.col("video_id"), "chapter": F.col("index").cast("string"), "category": F.lit("handson-step")})
    return steps.select(F.concat_ws("/", "folder", "filename").alias("path"), blocks.note_file(head, F.concat_ws("\n\n", line, embed, body)).alias("content"))
