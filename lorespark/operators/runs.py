"""Gates, lookups and set checks between the stages of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import parsing

from .rollups import first_rows


def succeeded(error: Column, body: Column) -> Column:
    """Whether a run has a body and no error."""
    return error.isNull() & body.isNotNull()


def large_enough(runs: DataFrame, key: str, ok: Column, least: int = 3) -> DataFrame:
    """Keys with at least ``least`` runs that are ok, and how many those are."""
    return runs.groupBy(key).agg(F.count_if(ok).alias("n")).filter(F.col("n") >= least)


def union_of_runs(skipped: DataFrame, processed: DataFrame, key: str = "video_id") -> DataFrame:
    """Runs taken over and runs made now; a run made now stands for its key."""
    return processed.unionByName(skipped.join(processed.select(key), key, "left_anti"), allowMissingColumns=True)


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, both, then the columns of both): rows of one key side by side; ``both`` is false where a side lacks it."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    joined = a.join(b, key, "full")
    return joined.withColumn("both", F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")


def reviewed_notes(notes: DataFrame, folders: DataFrame, *, content: str = "content") -> DataFrame:
    """For each video its best note that says ``reviewed: true``: by the rank of its folder, then by name.

    ``notes``: folder, filename, content; ``folders``: name and rank, as :func:`lorespark.sources.readers.candidate_folders` gives them.
    Notes are filtered before they are ranked, so a newer note that nobody reviewed hides no older one.
    """
    marked = notes.withColumn("video_id", parsing.trusted_video_id(F.col(content))).filter("video_id is not null")
    marked = marked.filter(F.lower(parsing.frontmatter_field(F.col(content), "reviewed")) == "true")
    ranked = marked.join(folders.select(F.col("name").alias("folder"), "rank"), "folder")
    return first_rows(ranked, ["video_id"], ["rank", "filename"])


def pinned_siblings(reviewed: DataFrame, notes: DataFrame, *, content: str = "content") -> DataFrame:
    """(video_id, folder, sibling): the note of the same video in the same folder, null where that folder has none."""
    other = notes.withColumn("video_id", parsing.trusted_video_id(F.col(content))).filter("video_id is not null")
    other = other.groupBy("video_id", "folder").agg(F.min("filename").alias("sibling"))
    return reviewed.select("video_id", "folder").join(other, ["video_id", "folder"], "left")


def routed(findings: DataFrame, scope: str) -> DataFrame:
    """The blocking findings of one scope."""
    return findings.filter((F.col("severity") == "high") & (F.col("scope") == scope))


def targets(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, video_ids): the distinct videos that findings of scope 04 name, sorted."""
    named = findings.filter("scope = '04' and video_id is not null").select(*keys, "video_id").distinct()
    return named.groupBy(*keys).agg(F.array_sort(F.collect_list("video_id")).alias("video_ids"))


def left_over(known: DataFrame, steps: DataFrame, unassigned: DataFrame, keys: Sequence[str], insight: str = "insight_id") -> DataFrame:
    """(keys, insight): the known insights that are neither in a step nor listed as unassigned."""
    on = [*keys, insight]
    return known.select(*on).distinct().join(steps.select(*on).unionByName(unassigned.select(*on)), on, "left_anti")


def orphans(stems: DataFrame, overviews: DataFrame, key: str, stem: str, body: str) -> DataFrame:
    """(key, stem): the written notes that their overview does not link to; without an overview all are."""
    linked = overviews.select(key, F.explode(F.regexp_extract_all(F.col(body), F.lit(r"\[\[((?:(?!\]\]).)*)\]\]"), F.lit(1))).alias(stem))
    return stems.select(key, stem).distinct().join(linked, [key, stem], "left_anti")


def label_rewrites(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys but the last, old, new): link targets ``NN_label`` of chapters whose label has changed; the last key is the chapter's index."""
    link = lambda label: F.format_string("%02d_%s", F.col(keys[-1]), label)
    both = before.select(*keys, F.col("label").alias("_old")).join(after.select(*keys, F.col("label").alias("_new")), list(keys))
    return both.filter("_old <> _new").select(*keys[:-1], link(F.col("_old")).alias("old"), link(F.col("_new")).alias("new"))


def step_embeds(outcomes: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, index, embed): the image captured at a step's position; failed captures leave their step without one.

    ``outcomes``: keys, pos, folder, image; ``steps``: keys, pos, index.
    """
    named = outcomes.filter("image is not null").select(*keys, "pos", F.concat_ws("/", "folder", "image").alias("embed"))
    return steps.select(*keys, "pos", "index").join(named, [*keys, "pos"]).select(*keys, "index", "embed")


def insight_links(insights: DataFrame, steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``insights`` with ``link``: that of the step which names the insight; null without one.

    ``steps``: keys, index, insight_ids, link; of several steps the last one counts.
    """
    named = steps.select(*keys, "index", "link", F.explode("insight_ids").alias("insight_id"))
    chosen = named.groupBy(*keys, "insight_id").agg(F.max_by("link", "index").alias("link"))
    return insights.join(chosen, [*keys, "insight_id"], "left")
