"""Operators over groups: totals, merges, coverage, deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions.python import each
from lorespark.functions.text import collapse, strip_space
from lorespark.functions.variants import Variants

from .scans import numbered


def category(count: Column) -> Column:
    return F.when(count >= 3, "core").when(count == 2, "supporting").otherwise("unique")


def first_rows(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each distinct key: the first in order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def cost_breakdown(runs: DataFrame, stages: Sequence[tuple[str, str, str]], position: str) -> DataFrame:
    """(stage, cost, model) for each (label, cost column, model column), and a ``total`` row.

    Null costs do not count, a stage without any has no row, and the model is that of the
    first row that counts, ``?`` if null.
    """
    parts = F.array(*[F.struct(F.lit(label).alias("stage"), F.col(cost).alias("cost"), F.col(model).alias("model")) for label, cost, model in stages])
    long = runs.select(position, F.inline(parts)).filter("cost is not null")
    first = F.min_by(F.coalesce("model", F.lit("?")), position)
    out = long.rollup("stage").agg(F.sum("cost").alias("cost"), first.alias("model"), F.grouping("stage").alias("_all"))
    every = F.col("_all") == 1
    return out.filter("cost is not null").select(F.when(every, "total").otherwise(F.col("stage")).alias("stage"), "cost", F.when(~every, F.col("model")).alias("model"))


def run_totals(runs: DataFrame, keys: Sequence[str], ok: Column, kinds: Mapping[str, Column], seconds: Column) -> DataFrame:
    """Of each key: runs that succeeded and that failed, how many are of each kind (name: condition), and whole minutes; unknown durations count as 0.

    A run that is not known to have succeeded has failed.
    """
    fine = F.coalesce(ok, F.lit(False))
    counts = [F.count_if(fine).alias("succeeded"), F.count_if(~fine).alias("failed"), *[F.count_if(c).alias(name) for name, c in kinds.items()]]
    return runs.groupBy(*keys).agg(*counts, F.floor(F.sum(F.coalesce(seconds, F.lit(0))) / 60).alias("minutes"))


def first_of_each_text(rows: DataFrame, text: Column, order: Column | str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the first row, in ``order``, of each different ``text``; what is shuffled is the digest of a text, never the text, and tasks reduce their rows first."""
    keyed = rows.select(F.sha2(text, 256).alias("_digest"), F.struct(order).alias("_at"), F.struct(*columns).alias("_row"))
    return keyed.groupBy("_digest").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def call_totals(calls: DataFrame, keys: Sequence[str], counters: Sequence[str], order: str, text: str) -> DataFrame:
    """Retries of a call as one: null where all are null, else the sum of the others; the text of the last."""
    sums = [F.sum(c).alias(c) for c in counters]
    return calls.groupBy(*keys).agg(*sums, F.max_by(text, order).alias(text), F.count("*").alias("attempts"))


def merged_topics(topics: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row for each label without regard to case and outer space: the first spelling, what all its topics hold, and a new ``topic_id`` by first appearance.

    ``topics`` has label, aliases, source_videos, excerpts (arrays) and summary. The aliases are those of the first topic as they are, then others by
    first appearance; sources are counted once each; excerpts of all topics follow each other; the summary is the first that is not empty. Null lists are
    empty. Aliases and sources are reduced to their first appearance before they are collected.
    """
    lists = ("aliases", "source_videos", "excerpts")
    at = F.struct(*order)
    keyed = topics.withColumns({c: F.coalesce(c, F.array().cast(topics.schema[c].dataType)) for c in lists})
    keyed = keyed.withColumns({"_key": F.lower(strip_space(F.col("label"))), "_at": at}).filter("_key <> ''")
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("excerpts") > 0, F.struct("_at", "excerpts")))), lambda s: s["excerpts"]))
    out = keyed.groupBy("_key").agg(
        F.min("_at").alias("_first"), F.min_by("label", "_at").alias("label"), F.min_by("aliases", "_at").alias("_own"),
        F.min_by("summary", F.when(F.col("summary") != "", F.col("_at"))).alias("summary"), said.alias("excerpts"),
    )

    def listed(column: str) -> DataFrame:
        spread = keyed.select("_key", "_at", F.posexplode(column).alias("_place", "_value"))
        firsts = spread.groupBy("_key", "_value").agg(F.min(F.struct("_at", "_place")).alias("_met"))
        return firsts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_met", "_value"))).alias(f"_{column}"))

    none = {c: F.array().cast(topics.schema[c].dataType) for c in lists}
    values = lambda met: F.transform(met, lambda s: s["_value"])
    out = out.join(listed("source_videos"), "_key", "left").join(listed("aliases"), "_key", "left")
    later = values(F.filter("_aliases", lambda s: s["_met"]["_at"] > F.col("_first")))
    out = out.withColumns({"aliases": F.concat("_own", F.coalesce(later, none["aliases"])), "source_videos": F.coalesce(values(F.col("_source_videos")), none["source_videos"])})
    n = F.size("source_videos")
    return numbered(out, ["_first"], "_number").select(
        F.format_string("t%03d", "_number").alias("topic_id"), "label", "aliases", "source_videos", n.cast("long").alias("duplication_count"), category(n).alias("category"),
        F.coalesce("summary", F.lit("")).alias("summary"), "excerpts",
    )


def coverage(known: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(key, covered): which of the known keys are used; used keys that are not known do not count."""
    seen = used.select(key).distinct().withColumn("_used", F.lit(True))
    return known.select(key).distinct().join(seen, key, "left").select(key, F.coalesce("_used", F.lit(False)).alias("covered"))


def known_pairs(rows: DataFrame, key: Column, corrected: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """One row a key: its first, unless a later one is the first corrected; ``first_seen`` is the order of the key's first row."""
    best = F.min_by(F.struct(*columns), F.struct((~corrected).cast("int"), F.col(order)))
    return rows.withColumn("fold_key", key).groupBy("fold_key").agg(F.min(order).alias("first_seen"), best.alias("_row")).select("fold_key", "first_seen", "_row.*")


def fidelity(texts: DataFrame, key: str, text: str, glossary: Sequence[tuple[str, Sequence[str]]], most: int) -> DataFrame:
    """Spellings of glossary terms that differ from the canonical one, by text and term.

    One row for each text and canonical term that it misspells: the spellings in order of
    first appearance joined by ``、``, at most ``most`` terms a text in order of first appearance.
    Spellings are told apart by their fold (NFKC, then case); one that two terms have is an error.
    Every text is read once, by an automaton of all spellings, and nothing is shuffled.
    """
    variants = Variants(glossary)

    def terms(t: str) -> list[dict]:
        found: dict[str, dict[str, None]] = {}
        for start, end, canonical in variants.find(t):
            found.setdefault(canonical, {})[t[start:end]] = None
        return [{"canonical": c, "surfaces": "、".join(s), "rank": k} for k, (c, s) in enumerate(found.items(), 1)][:most]

    return texts.select(key, F.inline(each(terms, "array<struct<canonical:string,surfaces:string,rank:bigint>>", F.col(text))))


def finding_ids(found: DataFrame, order: Sequence[str]) -> DataFrame:
    """``found`` with ``finding_id``: f001, f002, ... over all rows in ``order``, which must be total; ``found`` is evaluated once."""
    return numbered(found, order, "_number").withColumn("finding_id", F.format_string("f%03d", "_number")).drop("_number")


def preflight(bodies: DataFrame, group: str, text: str, budget: int) -> DataFrame:
    """Characters of a group's bodies, the share of ``budget`` for each, and how many that share cuts."""
    counted = bodies.select(group, F.char_length(text).cast("long").alias("_n")).withColumn("_limit", F.floor(F.lit(budget) / F.count("*").over(W.partitionBy(group))))
    return counted.groupBy(group).agg(F.count("*").alias("bodies"), F.sum("_n").alias("chars"), F.max("_limit").alias("body_limit"), F.count_if(F.col("_n") > F.col("_limit")).alias("cut"))


def corrections_applied(chunks: DataFrame, corrections: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``chunks`` with corrected texts where there is a correction that is not empty."""
    fixed = corrections.select(*keys, F.nullif(F.col(text), F.lit("")).alias("_fixed"))
    return chunks.join(fixed, list(keys), "left").withColumn(text, F.coalesce("_fixed", text)).drop("_fixed")


def remaining(videos: DataFrame, completed: DataFrame, forced: DataFrame, key: str) -> DataFrame:
    """The videos still to do: those not completed, and those forced."""
    done = completed.select(key).distinct().join(forced.select(key), key, "left_anti")
    return videos.join(done, key, "left_anti")


def cached_or_computed(requests: DataFrame, cache: DataFrame, key: str, value: str, compute) -> DataFrame:
    """(key, value, hit): from the cache where the key is there; ``compute`` sees the other requests only."""
    hits = requests.join(cache.select(key, value).dropDuplicates([key]), key).select(key, value, F.lit(True).alias("hit"))
    misses = compute(requests.join(cache.select(key), key, "left_anti")).select(key, value, F.lit(False).alias("hit"))
    return hits.unionByName(misses)


def term_dedup(rows: DataFrame, keys: Sequence[str], term: str, order: str) -> DataFrame:
    """Terms of each key without outer space, each once, in order of first appearance; blank ones go."""
    clean = rows.withColumn(term, collapse(F.col(term))).filter(F.col(term) != "")
    return first_rows(clean, [*keys, term], [order])
