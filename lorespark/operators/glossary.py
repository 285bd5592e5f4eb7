"""Glossaries and sheets of proper nouns: corrections as entries, new terms into sheets, merges of glossaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions.python import fold_term
from lorespark.functions.text import strip_space
from lorespark.shared import drop, store

from .rollups import first_rows
from .scans import running

ENTRIES = "entry_pos int, canonical string, aliases array<string>, reading string, category string"


def user_corrected(correction_key: Column, system_key: Column) -> Column:
    """Whether a row's correction, by the folds of both terms, is one: not empty, and another term than the system's."""
    return F.coalesce((correction_key != "") & (correction_key != system_key), F.lit(False))


def correction_entries(sheet: DataFrame, key: str = "path") -> DataFrame:
    """(key, entry_pos, canonical, aliases): users' corrections of a sheet as glossary entries.

    Corrections of one fold are one entry under the first spelling; its aliases are the
    system's terms, one of each fold, but for the entry's own, in order.
    """
    rows = sheet.withColumns({"_correction": fold_term(F.col("user_correction")), "_system": fold_term(F.col("system_term"))})
    rows = rows.filter(user_corrected(F.col("_correction"), F.col("_system"))).withColumn("_at", F.struct("section_pos", "row_pos"))
    entries = rows.groupBy(key, "_correction").agg(F.min("_at").alias("_first"), F.min_by("user_correction", "_at").alias("canonical"))
    aliases = rows.filter("_system <> ''").groupBy(key, "_correction", "_system").agg(F.min("_at").alias("_at"), F.min_by("system_term", "_at").alias("_term"))
    aliases = aliases.groupBy(key, "_correction").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_term"))), lambda s: s["_term"]).alias("aliases"))
    place = F.row_number().over(W.partitionBy(key).orderBy("_first")) - 1
    out = entries.join(aliases, [key, "_correction"], "left")
    return out.select(key, place.alias("entry_pos"), "canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def upserted_terms(sheet: DataFrame, terms: DataFrame, key: str = "path") -> DataFrame:
    """``sheet`` (key, section_pos, video_id, title, row_pos, system_term, user_correction) with new ``terms`` (key, video_id, title, pos, term).

    A video's rows are those of its first section, then its new terms, one of each fold,
    without a correction. Every section of the video gets these rows and the new title; a
    video without a section gets one after all others, in order of ids.
    """
    columns = [key, "section_pos", "video_id", "title", "row_pos", "system_term", "user_correction"]
    videos = terms.groupBy(key, "video_id").agg(F.max_by("title", "pos").alias("_title"))
    own = sheet.join(videos.drop("_title"), [key, "video_id"], "left_semi")
    sections = own.select(key, "video_id", "section_pos").distinct()
    first = sections.groupBy(key, "video_id").agg(F.min("section_pos").alias("section_pos"))
    base = own.join(first, [key, "video_id", "section_pos"]).select(key, "video_id", "row_pos", "system_term", "user_correction", fold_term(F.col("system_term")).alias("_fold"))
    clean = terms.select(key, "video_id", "pos", strip_space(F.col("term")).alias("system_term")).filter("system_term <> ''").withColumn("_fold", fold_term(F.col("system_term")))
    fresh = first_rows(clean, [key, "video_id", "_fold"], ["pos"]).join(base.select(key, "video_id", "_fold"), [key, "video_id", "_fold"], "left_anti")
    ends = base.groupBy(key, "video_id").agg((F.max("row_pos") + 1).alias("_next"))
    number = F.row_number().over(W.partitionBy(key, "video_id").orderBy("pos")) - 1
    fresh = fresh.join(ends, [key, "video_id"], "left").select(key, "video_id", (F.coalesce("_next", F.lit(0)) + number).cast("int").alias("row_pos"), "system_term", F.lit("").alias("user_correction"))
    rows = base.drop("_fold").unionByName(fresh)
    last = sheet.groupBy(key).agg(F.max("section_pos").alias("_last"))
    absent = videos.join(sections, [key, "video_id"], "left_anti").join(last, key, "left")
    place = F.coalesce("_last", F.lit(-1)) + F.row_number().over(W.partitionBy(key).orderBy("video_id"))
    targets = sections.unionByName(absent.select(key, "video_id", place.cast("int").alias("section_pos")))
    merged = targets.join(videos, [key, "video_id"]).join(rows, [key, "video_id"]).withColumnRenamed("_title", "title")
    return sheet.join(videos, [key, "video_id"], "left_anti").select(*columns).unionByName(merged.select(*columns))


UNDECIDED, STAYS, GOES = 0, 1, 2


def _claims(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, entry, at, canonical, surface, fold, status): every spelling that an entry names, its canonical first; ``at`` goes up with the order in which they are named."""

    def named(entries: DataFrame, added: bool) -> DataFrame:
        entry = F.struct(F.lit(added).alias("added"), "entry_pos", "canonical")
        spellings = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
        long = entries.select(key, entry.alias("entry"), "canonical", F.posexplode(spellings).alias("place", "surface"))
        status = F.lit(UNDECIDED if added else STAYS).alias("status")
        return long.select(key, "entry", F.struct("entry", "place").alias("at"), "canonical", "surface", fold_term(F.col("surface")).alias("fold"), status)

    every = named(base, False).unionByName(named(new, True))
    empty = every.filter("fold = '' and entry.added and at.place = 0").select(key, "entry").distinct()
    return every.filter("fold <> ''").join(empty, [key, "entry"], "left_anti")


def _settled(claims: DataFrame, key: str) -> DataFrame:
    """``claims`` of the entries that stay.

    In a round, the earliest claim to each spelling by an entry that has not gone decides: a new entry stays if that is its own claim, or one of an entry that
    stays and has the same canonical term; it goes if the entry that stays has another one. All others wait. Every round decides the earliest
    entry that is left at least, so there are as many rounds as entries that wait for each other in a row.
    """
    open_claims = store(claims, "claims")
    done = open_claims.filter(F.col("status") == STAYS)
    while not (waiting := open_claims.filter(F.col("status") == UNDECIDED)).isEmpty():
        heads = open_claims.groupBy(key, "fold").agg(F.min_by(F.struct("entry", "canonical", "status"), "at").alias("head"))
        own = waiting.filter("at.place = 0").join(heads, [key, "fold"])
        fate = F.when(F.col("head.entry") == F.col("entry"), STAYS).when(F.col("head.status") == STAYS, F.when(F.col("head.canonical") == F.col("canonical"), STAYS).otherwise(GOES)).otherwise(UNDECIDED)
        fates = own.select(key, "entry", fate.alias("_fate")).distinct()
        new = open_claims.join(fates, [key, "entry"], "left").withColumn("status", F.coalesce("_fate", "status")).drop("_fate").filter(F.col("status") != GOES)
        before, open_claims = open_claims, store(new, "claims")
        done = open_claims.filter(F.col("status") == STAYS)
        drop(before)
    return done


def merged_glossaries(base: DataFrame, new: DataFrame, key: str = "book") -> DataFrame:
    """(key, then a glossary's columns): each book's glossary with new entries, which never take a spelling from another.

    Spellings belong, by their fold, to whoever names them first: base entries in order, then new ones. A new
    entry whose canonical term belongs to another goes as a whole, with all its claims, so who owns what depends on all entries before; that is settled
    in rounds of joins over all spellings of all books (:func:`_settled`). New entries add the aliases that
    they own to the entry of their term, which comes after the others if the base has none. Null aliases are none; entries of one place go by
    their term, equal ones are one; rows of a null book go.
    """
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    base, new = (g.select(key, *columns).filter(F.col(key).isNotNull()) for g in (base, new))
    stay = _settled(_claims(base, new, key), key)
    owners = stay.groupBy(key, "fold").agg(F.min("at").alias("at"))
    added = stay.filter("entry.added and at.place > 0").join(owners, [key, "fold", "at"]).groupBy(key, "canonical")
    added = added.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surface"))), lambda s: s["surface"]).alias("_more"))
    rest = F.struct("aliases", "reading", "category")
    old = base.groupBy(key, "canonical").agg(F.min("entry_pos").alias("_old"), F.max_by(rest, "entry_pos").alias("_base"))
    first = stay.filter("entry.added and at.place = 0").groupBy(key, "canonical").agg(F.min("entry").alias("entry"))
    fresh = first.join(new.withColumn("entry", F.struct(F.lit(True).alias("added"), "entry_pos", "canonical")).groupBy(key, "entry").agg(F.first(rest).alias("_new")), [key, "entry"])
    fresh = fresh.select(key, "canonical", F.col("entry.entry_pos").alias("_fresh"), "_new")
    none = F.array().cast("array<string>")
    out = old.join(fresh, [key, "canonical"], "full").join(added, [key, "canonical"], "left")
    out = out.withColumn("aliases", F.concat(F.coalesce("_base.aliases", none), F.coalesce("_more", none)))
    chosen = [F.when(F.col("_old").isNotNull(), F.col(f"_base.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) for c in ("reading", "category")]
    placed = running(out, [key], [F.asc_nulls_last("_old"), "_fresh", "canonical"], {"entry_pos": ("number", None)})
    return placed.select(key, (F.col("entry_pos") - 1).cast("int").alias("entry_pos"), "canonical", "aliases", *chosen)


def surfaces(entries: DataFrame, key: str = "book") -> DataFrame:
    """(key, fold, canonical, is_alias): every spelling of a glossary, once for each canonical it belongs to."""
    own = entries.select(key, "canonical", F.col("canonical").alias("surface"), F.lit(False).alias("is_alias"))
    rows = own.unionByName(entries.select(key, "canonical", F.explode("aliases").alias("surface"), F.lit(True).alias("is_alias"))).withColumn("fold", fold_term(F.col("surface")))
    return rows.filter("fold <> ''").groupBy(key, "fold", "canonical").agg(F.min("is_alias").alias("is_alias"))


def conflicts(entries: DataFrame, key: str = "book") -> DataFrame:
    """(key, fold, canonicals): spellings that belong to more than one canonical; a sound glossary has none."""
    owners = surfaces(entries, key).groupBy(key, "fold").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))
    return owners.filter(F.size("canonicals") > 1)


def canonical_terms(terms: DataFrame, entries: DataFrame, term: str = "term", key: str = "book") -> DataFrame:
    """``terms`` with ``canonical`` (null for unknown ones) and ``is_variant``: known, but not under its canonical spelling."""
    found = surfaces(entries, key).drop("is_alias")
    rows = terms.withColumn("fold", fold_term(F.col(term))).join(found, [key, "fold"], "left").drop("fold")
    return rows.withColumn("is_variant", F.coalesce(F.col("canonical") != F.col(term), F.lit(False)))
