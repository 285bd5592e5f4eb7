"""Typed rows out of models' JSON replies, by Spark's variants: nothing in a reply can fail a job.

Every parser takes the text of a JSON object (:func:`lorespark.functions.python.json_object`
finds one in a reply) and reads each item by its own type. Null, or a field of another
type than a list where a list belongs, gives null; items that are no objects go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import CATEGORIES, LABELS, clamped
from .text import once

#: Most items of a reply and of an item's lists, and most characters of a field and of a body.
ITEMS, LISTED, FIELD, BODY = 500, 200, 4_000, 50_000


def _kind(value: Column) -> Column:
    """The type of a variant: OBJECT<...>, ARRAY<...>, STRING, BIGINT, DOUBLE, DECIMAL(...), BOOLEAN or VOID."""
    return F.schema_of_variant(value)


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _bound(value: Column, of) -> Column:
    """``of`` (value, its type), each evaluated once."""
    return once(value, lambda v: once(_kind(v), lambda kind: of(v, kind)))


def whole(value: Column) -> Column:
    """A variant as a whole number: numbers and numbers in strings lose their fraction; truth values and the rest are null."""

    def of(v: Column, kind: Column) -> Column:
        number = F.when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string")).try_cast("double")).when(kind.rlike(r"\A(DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
        cut = once(number, lambda n: F.when(~F.isnan(n) & (F.abs(n) < 2.0**62), n.cast("bigint")))
        return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).otherwise(cut)

    return _bound(value, of)


def said(value: Column, most: int = FIELD) -> Column:
    """A variant as text cut to ``most`` characters: strings as they are, empty for null, false and zero, all else as JSON."""

    def of(v: Column, kind: Column) -> Column:
        other = once(F.to_json(v), lambda text: F.when(~text.isin("null", "false", "0", "0.0", "[]", "{}"), text))
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(other)
        return F.left(F.coalesce(text, F.lit("")), F.lit(most))

    return _bound(value, of)


def _field(item: Column, name: str, most: int = FIELD) -> Column:
    return said(_get(item, name, "variant"), most)


def _strings(item: Column, name: str) -> Column:
    """The first ``LISTED`` of a list as texts; empty ones go."""
    listed = F.transform(F.slice(F.coalesce(_get(item, name, "array<variant>"), F.array().cast("array<variant>")), 1, LISTED), lambda v: said(v))
    return F.filter(listed, lambda s: s != "")


def _items(payload: Column, name: str, of, most: int = ITEMS) -> Column:
    """``of`` (item, position) for each object of a list; an absent list is empty."""

    def listed(value: Column, kind: Column) -> Column:
        # A list or nothing; a null, false, zero or empty value stands for nothing.
        empty = F.array().cast("array<variant>")
        return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).when(value.isNull() | (said(value) == ""), empty)

    def objects(values: Column) -> Column:
        placed = F.transform(F.slice(values, 1, most), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
        found = F.filter(placed, lambda p: F.try_variant_get(p["v"], "$", "map<string,variant>").isNotNull())
        return F.transform(found, lambda p: of(p["v"], p["i"]))

    def items(reply: Column) -> Column:
        named = once(_get(reply, name, "variant"), lambda v: once(_kind(v), lambda kind: listed(v, kind)))
        return F.when(F.try_variant_get(reply, "$", "map<string,variant>").isNotNull(), objects(named))

    return once(F.try_parse_json(payload), items)


def _category(item: Column, default: Column) -> Column:
    given = F.lower(_field(item, "category"))
    return F.when(given.isin(*CATEGORIES), given).otherwise(default)


def _bounded(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["start_sec"].isNotNull() & s["end_sec"].isNotNull())


def segments(payload: Column) -> Column:
    """array of struct(start_sec, end_sec, label, summary); items without whole bounds go, unknown labels are lectures."""

    def one(v: Column, i: Column) -> Column:
        label = clamped(F.lower(F.trim(_field(v, "label"))), LABELS, "lecture")
        return F.struct(whole(_get(v, "start_sec", "variant")).alias("start_sec"), whole(_get(v, "end_sec", "variant")).alias("end_sec"), label.alias("label"), _field(v, "summary").alias("summary"))

    return _bounded(_items(payload, "segments", one))


def steps(payload: Column) -> Column:
    """array of struct(index, label, start_sec, end_sec, goal, insight_ids); an index that is missing or 0 is the item's position."""

    def one(v: Column, i: Column) -> Column:
        index = F.coalesce(F.nullif(whole(_get(v, "index", "variant")), F.lit(0)), i + 1)
        return F.struct(
            index.cast("long").alias("index"), _field(v, "label").alias("label"), whole(_get(v, "start_sec", "variant")).alias("start_sec"), whole(_get(v, "end_sec", "variant")).alias("end_sec"),
            _field(v, "goal").alias("goal"), _strings(v, "insight_ids").alias("insight_ids"),
        )

    return _bounded(_items(payload, "steps", one))


def unassigned(payload: Column) -> Column:
    return _strings(F.try_parse_json(payload), "unassigned_insight_ids")


def topics(payload: Column) -> Column:
    """array of struct(topic_id, label, aliases, source_videos, duplication_count, category, summary, excerpts).

    Without a count it is that of the sources; without a known category that follows from the count.
    """
    from lorespark.operators.rollups import category

    def excerpt(e: Column) -> Column:
        return F.struct(_field(e, "video_id").alias("video_id"), _field(e, "range").alias("range_str"), _field(e, "quote").alias("quote"))

    def one(v: Column, i: Column) -> Column:
        sources = _strings(v, "source_videos")
        count = F.coalesce(F.nullif(whole(_get(v, "duplication_count", "variant")), F.lit(0)), F.size(F.coalesce(_get(v, "source_videos", "array<variant>"), F.array().cast("array<variant>"))))
        parts = F.filter(F.slice(F.coalesce(_get(v, "excerpts", "array<variant>"), F.array().cast("array<variant>")), 1, LISTED), lambda e: _kind(e).startswith("OBJECT"))
        return F.struct(
            F.coalesce(F.nullif(_field(v, "topic_id"), F.lit("")), F.format_string("t%03d", i + 1)).alias("topic_id"), _field(v, "label").alias("label"), _strings(v, "aliases").alias("aliases"),
            sources.alias("source_videos"), count.cast("long").alias("duplication_count"), _category(v, category(count)).alias("category"), _field(v, "summary").alias("summary"), F.transform(parts, excerpt).alias("excerpts"),
        )

    return _items(payload, "topics", one)


def chapters(payload: Column) -> Column:
    """array of struct(index, label, category, topic_ids, source_videos, rationale) of a plan of chapters."""

    def one(v: Column, i: Column) -> Column:
        index = F.coalesce(F.nullif(whole(_get(v, "index", "variant")), F.lit(0)), i + 1)
        return F.struct(
            index.cast("long").alias("index"), _field(v, "label").alias("label"), _category(v, F.lit("unique")).alias("category"),
            _strings(v, "topic_ids").alias("topic_ids"), _strings(v, "source_videos").alias("source_videos"), _field(v, "rationale").alias("rationale"),
        )

    return _items(payload, "chapters", one)


def chapter_bodies(payload: Column) -> Column:
    """array of struct(chapter_index, label, category, source_video_ids, body_markdown) of written chapters."""

    def one(v: Column, i: Column) -> Column:
        index = F.coalesce(F.nullif(whole(_get(v, "chapter_index", "variant")), F.lit(0)), i + 1)
        return F.struct(
            index.cast("long").alias("chapter_index"), _field(v, "label").alias("label"), _category(v, F.lit("unique")).alias("category"),
            _strings(v, "source_video_ids").alias("source_video_ids"), _field(v, "body_markdown", BODY).alias("body_markdown"),
        )

    return _items(payload, "chapters", one)


def fields(payload: Column, names: dict[str, int]) -> Column:
    """struct of the text fields named, each cut to its length: bodies of steps, overviews, titles."""
    reply = F.try_parse_json(payload)
    return F.struct(*[_field(reply, path, most).alias(path.rpartition(".")[2]) for path, most in names.items()])


def review(payload: Column) -> Column:
    """struct(needs_revision, summary, fixes: array of struct(target, reason, patch_hint)); anything unreadable needs none."""

    def one(v: Column, i: Column) -> Column:
        return F.struct(*[_field(v, name).alias(name) for name in ("target", "reason", "patch_hint")])

    fixes = _items(payload, "fixes", one, LISTED)
    fixes = F.coalesce(fixes, F.array().cast("array<struct<target:string,reason:string,patch_hint:string>>"))
    reply = F.try_parse_json(payload)
    needs = F.coalesce(_field(reply, "needs_revision") != "", F.lit(False)) & (F.size(fixes) > 0)
    return F.struct(needs.alias("needs_revision"), F.coalesce(_field(reply, "summary"), F.lit("")).alias("summary"), fixes.alias("fixes"))


def unfenced(text: Column) -> Column:
    """A reply without a code fence's first line and last line, if it begins with one."""
    plain = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    inner = F.regexp_replace(F.regexp_replace(plain, r"\A```[^\n]*(\n|\z)", ""), r"(\A|\n)[ \t]*```[ \t]*\z", "")
    return F.when(plain.startswith("```"), F.regexp_replace(inner, r"(?U)\A\s+|\s+\z", "")).otherwise(plain)


def corrections(raw: Column) -> Column:
    """struct(corrections: map of idx to text, terms), from an object or a bare list; of an idx said twice the last counts.

    One item without a whole idx or a text that is a string makes the whole reply null.
    """
    none = F.array().cast("array<variant>")

    def entry(v: Column, i: Column) -> Column:
        """idx, text and place of an item; idx is null without a whole one and a text."""
        idx, text = once(_get(v, "idx", "variant"), lambda n: F.when(_kind(n) == "BIGINT", F.try_variant_get(n, "$", "bigint"))), _get(v, "text", "variant")
        return F.struct(idx.alias("idx"), once(text, lambda t: F.when(_kind(t) == "STRING", F.try_variant_get(t, "$", "string"))).alias("text"), i.alias("i"))

    def last_of_each(entries: Column) -> Column:
        """Sorted by idx and place, an entry stays if the next has another idx."""
        ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["idx"], e["i"], e["text"])))
        return once(ordered, lambda o: F.filter(o, lambda e, k: ~F.coalesce(F.get(o, k + 1)["idx"] == e["idx"], F.lit(False))))

    def read(reply: Column, kind: Column) -> Column:
        bare = kind.startswith("ARRAY")
        given = F.when(bare, reply).otherwise(_get(reply, "corrections", "variant"))
        listed = once(given, lambda g: F.when(F.try_variant_get(g, "$", "array<variant>").isNotNull(), F.try_variant_get(g, "$", "array<variant>")).when(kind.startswith("OBJECT") & g.isNull(), none))
        spoken = F.filter(F.coalesce(_get(reply, "terms", "array<variant>"), none), lambda v: _kind(v) == "STRING")
        terms = F.filter(F.transform(spoken, lambda v: F.trim(F.try_variant_get(v, "$", "string"))), lambda t: t != "")
        terms = F.when(bare, F.array().cast("array<string>")).otherwise(terms)

        def result(entries: Column) -> Column:
            good = F.forall(entries, lambda e: e["idx"].isNotNull() & e["text"].isNotNull())
            mapping = F.map_from_entries(F.transform(last_of_each(entries), lambda e: F.struct(e["idx"], e["text"])))
            return F.when(good, F.struct(mapping.alias("corrections"), terms.alias("terms")))

        return once(F.transform(listed, entry), result)

    return _bound(F.try_parse_json(unfenced(raw)), read)
