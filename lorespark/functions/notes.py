"""Parts of notes: frontmatter fields put in or replaced, paths, and what makes a note's body unfit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import RANGE
from .text import collapse, yaml_quoted
from .times import hms

#: Fixed values of the note format: headings that a summary must have, and most characters of the kinds of notes.
SUMMARY_HEADINGS = ("## 全体サマリ", "## 要点タイムライン")
#: Fixed values of the note format: fields that a note's frontmatter may have beside date, title and URL.
EXTRA_FIELDS = ("playlist", "video_id", "reviewed", "one_liner", "chapter", "category", "sources")
MOST = {"script": 400_000, "summary": 50_000, "learning": 50_000}


def with_field(note: Column, field: str, value: Column) -> Column:
    """``note`` with ``field: "value"`` in its frontmatter: in place of the field's first line, else as the last line; unchanged without frontmatter."""
    at = F.locate("\n---", note, 4)
    head, tail = F.left(note, at), F.substring(note, at + 1, F.char_length(note))
    line = F.concat(F.lit(f"{field}: "), yaml_quoted(value))
    found = rf"(?s)\A(.*?)(?<=\A|\n){field}:[^\n]*(.*)\z"
    replaced = F.concat(F.regexp_extract(head, found, 1), line, F.regexp_extract(head, found, 2))
    added = F.concat(F.regexp_replace(head, r"\n+\z", ""), F.lit("\n"), line, F.lit("\n"))
    return F.when(note.startswith("---") & (at > 0) & value.isNotNull(), F.concat(F.when(head.rlike(found), replaced).otherwise(added), tail)).otherwise(note)


def note_path(base: Column, unit: Column, folder: Column, name: Column) -> Column:
    return F.concat_ws("/", base, unit, folder, F.concat(name, F.lit(".md")))


def too_long(body: Column, kind: str) -> Column:
    """An error for bodies over the length of their kind; null for others."""
    return F.when(F.char_length(body) > MOST[kind], F.format_string(f"{kind} has %d characters", F.char_length(body)))


def summary_error(body: Column, headings: Sequence[str] = SUMMARY_HEADINGS) -> Column:
    """What is wrong with a cleaned summary: its length, the first heading it lacks, or that it has no time range; else null."""
    missing = [F.when(~body.contains(h), F.lit(f"heading missing: {h}")) for h in headings]
    return F.coalesce(too_long(body, "summary"), *missing, F.when(~body.rlike(RANGE), F.lit("no time range")))


def note_head(ts: Column, title: Column, url: Column, tags: Sequence[str] = ("memo", "youtube"), extra: dict[str, Column] | None = None) -> Column:
    """A note's frontmatter: date, title, URL, the fields of ``extra`` that are not null, tags; a field outside of ``EXTRA_FIELDS`` is an error."""
    unknown = sorted(set(extra or {}) - set(EXTRA_FIELDS))
    if unknown:
        raise ValueError(f"fields not allowed: {', '.join(unknown)}")
    named = {"title": title, "URL": url, **(extra or {})}
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), yaml_quoted(v), F.lit("\n"))).otherwise("") for k, v in named.items()]
    listed = f"tags: [{', '.join(tags)}]\n" if tags else ""
    return F.concat(F.lit("---\ndate: "), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("\n"), *lines, F.lit(f"{listed}---\n"))


def woven_in(body: Column, start: Column) -> Column:
    """Whether a body holds a time in brackets; a bare one could be part of a longer time."""
    return body.contains(F.concat(F.lit("["), hms(start), F.lit("]")))


def callout(label: Column, start: Column, summary: Column, quote: Column) -> Column:
    """One line for a question or a tip that a body lacks: its summary, else its quote."""
    said = F.coalesce(F.nullif(summary, F.lit("")), F.nullif(quote, F.lit("")), F.lit("(内容未取得)"))
    kind = F.when(label == "qa", "> [!question] Q&Aより [").otherwise("> [!tip] Tips [")
    return F.concat(kind, hms(start), F.lit("]: "), collapse(said))
