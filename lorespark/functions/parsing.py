"""Rows out of structured text, and typed values out of JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the note format: an embedded file; a third-level heading that opens with a range of times; a range with nothing but an embed on the line after it.
EMBED = r"!\[\[((?:[^\]\n]|\](?!\]))+)\]\]"
RANGE = r"(?md)^###\s*\[\s*(\d{1,2}:\d{2})\s*[~〜～]\s*(\d{1,2}:\d{2})\s*\]\s*(.+?)\s*$"
PAIR = r"(?md)\[(\d{1,2}:\d{2})\s*[~〜～]\s*(\d{1,2}:\d{2})\][^\S\n]*\n[^\S\n]*!\[\[((?:[^\]\n]|\](?!\]))+)\]\]"
SEVERITIES, SCOPES, LABELS, CATEGORIES = ("high", "medium", "low", "info"), ("04", "05"), ("lecture", "qa", "tips"), ("core", "supporting", "unique")


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, n + 1)]


def summary_ranges(text: Column) -> Column:
    """array of struct(start_sec, end_sec, heading): headings with a time range whose end is after its start."""
    start, end, head = _groups(text, RANGE, 3)
    seconds = lambda clock: F.substring_index(clock, ":", 1).cast("int") * 60 + F.substring_index(clock, ":", -1).cast("int")
    zipped = F.transform(F.arrays_zip(start.alias("a"), end.alias("b"), head.alias("c")), lambda z: F.struct(seconds(z["a"]).alias("start_sec"), seconds(z["b"]).alias("end_sec"), z["c"].alias("heading")))
    return F.filter(zipped, lambda r: r["end_sec"] > r["start_sec"])


def capture_pairs(text: Column) -> Column:
    """array of struct(range_str, filename): a time range's line followed by an embedded file."""
    start, end, name = _groups(text, PAIR, 3)
    return F.transform(F.arrays_zip(start.alias("a"), end.alias("b"), name.alias("c")), lambda z: F.struct(F.concat(F.lit("["), z["a"], F.lit(" ~ "), z["b"], F.lit("]")).alias("range_str"), z["c"].alias("filename")))


def embeds(text: Column) -> Column:
    """The distinct embedded files of a text, stripped, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMBED), F.lit(1)), lambda v: F.trim(v)))


def clamped(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def capped(values: Column, most: int, length: int) -> Column:
    """The first ``most`` of an array cut to ``length`` characters; empty and null ones then go."""
    return F.filter(F.transform(F.slice(values, 1, most), lambda v: F.left(F.coalesce(v, F.lit("")), F.lit(length))), lambda v: v != "")


def findings(payload: Column, most: int = 200) -> Column:
    """array of struct(finding_id, perspective, severity, scope, video_id, detail) from a JSON object with ``findings``.

    Nothing fails: unknown severities are ``info``, unknown scopes and scope 04 without a video
    are 05, and ids count all items, also those without a detail, which go.
    """
    schema = "findings array<struct<perspective:string,severity:string,target_scope:string,target_video_id:string,detail:string>>"
    items = F.slice(F.coalesce(F.from_json(payload, schema)["findings"], F.array().cast("array<struct<perspective:string,severity:string,target_scope:string,target_video_id:string,detail:string>>")), 1, most)

    def clean(f: Column, i: Column) -> Column:
        scope = clamped(f["target_scope"], SCOPES, "05")
        scope = F.when((scope == "04") & (F.coalesce(f["target_video_id"], F.lit("")) == ""), "05").otherwise(scope)
        return F.struct(
            F.format_string("f%03d", i + 1).alias("finding_id"), F.coalesce(f["perspective"], F.lit("")).alias("perspective"), clamped(f["severity"], SEVERITIES, "info").alias("severity"),
            scope.alias("scope"), f["target_video_id"].alias("video_id"), F.coalesce(f["detail"], F.lit("")).alias("detail"),
        )

    return F.filter(F.transform(items, clean), lambda f: f["detail"] != "")


def trusted_video_id(head: Column) -> Column:
    """The id in a note's frontmatter; null unless the block opens the note, the id is well formed and its URL, if any, agrees."""
    start = F.left(head, F.lit(2048))
    block = F.regexp_extract(start, r"(?s)\A---\n(.*?)\n---", 1)
    video = F.regexp_extract(block, r'(?m)^video_id: "([A-Za-z0-9_-]{11})"$', 1)
    url = F.regexp_extract(block, r'(?m)^url: "?([^"\n]*)', 1)
    agrees = (url == "") | url.contains(F.concat(F.lit("v="), video)) | url.contains(F.concat(F.lit("/"), video))
    return F.when((video != "") & agrees, video)


def frontmatter_field(text: Column, field: str) -> Column:
    """A field's value, quoted or bare, from the first 500 characters; null without it."""
    found = F.regexp_extract(F.left(text, F.lit(500)), rf'(?m)^{field}:\s*("([^"\n]*)"|[^\n]+)', 1)
    return F.nullif(F.regexp_replace(F.trim(found), r'\A"|"\z', ""), F.lit(""))
