"""Markdown blocks and JSON texts that notes, prompts and reports are put together from, as column expressions.

JSON is compact; fields come in the order given, nulls are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, collapse, sanitize, strip_space, wrap_untrusted
from .times import hms

#: Fixed values of the note format: most bytes of a code file, characters of all materials, of a title, of a reason, of an excerpt.
FILE_BYTES, MATERIALS, TITLE, REASON, EXCERPT = 50_000, 400_000, 200, 200, 500
NO_IMAGES, TABLE_HEAD = "(画像無し)", "| タイムスタンプ範囲 | 画像ファイル名 |\n|---|---|"
CODE_HEAD = "## 関連コード"
TERMS_HEAD = "## 確定済み固有名詞辞書（再検索は不要。これらの表記をそのまま使うこと）"
DESCRIPTION_HEAD = "## 動画概要欄（既知文脈。固有名詞の手がかりとして web 検索より先に参照する）"
REVIEW_HEAD, REVIEW_NOTE, REVIEW_END = "## レビューからの修正指示", "> レビュー総評: ", "上記指示に従って該当箇所だけを修正し、JSON 全体を再出力してください。"
NO_SUMMARY = "## 全体サマリ\n\n要約の自動生成に失敗しました (", (
    ")。モデルが必須フォーマットを満たす出力を返さなかったため、プレースホルダを書き込んでいます。より大きい stage_02 モデルでの再実行を推奨します。\n\n"
    "## 要点タイムライン\n\n(自動生成に失敗したため、タイムラインはありません)\n"
)
NO_STEP_GOAL, NO_STEP_DO, NO_STEP_WARNING, NO_STEP_EXCERPT = "この区間の内容を実践する。", " を視聴し、講演内容を手元で再現する。", "> [!warning] 自動生成に失敗したため、簡易版の本文です。", "冒頭の文字起こし抜粋:"
LEFT_OUT_STEPS, LAST_SUMMARY, ADDED_INSIGHTS, NO_CONTENT = "## 未掲載のステップ (自動追記)", "- 巻末まとめ: [[99_QA_Tipsまとめ]]", "## 補遺 (自動追記)", "(内容未取得)"


def lines(items: Column, line: Callable[[Column], Column], between: str = "\n") -> Column:
    return F.array_join(F.transform(items, line), between)


def _unless_empty(items: Column, block: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, block).otherwise("")


def _right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def code_section(snippets: Column) -> Column:
    """A section with the files of ``snippets``: array of struct(filename, source_url, language, content, truncated); empty for none."""

    def one(s: Column) -> Column:
        head = F.concat(F.lit("### ["), s["filename"], F.lit("]("), s["source_url"], F.lit(")\n\n```"), F.coalesce(s["language"], F.lit("")))
        cut = F.when(s["truncated"], F.lit(f"\n\n_(truncated to {FILE_BYTES:,} bytes; see source for full file)_")).otherwise("")
        return F.concat(head, F.lit("\n"), _right_trimmed(s["content"]), F.lit("\n```"), cut, F.lit("\n"))

    return _unless_empty(snippets, F.concat(F.lit(f"\n{CODE_HEAD}\n\n"), lines(snippets, one)))


def mapping_table(pairs: Column) -> Column:
    """A table of ``pairs``: array of struct(range_str, filename)."""
    table = F.concat(F.lit(f"{TABLE_HEAD}\n"), lines(pairs, lambda p: F.concat(F.lit("| "), p["range_str"], F.lit(" | "), p["filename"], F.lit(" |"))))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, table).otherwise(NO_IMAGES)


def material(video_id: Column, title: Column, body: Column, budget: Column) -> Column:
    """One video's part of the materials: its heading and its body, cleaned and cut to ``budget`` characters."""
    name = sanitize(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")), TITLE)["text"]
    return F.concat(F.lit("## VIDEO: "), video_id, F.lit(": "), name, F.lit("\n\n"), F.left(sanitize(body, MATERIALS)["text"], budget))


def json_text(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _picked(items: Column, *fields: str, **renamed: str) -> Column:
    return F.transform(items, lambda t: F.struct(*[t[f].alias(renamed.get(f, f)) for f in fields]))


def topics_json(topics: Column) -> Column:
    """{"topics": [...]} with the excerpts' ranges as ``range``."""
    excerpts = lambda t: F.coalesce(_picked(t["excerpts"], "video_id", "range_str", "quote", range_str="range"), F.array())
    plain = ("topic_id", "label", "aliases", "source_videos", "duplication_count", "category", "summary")
    return json_text(F.struct(F.transform(topics, lambda t: F.struct(*[t[f].alias(f) for f in plain], excerpts(t).alias("excerpts"))).alias("topics")))


def chapters_json(chapters: Column) -> Column:
    return json_text(F.struct(_picked(chapters, "index", "label", "category", "topic_ids", "source_videos", "rationale").alias("chapters")))


def coverage_json(covered: Column, missing: Column) -> Column:
    return json_text(F.struct(covered.alias("covered_topic_ids"), missing.alias("missing_topic_ids")))


def leader_json(title: Column, body: Column, chapters: Column) -> Column:
    moc = F.struct(title.alias("title"), body.alias("body_markdown")).alias("moc")
    return json_text(F.struct(moc, _picked(chapters, "chapter_index", "label", "category", "source_video_ids", "body_markdown").alias("chapters")))


def glossary_json(entries: Column, version: int = 1) -> Column:
    """A glossary's file of ``entries``, array of struct(canonical, aliases, reading, category); of an entry, what is empty is left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    slim = F.transform(entries, lambda e: F.struct(e["canonical"].alias("canonical"), F.when(F.size(e["aliases"]) > 0, e["aliases"]).alias("aliases"), some(e["reading"]).alias("reading"), some(e["category"]).alias("category")))
    return F.concat(F.to_json(F.struct(F.lit(version).alias("version"), slim.alias("entries"))), F.lit("\n"))


def no_summary(reason: Column) -> Column:
    """The body of a summary that could not be made; it has no time range, so that nothing is captured from it."""
    return F.concat(F.lit(NO_SUMMARY[0]), reason, F.lit(NO_SUMMARY[1]))


def no_step(goal: Column, start: Column, end: Column, url: Column, captions: Column, reason: Column) -> Column:
    """The body of a step that could not be written; ``captions`` is an array of struct(start, text), of which those in the step are quoted."""
    own = F.filter(F.transform(F.filter(captions, lambda c: (c["start"] >= start) & (c["start"] < end)), lambda c: collapse(c["text"])), lambda t: t != "")
    quoted = F.left(F.array_join(own, " "), F.lit(EXCERPT))
    watch = F.concat(url, F.lit("&t="), start.cast("string"))
    cause = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" (原因: "), sanitize(reason, REASON)["text"], F.lit(")"))).otherwise("")
    head = F.concat(F.lit("## ゴール\n\n"), F.coalesce(F.nullif(goal, F.lit("")), F.lit(NO_STEP_GOAL)), F.lit("\n\n## 手順\n\n1. ["), hms(start), F.lit("〜"), hms(end), F.lit("]("), watch, F.lit(f"){NO_STEP_DO}\n\n{NO_STEP_WARNING}"), cause)
    return F.concat(head, F.when(quoted != "", F.concat(F.lit(f"\n\n{NO_STEP_EXCERPT}\n\n> "), quoted)).otherwise(""))


def review_block(summary: Column, fixes: Column) -> Column:
    """A reviewer's fixes, array of struct(target, reason, patch_hint), as instructions; empty without any."""

    def one(f: Column, i: Column) -> Column:
        more = [F.when(f[c] != "", F.concat(F.lit(f"\n   - {name}: "), f[c])).otherwise("") for c, name in (("reason", "理由"), ("patch_hint", "修正方針"))]
        return F.concat((i + 1).cast("string"), F.lit(". **target**: `"), f["target"], F.lit("`"), *more)

    note = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit(REVIEW_NOTE), summary, F.lit("\n\n"))).otherwise("")
    return _unless_empty(fixes, F.concat(note, F.lit(f"{REVIEW_HEAD}\n\n"), F.array_join(F.transform(fixes, one), "\n"), F.lit(f"\n\n{REVIEW_END}")))


def known_terms(pairs: Column) -> Column:
    """Terms whose spelling is settled, array of struct(system_term, resolved); empty without any."""
    one = lambda p: F.when(p["system_term"] != p["resolved"], F.concat(F.lit("- "), p["system_term"], F.lit(" → "), p["resolved"])).otherwise(F.concat(F.lit("- "), p["resolved"]))
    return _unless_empty(pairs, F.concat(F.lit(f"\n{TERMS_HEAD}\n"), lines(pairs, one)))


def description_block(description: Column, most: int) -> Column:
    """A video's description as text from outside; empty without one."""
    block = F.concat(F.lit(f"\n\n{DESCRIPTION_HEAD}\n"), wrap_untrusted(sanitize(description, most)["text"]))
    return F.when(F.coalesce(description, F.lit("")) != "", block).otherwise("")


def with_orphans(body: Column, stems: Column, has_insights: Column) -> Column:
    """An overview with links to the notes that it does not link, and to the closing summary if there are insights."""
    orphans = F.filter(F.array_sort(stems), lambda s: ~body.contains(F.concat(F.lit("[["), s, F.lit("]]"))))
    added = F.when(F.size(orphans) > 0, F.concat(_right_trimmed(body), F.lit(f"\n\n{LEFT_OUT_STEPS}\n\n"), lines(orphans, lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))))).otherwise(body)
    missing = has_insights & ~added.contains("[[99_QA_Tipsまとめ]]")
    return F.when(missing, F.concat(_right_trimmed(added), F.lit(f"\n\n{LAST_SUMMARY}"))).otherwise(added)


def with_all_insights(body: Column, insights: Column, url: Column) -> Column:
    """A closing summary with a line for each insight, array of struct(label, start_sec, summary, quote, link), whose bracketed time it lacks."""
    absent = F.filter(insights, lambda i: ~body.contains(F.concat(F.lit("["), hms(i["start_sec"]), F.lit("]"))))

    def one(i: Column) -> Column:
        said = F.coalesce(F.nullif(i["summary"], F.lit("")), F.nullif(i["quote"], F.lit("")), F.lit(NO_CONTENT))
        kind = F.when(i["label"] == "qa", "Q&A").otherwise("Tips")
        link = F.when(F.coalesce(i["link"], F.lit("")) != "", F.concat(F.lit(" (→ [["), i["link"], F.lit("]])"))).otherwise("")
        return F.concat(F.lit("- ["), hms(i["start_sec"]), F.lit("]("), url, F.lit("&t="), i["start_sec"].cast("string"), F.lit(") ["), kind, F.lit("] "), collapse(said), link)

    return F.when(F.size(absent) > 0, F.concat(_right_trimmed(body), F.lit(f"\n\n{ADDED_INSIGHTS}\n\n"), lines(absent, one))).otherwise(body)


def note_file(head: Column, body: Column) -> Column:
    """A note's text: its frontmatter, a blank line, its body and a line feed."""
    return F.concat(head, F.lit("\n"), strip_space(body), F.lit("\n"))
