"""Replies, glossaries, notes and gates against golden values; functions that no query applies."""

import json

import pytest
from pyspark.sql import functions as F

from lorespark.functions import notes, parsing, python, replies, text, times
from lorespark.operators import glossary, rollups, runs
from lorespark.sources import readers, writers


def one(spark, column, **values):
    """The value of an expression over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()
    return row["v"]


def test_whole_numbers_of_any_kind(spark):
    payload = '{"segments": [%s]}' % ", ".join(json.dumps({"start_sec": v, "end_sec": 9, "label": "QA"}) for v in (1, 1.9, "12.7", " 3 ", True, None, "x", "inf", [1], -2.5, "1e2"))
    found = one(spark, replies.segments(F.col("j")), j=payload)
    assert [(s["start_sec"], s["label"]) for s in found] == [(v, "qa") for v in (1, 1, 12, 3, -2, 100)]


@pytest.mark.parametrize("payload,count", [('{"segments": null}', 0), ("{}", 0), ('{"segments": {"a": 1}}', None), ("[1]", None), ("no", None), ('{"segments": [null, 3, "x", {}]}', 0)])
def test_segments_of_odd_replies(spark, payload, count):
    found = one(spark, replies.segments(F.col("j")), j=payload)
    assert (None if found is None else len(found)) == count


def test_topics_chapters_and_fields(spark):
    reply = {"topics": [{"label": "A" * 5000, "source_videos": ["v1", "", 7], "aliases": "no list", "category": "CORE", "excerpts": [{"quote": "q"}, 1]}, {"topic_id": "x", "duplication_count": "2"}]}
    a, b = one(spark, replies.topics(F.col("j")), j=json.dumps(reply))
    assert (a["topic_id"], len(a["label"]), a["source_videos"], a["aliases"], a["duplication_count"], a["category"]) == ("t001", 4000, ["v1", "7"], [], 3, "core")
    assert [tuple(e) for e in a["excerpts"]] == [("", "", "q")] and (b["topic_id"], b["duplication_count"], b["category"]) == ("x", 2, "supporting")
    c = one(spark, replies.chapters(F.col("j")), j='{"chapters": [5, {"label": "L", "category": "no"}]}')
    assert [tuple(x) for x in c] == [(2, "L", "unique", [], [], "")]
    body = one(spark, replies.chapter_bodies(F.col("j")), j=json.dumps({"chapters": [{"chapter_index": 3, "body_markdown": "b" * 60_000}]}))
    assert body[0]["chapter_index"] == 3 and len(body[0]["body_markdown"]) == 50_000
    moc = one(spark, replies.fields(F.col("j"), {"moc.title": 4_000, "moc.body_markdown": 50_000}), j='{"moc": {"title": "T", "body_markdown": null}}')
    assert tuple(moc) == ("T", "")
    assert one(spark, replies.unassigned(F.col("j")), j='{"unassigned_insight_ids": ["p1", null, "p2"]}') == ["p1", "p2"]


@pytest.mark.parametrize("raw,expected", [
    ('[{"idx": 1, "text": "a"}, {"idx": 1, "text": "b"}]', ({1: "b"}, [])), ('```json\n{"corrections": [{"idx": 0, "text": ""}], "terms": [" x ", 3, ""]}\n```', ({0: ""}, ["x"])),
    ("{}", ({}, [])), ('[{"idx": "1", "text": "a"}]', None), ('[{"idx": 1, "text": "a"}, {"idx": 2}]', None), ('{"corrections": 5}', None), ("5", None), ("no json", None), ("```\n[]\n```", ({}, [])),
])
def test_corrections(spark, raw, expected):
    found = one(spark, replies.corrections(F.col("j")), j=raw)
    assert (None if found is None else tuple(found)) == expected


def test_sheet_corrections_become_entries(spark):
    rows = [("s", 0, "v1", "t", 0, "Claud", "Claude"), ("s", 0, "v1", "t", 1, "ok", ""), ("s", 0, "v1", "t", 2, "Klaude", "ｃｌａｕｄｅ"), ("s", 1, "v2", "t", 0, "CLAUD", "Claude"), ("s", 1, "v2", "t", 1, "same", "SAME"), ("s", 1, "v2", "t", 2, "Pyton", "Python")]
    sheet = spark.createDataFrame(rows, "path string, section_pos int, video_id string, title string, row_pos int, system_term string, user_correction string")
    assert [tuple(r) for r in glossary.correction_entries(sheet).orderBy("entry_pos").collect()] == [("s", 0, "Claude", ["Claud", "Klaude"]), ("s", 1, "Python", ["Pyton"])]


def test_upsert_replaces_every_section_of_a_video(spark):
    schema = "path string, section_pos int, video_id string, title string, row_pos int, system_term string, user_correction string"
    sheet = spark.createDataFrame([("s", 0, "a", "old", 0, "X", "fix"), ("s", 1, "b", "B", 0, "b1", ""), ("s", 2, "a", "older", 0, "gone", "")], schema)
    terms = spark.createDataFrame([("s", "a", "new", 0, " x "), ("s", "a", "new", 1, "Y"), ("s", "a", "new", 2, "ｙ"), ("s", "c", "C", 0, "z"), ("s", "c", "C", 1, " ")], "path string, video_id string, title string, pos int, term string")
    got = sorted(tuple(r)[1:] for r in glossary.upserted_terms(sheet, terms).collect())
    merged = [("X", "fix"), ("Y", "")]
    assert got == sorted([(p, "a", "new", i, *m) for p in (0, 2) for i, m in enumerate(merged)] + [(1, "b", "B", 0, "b1", ""), (3, "c", "C", 0, "z", "")])


def test_glossaries_merge_without_conflicts(spark):
    base = spark.createDataFrame([("g", 0, "Claude", ["Claud"], "r", "c"), ("h", 0, "Only", [], "", "")], f"book string, {glossary.ENTRIES}")
    new = spark.createDataFrame([("g", 0, "Claude", ["CLAUD", "Klaude"], "", ""), ("g", 1, "claud", ["lost"], "", ""), ("g", 2, "Python", ["klaude", "Pyton", "ＰＹＴＯＮ"], "p", ""), ("g", 3, " ", ["x"], "", ""), ("k", 0, "New", ["n"], "", "")], base.schema)
    got = sorted(tuple(r) for r in glossary.merged_glossaries(base, new).collect())
    assert got == [("g", 0, "Claude", ["Claud", "Klaude"], "r", "c"), ("g", 1, "Python", ["Pyton"], "p", ""), ("h", 0, "Only", [], "", ""), ("k", 0, "New", ["n"], "", "")]


def merged_by_hand(base, new):
    """Of one book: rows (canonical, aliases, reading, category), by asking of each spelling who named it before."""
    import unicodedata

    fold = lambda t: unicodedata.normalize("NFKC", t).casefold().strip()
    named = [(fold(t), e[1]) for e in sorted(base) for t in (e[1], *e[2]) if fold(t)]
    holder = lambda f: next((c for g, c in named if g == f), None)
    order = list(dict.fromkeys(e[1] for e in sorted(base)))
    rows = {e[1]: (list(e[2]), *e[3:]) for e in sorted(base)}
    for _, canonical, aliases, *rest in sorted(new):
        own = fold(canonical)
        if own and holder(own) in (None, canonical):
            named.append((own, canonical))
            if canonical not in rows:
                order.append(canonical)
                rows[canonical] = ([], *rest)
            for alias in aliases:
                if fold(alias) and holder(fold(alias)) is None:
                    named.append((fold(alias), canonical))
                    rows[canonical][0].append(alias)
    return [(c, *rows[c]) for c in order]


@pytest.mark.parametrize("seed", [1, 2])
def test_glossaries_merge_as_if_walked(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    terms = ["a", "A", "b", "ｂ", "c", "C ", "d", "D", "e", "f", "g", "", " "]
    books = {}
    for book in range(25):
        entries = lambda n: [(k, str(rng.choice(terms[:11] if k % 9 else terms)), [str(t) for t in rng.choice(terms, int(rng.integers(0, 4)))], f"r{k}", f"c{k}") for k in range(n)]
        books[f"b{book}"] = entries(int(rng.integers(0, 4))), entries(int(rng.integers(0, 14)))
    schema = f"book string, {glossary.ENTRIES}"
    base, new = (spark.createDataFrame([(b, *e) for b, of in books.items() for e in of[k]] + [(None, 0, "x", [], "", "")], schema) for k in (0, 1))
    want = {(b, i, *row) for b, of in books.items() for i, row in enumerate((c, tuple(a), r, g) for c, a, r, g in merged_by_hand(*of))}
    assert {(r[0], r[1], r[2], tuple(r[3]), r[4], r[5]) for r in glossary.merged_glossaries(base, new).collect()} == want


def test_glossaries_merge_in_few_rounds_for_one_large_book(spark):
    n = 100_000
    base = spark.createDataFrame([("g", 0, "Base", ["t7", "t9"], "", "")], f"book string, {glossary.ENTRIES}")
    new = spark.range(n).select(F.lit("g").alias("book"), F.col("id").cast("int").alias("entry_pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("canonical"), F.array(F.concat(F.lit("t"), (F.col("id") + n).cast("string")), F.lit("shared")).alias("aliases"), F.lit("").alias("reading"), F.lit("").alias("category"))
    got = glossary.merged_glossaries(base, new).agg(F.count("*"), F.sum(F.size("aliases")), F.max("entry_pos"), F.count_distinct("entry_pos")).first()
    assert tuple(got) == (n - 1, 2 + (n - 2) + 1, n - 2, n - 1)


@pytest.mark.parametrize("note,expected", [
    ("body", "body"), ("---\nno end", "---\nno end"), ("---\na: 1\n---\nx", '---\na: 1\nk: "v\\"\\\\1"\n---\nx'), ('---\nk: old\nk: two\n---\nk: body', '---\nk: "v\\"\\\\1"\nk: two\n---\nk: body'),
    ("---\nkk: 1\n---", '---\nkk: 1\nk: "v\\"\\\\1"\n---'),
])
def test_frontmatter_fields(spark, note, expected):
    assert one(spark, notes.with_field(F.col("n"), "k", F.col("v")), n=note, v='v"\\1') == expected


def test_gates_and_paths(spark):
    good = "## 全体サマリ\n## 要点タイムライン\n### [00:10 ~ 01:20] x"
    assert one(spark, notes.summary_error(F.col("b")), b=good) is None
    assert one(spark, notes.summary_error(F.col("b")), b=good.replace("~", "-")) == "no time range"
    assert one(spark, notes.summary_error(F.col("b")), b="x" * 50_001) == "summary has 50001 characters"
    assert one(spark, notes.too_long(F.col("b"), "script"), b="x" * 400_000) is None
    assert one(spark, notes.note_path(F.lit("Base"), F.lit("02_Summary"), F.col("f"), F.lit("n")), f="day x") == "Base/02_Summary/day x/n.md"
    df = spark.createDataFrame([("p", None, "b"), ("p", "e", "b"), ("p", None, None), ("q", None, "b"), ("q", None, "b")], "k string, error string, body string")
    assert [tuple(r) for r in runs.large_enough(df, "k", runs.succeeded(F.col("error"), F.col("body")), 2).collect()] == [("q", 2)]


def test_lookups_between_stages(spark):
    head = lambda video, more="": f'---\nvideo_id: "{video}"\n{more}---\nbody'
    a, b = "aaaaaaaaaaa", "bbbbbbbbbbb"
    found = spark.createDataFrame([("new", "1.md", head(a, "reviewed: false\n")), ("old", "2.md", head(a, "reviewed: True\n")), ("old", "1.md", head(a, 'reviewed: "true"\n')), ("new", "3.md", head(b))], "folder string, filename string, content string")
    folders = spark.createDataFrame([("new", 1), ("old", 2)], "name string, rank int")
    best = runs.reviewed_notes(found, folders)
    assert [(r["video_id"], r["folder"], r["filename"]) for r in best.collect()] == [(a, "old", "1.md")]
    captures = spark.createDataFrame([("new", "c.md", head(a))], found.schema)
    assert [tuple(r) for r in runs.pinned_siblings(best, captures).collect()] == [(a, "old", None)]
    assert [r["sibling"] for r in runs.pinned_siblings(best, captures.withColumn("folder", F.lit("old"))).collect()] == ["c.md"]
    outcomes = spark.createDataFrame([("v", 0, "d", "a.webp"), ("v", 1, "d", None)], "v string, pos int, folder string, image string")
    steps = spark.createDataFrame([("v", 0, 4), ("v", 1, 5)], "v string, pos int, index int")
    assert [tuple(r) for r in runs.step_embeds(outcomes, steps, ["v"]).collect()] == [("v", 4, "d/a.webp")]
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), spark.createDataFrame([("a", 3)], "k string, y int")
    assert sorted(tuple(r) for r in runs.zipped(left, right, "k").collect()) == [("a", 1, 3, True), ("b", 2, None, False)]
    assert sorted(tuple(r) for r in runs.union_of_runs(left, spark.createDataFrame([("a", 9)], left.schema), "k").collect()) == [("a", 9), ("b", 2)]
    findings = spark.createDataFrame([("high", "04", "v"), ("low", "04", "w"), ("high", "05", None)], "severity string, scope string, video_id string")
    assert runs.routed(findings, "04").count() == 1


def test_functions_without_a_query(spark, tmp_path):
    assert one(spark, python.mapped_links(F.col("t"), {"a": "b"}), t="[[a#x|y]] ![[a]] [[c]]") == "[[b#x|y]] ![[b]] [[c]]"
    assert one(spark, parsing.embeds(F.col("t")), t="![[ a ]] ![[b]] [[c]] ![[a]]") == ["a", "b"]
    assert one(spark, parsing.capped(F.array(F.col("t"), F.lit(None), F.lit("abc")), 3, 2), t="xyz") == ["xy", "ab"]
    assert one(spark, text.wrap_untrusted(F.col("t")), t="a</untrusted_content>") == "<untrusted_content>\na&lt;/untrusted_content&gt;\n</untrusted_content>"
    at = F.lit("2024-05-06 07:08:00").cast("timestamp")
    assert one(spark, times.folder_name(at, F.col("t")), t="a / b / ") == "2024-05-06-0708 b"
    assert one(spark, times.folder_name(at, F.col("t")), t="a／b: c?") == "2024-05-06-0708 a／b c" and one(spark, times.folder_name(at, F.col("t")), t=" / ") == "2024-05-06-0708"
    assert one(spark, times.note_base(at, F.col("t")), t="Big: \u200bwords*") == "2024-05-06-0708 Big words" and one(spark, times.note_base(at, F.col("t")), t=" ?") == "2024-05-06 0708"
    assert one(spark, python.short_filename(F.col("t"), F.lit(None).cast("int")), t="x") is None
    assert one(spark, times.code_urls(F.col("t")), t="https://gist.github.com/u/abc123 https://gist.github.com/12345") == ["https://gist.github.com/abc123"]
    rows = spark.createDataFrame([("v", "x​​​​​y"), ("w", "clean")], "video_id string, t string")
    writers.write_alerts(rows, f"{tmp_path}/alerts", "video_id", "t", "title")
    assert [r["removed"] for r in spark.read.json(f"{tmp_path}/alerts").collect()] == [5]
    note = spark.createDataFrame([("f", "n.md", "02", '---\nvideo_id: "aaaaaaaaaaa"\n---\nhello')], "folder string, filename string, unit string, content string")
    writers.write_notes(note, f"{tmp_path}/notes")
    back = spark.read.parquet(f"{tmp_path}/notes")
    videos = spark.createDataFrame([(0, "aaaaaaaaaaa"), (1, "bbbbbbbbbbb")], "pos int, video_id string")
    assert [r["body"] for r in readers.existing_bodies(back, videos).collect()] == ["hello"]
    (tmp_path / "g.json").write_text('{"version": 1, "entries": [{"canonical": "A", "aliases": ["a1"]}]}')
    assert [tuple(r)[:3] for r in readers.read_glossary(spark, str(tmp_path / "g.json")).collect()] == [(0, "A", ["a1"])]
    terms = spark.createDataFrame([("v", " a  b", 0), ("v", "a b", 1), ("v", " ", 2)], "v string, term string, pos int")
    assert [r["term"] for r in rollups.term_dedup(terms, ["v"], "term", "pos").collect()] == ["a b"]


def test_heads_stamps_and_callouts(spark):
    head = notes.note_head(F.lit("2024-05-06 07:08:00").cast("timestamp"), F.col("t"), F.lit("u"), extra={"video_id": F.lit("x"), "chapter": F.lit(None).cast("string")})
    assert one(spark, head, t='a "b"') == '---\ndate: 2024-05-06 07:08\ntitle: "a \\"b\\""\nURL: "u"\nvideo_id: "x"\ntags: [memo, youtube]\n---\n'
    with pytest.raises(ValueError):
        notes.note_head(F.lit(None), F.lit("t"), F.lit("u"), extra={"evil": F.lit("x")})
    assert one(spark, notes.woven_in(F.col("b"), F.lit(300)), b="at [1:05:00]") is False and one(spark, notes.woven_in(F.col("b"), F.lit(300)), b="at [05:00]") is True
    assert one(spark, notes.callout(F.lit("qa"), F.lit(3900), F.col("s"), F.lit("two\n words")), s="") == "> [!question] Q&Aより [1:05:00]: two words"
    assert one(spark, times.clip_start(F.lit(0), F.lit(2)), s="") == 0.0 and one(spark, times.clip_start(F.lit(10), F.lit(20)), s="") == 13.25
    assert tuple(one(spark, times.synthesis_timeouts(F.lit(16)), s="")) == (1260, 600, 1260)


def test_playlists_chapters_and_surfaces(spark):
    entry = "struct<id:string,title:string,url:string,duration:double,channel:string,uploader:string,upload_date:string>"
    rows = [("P", [("a", None, None, 9.0, None, "up", None), None, ("", "x", None, None, None, None, None), ("b", "B", "u", None, "ch", "up", "20240101")])]
    got = readers.playlist_videos(spark.createDataFrame(rows, f"playlist_title string, entries array<{entry}>"))
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(0, "a", "", "https://www.youtube.com/watch?v=a", 9, "up", None, "P"), (3, "b", "B", "u", None, "ch", "20240101", "P")]
    details = spark.createDataFrame([("v", '[{"title": " A ", "start_time": "1.5"}, 3, {"title": "", "start_time": 2}, {"title": "B"}, {"title": "C", "start_time": "x"}]'), ("w", "no"), ("x", None)], "video_id string, chapters string")
    assert [tuple(r) for r in readers.video_chapters(details).orderBy("pos").collect()] == [("v", 0, "A", 1.5), ("v", 3, "B", 0.0)]
    entries = spark.createDataFrame([("g", 0, "Claude", ["Claud", "CLAUDE"], "", ""), ("g", 1, "Other", ["ｃｌａｕｄ"], "", "")], f"book string, {glossary.ENTRIES}")
    assert [tuple(r) for r in glossary.conflicts(entries).collect()] == [("g", "claud", ["Claude", "Other"])]
    terms = spark.createDataFrame([("g", "claude"), ("g", "Claude"), ("g", "none")], "book string, term string")
    assert sorted((r["term"], r["canonical"], r["is_variant"]) for r in glossary.canonical_terms(terms, entries).collect()) == [("Claude", "Claude", False), ("claude", "Claude", True), ("none", None, False)]
    steps = spark.createDataFrame([("v", 1, ["q1", "q2"], "[[01_a]]"), ("v", 2, ["q2"], "[[02_b]]")], "v string, index int, insight_ids array<string>, link string")
    insights = spark.createDataFrame([("v", "q1"), ("v", "q2"), ("v", "q3")], "v string, insight_id string")
    assert sorted(tuple(r) for r in runs.insight_links(insights, steps, ["v"]).collect()) == [("v", "q1", "[[01_a]]"), ("v", "q2", "[[02_b]]"), ("v", "q3", None)]
