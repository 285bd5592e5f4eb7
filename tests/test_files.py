"""Notes as files: written whole or not at all, read in parts, and what they are put together from."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorespark.functions import blocks
from lorespark.operators import notes as ops
from lorespark.shared import store
from lorespark.sources import files, readers


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(folder) for f in names}


def test_files_are_written_and_read_back(spark, tmp_path):
    rows = [("a/b/one.md", "eins\nzwei"), ("a/two.md", ""), ("three.md", None), ("a/日本.md", "é" * 3000), ("meta/x.json", "{}")]
    notes = spark.createDataFrame(rows, "path string, content string").repartition(3)
    files.write_note_files(notes.withColumn("more", F.lit(1)), str(tmp_path))
    assert tree(tmp_path) == {p: c or "" for p, c in rows}
    got = {r["path"]: r for r in files.read_note_files(spark, str(tmp_path)).collect()}
    assert {p: r["content"] for p, r in got.items()} == {p: c or "" for p, c in rows if p.endswith(".md")}
    assert (got["a/b/one.md"]["folder"], got["a/b/one.md"]["filename"], got["a/日本.md"]["size"]) == ("a/b", "one.md", 6000)
    head = {r["path"]: r["content"] for r in files.read_note_files(spark, str(tmp_path), head=True).collect()}
    assert head["a/日本.md"] == "é" * (files.HEAD // 2)
    files.write_note_files(spark.createDataFrame([("a/two.md", "new"), ("three.md", "new")], notes.schema), str(tmp_path), existing="keep")
    assert tree(tmp_path)["a/two.md"] == "" and tree(tmp_path)["three.md"] == ""
    files.write_note_files(spark.createDataFrame([("a/two.md", "new")], notes.schema), str(tmp_path))
    assert tree(tmp_path)["a/two.md"] == "new" and files.read_note_files(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("rows", [[("x.md", "1"), ("../up.md", "2")], [("x.md", "1"), ("/root.md", "2")], [("same.md", "1"), ("same.md", "2")], [("x.md", "1"), (None, "2")]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    (tmp_path / "old.md").write_text("old")
    with pytest.raises(PySparkException):
        files.write_note_files(spark.createDataFrame(rows, "path string, content string").repartition(2), str(tmp_path))
    left = tree(tmp_path)
    assert left == {"old.md": "old"}


def test_a_task_that_is_run_again_leaves_no_half_note(tmp_path):
    writer = files.NotesWriter({"path": str(tmp_path)}, ["content", "path"])

    def failing():
        yield ("first", "a.md")
        raise RuntimeError("lost executor")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    done = writer.write(iter([("first", "a.md"), ("second", "b.md")]))
    assert not any(p.endswith(".md") for p in tree(tmp_path))
    writer.commit([done, None])
    assert tree(tmp_path) == {"a.md": "first", "b.md": "second"}
    other = files.NotesWriter({"path": str(tmp_path)}, ["path", "content"])
    other.abort([other.write(iter([("c.md", "third")])), None])
    assert tree(tmp_path) == {"a.md": "first", "b.md": "second"}


def test_filters_and_heads_save_reading(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    for k in range(450):
        folder = tmp_path / f"unit{k % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"n{k}.md").write_text("x" * 5000)
    reader = files.NotesReader({"path": str(tmp_path), "head": "true"})
    other = GreaterThan(("size",), 5)
    assert list(reader.pushFilters([EqualTo(("folder",), "unit1"), StringStartsWith(("filename",), "n1"), other])) == [other]
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert {(r[1], r[2][:2]) for r in rows} == {("unit1", "n1")} and len(rows) == sum(k % 3 == 1 and str(k).startswith("1") for k in range(450))
    assert {len(r[5]) for r in rows} == {files.HEAD} and {r[3] for r in rows} == {5000}
    assert [len(p.paths) for p in files.NotesReader({"path": str(tmp_path)}).partitions()] == [200, 200, 50]


def test_filters_of_queries_hold(spark, tmp_path):
    files.write_note_files(spark.createDataFrame([(f"u{k % 2}/n{k}.md", str(k)) for k in range(10)], "path string, content string"), str(tmp_path))
    got = files.read_note_files(spark, str(tmp_path)).filter("folder = 'u1' and filename in ('n1.md', 'n3.md', 'n4.md') and size = 1")
    assert sorted(r["content"] for r in got.collect()) == ["1", "3"]


def test_writing_is_dealt_to_tasks_and_moves_may_run_again(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(files, "store", lambda df, name: kept.append(store(df, name)) or kept[-1])
    monkeypatch.setattr(files, "drop", lambda *_: None)
    notes = spark.range(400).groupBy(F.concat(F.lit("f/n"), F.col("id").cast("string"), F.lit(".md")).alias("path")).agg(F.first(F.col("id").cast("string")).alias("content"))
    files.write_note_files(notes, str(tmp_path))
    staged = [tuple(r) for r in kept[0].collect()]
    assert len(staged) == 400 and len({at.rpartition("/")[0] for at, _ in staged}) > 4
    assert tree(tmp_path) == {f"f/n{k}.md": str(k) for k in range(400)}
    writer = files.NotesWriter({"path": str(tmp_path)}, ["path", "content"])
    again = [*writer.staged(iter([("f/n1.md", "new"), ("g/x.md", "x")]))]
    writer.place(again)
    writer.place(again)
    assert tree(tmp_path)["f/n1.md"] == "new" and tree(tmp_path)["g/x.md"] == "x"
    with pytest.raises(FileNotFoundError):
        writer.place([(f"{tmp_path}/none", "g/none.md")])


def test_only_contents_that_are_asked_for_are_read(spark, tmp_path):
    files.write_note_files(spark.createDataFrame([(f"u{k % 2}/n{k}.md", str(k)) for k in range(10)], "path string, content string"), str(tmp_path))
    found = files.read_note_files(spark, str(tmp_path))
    for k in range(0, 10, 2):
        (tmp_path / "u0" / f"n{k}.md").unlink()
    assert sorted(r["content"] for r in found.filter("folder = 'u1'").collect()) == ["1", "3", "5", "7", "9"]
    assert found.count() == 10 and {r["size"] for r in found.select("size").collect()} == {1}
    with pytest.raises(PySparkException):
        found.collect()


def test_folders_resolve_to_the_one_modified_last(spark, tmp_path):
    rows = [("2024-05-06-0700 Big talk", 1), ("2024-05-06-0900 Big talk again", 3), ("2024-05-06 The Big talk", 5), ("2024-05-05 Big talk", 9), ("2024-05-06-1000 other", 7)]
    folders = spark.createDataFrame(rows, "name string, modified int")
    pick = lambda canonical: [r["name"] for r in readers.resolved_folder(folders, "2024-05-06", canonical, "Big talk").collect()]
    assert pick("2024-05-06-0700 Big talk") == ["2024-05-06-0700 Big talk"] and pick("none") == ["2024-05-06 The Big talk"]
    assert readers.resolved_folder(folders, "2020-01-01", "none", "Big talk").count() == 0
    note = '---\nURL: "https://www.youtube.com/watch?v=%s"\nvideo_id: "%s"\n---\n%s'
    files.write_note_files(spark.createDataFrame([("f/a.md", note % (("abcdefghijk",) * 2 + ("body a",))), ("f/b.md", note % (("bbbbbbbbbbb",) * 2 + ("",))), ("g/a.md", note % (("abcdefghijk",) * 2 + ("elsewhere",)))], "path string, content string"), str(tmp_path))
    videos = spark.createDataFrame([(1, "abcdefghijk"), (0, "bbbbbbbbbbb"), (2, "ccccccccccc")], "pos int, video_id string")
    assert [(r["pos"], r["body"]) for r in readers.collected_bodies(files.read_note_files(spark, str(tmp_path)), "f", videos).collect()] == [(1, "body a")]


def one(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_blocks(spark):
    code = one(spark, blocks.code_section(F.col("s")), ([("a.py", "u", "python", "x = 1\n\n", True), ("b", "v", None, "y", False)],), "s array<struct<filename:string,source_url:string,language:string,content:string,truncated:boolean>>")
    assert code == "\n## 関連コード\n\n### [a.py](u)\n\n```python\nx = 1\n```\n\n_(truncated to 50,000 bytes; see source for full file)_\n\n### [b](v)\n\n```\ny\n```\n"
    pairs = "p array<struct<range_str:string,filename:string>>"
    assert one(spark, blocks.mapping_table(F.col("p")), ([("[00:01 ~ 00:02]", "f.webp")],), pairs) == "| タイムスタンプ範囲 | 画像ファイル名 |\n|---|---|\n| [00:01 ~ 00:02] | f.webp |"
    assert one(spark, blocks.mapping_table(F.col("p")), ([],), pairs) == one(spark, blocks.mapping_table(F.col("p")), (None,), pairs) == "(画像無し)"
    fixes = "s string, f array<struct<target:string,reason:string,patch_hint:string>>"
    assert one(spark, blocks.review_block(F.col("s"), F.col("f")), ("fine", [("moc", "why", ""), ("c1", "", "how")]), fixes) == "> レビュー総評: fine\n\n## レビューからの修正指示\n\n1. **target**: `moc`\n   - 理由: why\n2. **target**: `c1`\n   - 修正方針: how\n\n上記指示に従って該当箇所だけを修正し、JSON 全体を再出力してください。"
    assert one(spark, blocks.review_block(F.col("s"), F.col("f")), ("fine", []), fixes) == ""
    assert one(spark, blocks.known_terms(F.col("t")), ([("Claud", "Claude"), ("X", "X")],), "t array<struct<system_term:string,resolved:string>>").endswith("\n- Claud → Claude\n- X")
    assert one(spark, blocks.description_block(F.col("d"), 5), ("12345678",), "d string").endswith("<untrusted_content>\n12345\n</untrusted_content>") and one(spark, blocks.description_block(F.col("d"), 5), ("",), "d string") == ""
    step = "g string, c array<struct<start:double,text:string>>, r string"
    body = one(spark, blocks.no_step(F.col("g"), F.lit(60), F.lit(120), F.lit("u"), F.col("c"), F.col("r")), ("", [(59.0, "no"), (60.0, " a  b "), (119.0, "c"), (120.0, "no")], "time"), step)
    assert body.startswith("## ゴール\n\nこの区間の内容を実践する。\n\n## 手順\n\n1. [01:00〜02:00](u&t=60) を視聴し") and body.endswith("(原因: time)\n\n冒頭の文字起こし抜粋:\n\n> a b c")
    assert one(spark, blocks.no_summary(F.col("r")), ("why",), "r string").startswith("## 全体サマリ\n\n要約の自動生成に失敗しました (why)。")
    moc = one(spark, blocks.with_orphans(F.col("b"), F.col("s"), F.lit(True)), ("text [[b]]\n", ["b", "c", "a"]), "b string, s array<string>")
    assert moc == "text [[b]]\n\n## 未掲載のステップ (自動追記)\n\n- [[a]]\n- [[c]]\n\n- 巻末まとめ: [[99_QA_Tipsまとめ]]"
    insights = "b string, i array<struct<label:string,start_sec:int,summary:string,quote:string,link:string>>"
    assert one(spark, blocks.with_all_insights(F.col("b"), F.col("i"), F.lit("u")), ("has [01:05]", [("qa", 65, "x", "", None), ("qa", 5, " s  t ", "", "01_A"), ("tips", 7, "", "", None)]), insights) == "has [01:05]\n\n## 補遺 (自動追記)\n\n- [00:05](u&t=5) [Q&A] s t (→ [[01_A]])\n- [00:07](u&t=7) [Tips] (内容未取得)"


def test_json_texts(spark):
    topics = "t array<struct<topic_id:string,label:string,aliases:array<string>,source_videos:array<string>,duplication_count:bigint,category:string,summary:string,excerpts:array<struct<video_id:string,range_str:string,quote:string>>>>"
    got = json.loads(one(spark, blocks.topics_json(F.col("t")), ([("t001", "L", ["a"], ["v"], 1, "unique", None, [("v", "r", "q")])],), topics))
    assert got == {"topics": [{"topic_id": "t001", "label": "L", "aliases": ["a"], "source_videos": ["v"], "duplication_count": 1, "category": "unique", "summary": None, "excerpts": [{"video_id": "v", "range": "r", "quote": "q"}]}]}
    assert list(got["topics"][0])[-1] == "excerpts"
    entries = "e array<struct<canonical:string,aliases:array<string>,reading:string,category:string>>"
    assert json.loads(one(spark, blocks.glossary_json(F.col("e")), ([("A", [], "", ""), ("B", ["b"], "r", "")],), entries)) == {"version": 1, "entries": [{"canonical": "A"}, {"canonical": "B", "aliases": ["b"], "reading": "r"}]}
    assert json.loads(one(spark, blocks.coverage_json(F.col("a"), F.col("b")), (["x"], []), "a array<string>, b array<string>")) == {"covered_topic_ids": ["x"], "missing_topic_ids": []}


def test_materials_zip_by_position(spark):
    videos = spark.createDataFrame([("p", 5, "v2", "B"), ("p", 1, "v1", ""), ("q", 0, "v3", "C")], "playlist string, pos int, video_id string, title string")
    bodies = spark.createDataFrame([("p", 0, "first " * 9), ("p", 9, "second"), ("q", 4, "third")], "playlist string, pos int, body string")
    got = {r["playlist"]: r["content"] for r in ops.materials(videos, bodies, budget=20).collect()}
    assert got == {"p": "## VIDEO: v1: Untitled\n\nfirst firs\n\n---\n\n## VIDEO: v2: B\n\nsecond", "q": "## VIDEO: v3: C\n\nthird"}
    with pytest.raises(PySparkException):
        ops.materials(videos, bodies.limit(2)).collect()


def test_notes_and_reports(spark):
    at = F.lit("2024-05-06 07:08:00").cast("timestamp")
    videos = spark.createDataFrame([(0, "abcdefghijk", "T: x", "cat/List"), (1, "bbbbbbbbbbb", "T x", "List"), (2, "ccccccccccc", None, None)], "pos int, video_id string, title string, playlist_title string")
    rows = {(r["video_id"], r["unit"]): r for r in ops.placeholder_notes(videos, at, "base").collect()}
    assert len(rows) == 9 and rows["abcdefghijk", "summary"]["path"] == "base/02_Summary_Processing_Unit/2024-05-06-0708 List/2024-05-06-0708 T x.md"
    assert rows["bbbbbbbbbbb", "summary"]["path"].endswith("T x-2.md") and 'reviewed: "false"' in rows["abcdefghijk", "summary"]["content"] and "reviewed" not in rows["abcdefghijk", "capture"]["content"]
    loops = spark.createDataFrame([("f", 1, {"coverage": "ok"}, ["v1"], True, False, None), ("f", 2, {}, [], False, True, "done")], "folder string, iteration int, summaries map<string,string>, regenerated_video_ids array<string>, synthesis_rerun boolean, stopped boolean, stop_reason string")
    found = spark.createDataFrame([("f", 1, "f002", "pedagogy", "low", "05", "", ["t"], None, "d2", "s"), ("f", 1, "f001", "coverage", "high", "04", "v1", [], 3, "d1", "s")], "folder string, iteration int, finding_id string, perspective string, severity string, target_scope string, target_video_id string, topic_ids array<string>, chapter_index int, description string, suggested_fix string")
    got = {r["path"]: json.loads(r["content"]) for r in ops.evaluation_loops(loops, found).collect()}
    first = got["f/_meta/evaluation/loop_1.json"]
    assert first["blocking_count"] == 1 and first["perspectives"]["coverage"]["summary"] == "ok" and first["perspectives"]["coverage"]["findings"][0]["chapter_index"] == 3 and got["f/_meta/evaluation/loop_2.json"]["perspectives"]["fidelity"] == {"summary": "", "findings": []}
    summary = ops.evaluation_summaries(loops, found).first()["content"]
    assert summary == "# 評価サマリ\n\n- ループ実行回数: 2\n\n## ループ 1\n- blocking(high): 1 / 全 finding: 2\n- coverage: 1 / pedagogy: 1 / fidelity: 0\n- 04 再生成: v1\n- 05 再合成: あり\n  - [coverage] d1 (→ v1)\n\n## ループ 2\n- blocking(high): 0 / 全 finding: 0\n- coverage: 0 / pedagogy: 0 / fidelity: 0\n- 05 再合成: なし\n- 停止理由: done\n"
    steps = spark.createDataFrame([("f", "01_A.md", "abcdefghijk", 1, "A", 60, 90, "c.webp", "body [01:05]\n", [("qa", 65, "in", ""), ("tips", 70, "new", "")])], "folder string, filename string, video_id string, index int, label string, start_sec int, end_sec int, embed string, body string, insights array<struct<label:string,start_sec:int,summary:string,quote:string>>")
    note = ops.step_notes(steps, at).first()
    assert note["path"] == "f/01_A.md" and note["content"].endswith("\n---\n\n[01:00 〜 01:30](https://www.youtube.com/watch?v=abcdefghijk&t=60)\n\n![[c.webp]]\n\nbody [01:05]\n\n> [!tip] Tips [01:10]: new\n")
    plans = spark.createDataFrame([("f", "full", [("t1", "L", ["a"], ["v"], 1, "unique", "s", "x")], [(1, "C", "core", ["t1"], "r")], ["t1"], [], "skipped", None)], "folder string, profile string, topics array<struct<topic_id:string,label:string,aliases:array<string>,source_videos:array<string>,duplication_count:int,category:string,summary:string,excerpts:string>>, chapters array<struct<index:int,label:string,category:string,topic_ids:array<string>,rationale:string>>, covered_topic_ids array<string>, missing_topic_ids array<string>, reviewer_status string, reviewer struct<needs_revision:boolean,summary:string,fixes:array<struct<target:string,reason:string,patch_hint:string>>>")
    meta = ops.synthesis_meta(plans).first()
    assert meta["path"] == "f/_meta/duplicate_score.json" and list(json.loads(meta["content"])) == ["profile", "topics", "chapters", "coverage", "reviewer_status"] and "excerpts" not in meta["content"]
