from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lorespark.operators import intervals, rollups
from lorespark.operators import sequences as seq
from lorespark.sources import readers, writers


def chunks(spark, starts, texts=None, width=30.0):
    rows = [("v", i, s, (texts or "abcdefghijklmnopqrstuvwxyz")[i]) for i, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "video_id string, pos int, start double, text string")
    out = seq.anchor_chunks(df, ["video_id"], ["pos"], "start", width).groupBy("chunk").agg(F.first("chunk_start").alias("s"), seq.joined_text("text", ["pos"]).alias("t"))
    return [(r["s"], r["t"]) for r in out.orderBy("chunk").collect()]


def test_anchor_chunks(spark):
    assert chunks(spark, [0.0, 10.0, 30.0, 40.0]) == [(0.0, "a b"), (30.0, "c d")]
    assert [c[0] for c in chunks(spark, [5.0 * k for k in range(20)])] == [0.0, 30.0, 60.0, 90.0]
    assert [c[0] for c in chunks(spark, [0.0, 32.0, 67.0])] == [0.0, 32.0, 67.0]
    assert chunks(spark, [50.0, 10.0, 80.0], ["  x ", "", "y\nz"]) == [(50.0, "x"), (80.0, "y z")]
    assert chunks(spark, []) == []
    with pytest.raises(ValueError):
        chunks(spark, [0.0], width=0)


def repaired(spark, spans, duration, points=()):
    kind = {"L": "lecture", "Q": "qa", "T": "tips"}
    rows = [("v", i, a, b, kind[k], "") for i, (a, b, k) in enumerate(spans)]
    df = spark.createDataFrame(rows, "video_id string, pos int, start_sec long, end_sec long, label string, summary string").withColumn("duration", F.lit(duration).cast("long"))
    pts = spark.createDataFrame([("v", p) for p in points], "video_id string, start_sec long")
    return [(r["start_sec"], r["end_sec"], r["label"][0].upper()) for r in intervals.repaired_segments(df, pts, "video_id").orderBy("pos").collect()]


def test_interval_repair(spark):
    assert repaired(spark, [(0, 300, "L"), (600, 900, "Q")], 900) == [(0, 600, "L"), (600, 900, "Q")]
    nested = [(0, 1000, "L"), (100, 200, "Q"), (150, 180, "T")]
    assert repaired(spark, nested, 1000) == [(0, 100, "L"), (100, 150, "Q"), (150, 180, "T"), (180, 200, "Q"), (200, 1000, "L")]
    assert repaired(spark, [(0, 644, "L"), (644, 900, "Q")], 900, [600])[0][1] == 600
    assert repaired(spark, [(0, 646, "L"), (646, 900, "Q")], 900, [600])[0][1] == 646
    assert repaired(spark, [(0, 400, "L"), (300, 700, "Q")], 900) == [(0, 400, "L"), (400, 900, "Q")]
    assert repaired(spark, [(0, 10, "L"), (10, 500, "Q")], 500) == [(0, 500, "Q")]
    assert repaired(spark, [(700, 800, "L")], 600) == []


def owners(spans, duration):
    """The owner of each second, by looking at every segment that covers it."""
    kept = sorted((max(0, min(a, duration)), max(0, min(b, duration)), i, k) for i, (a, b, k) in enumerate(spans))
    kept = [s for s in kept if s[0] < s[1]]
    if not kept:
        return []
    kept[0] = (0, *kept[0][1:])
    out = []
    for second in range(duration):
        had = None
        for s in kept:
            if s[0] <= second < s[1]:
                had = s if had is None or (s[1] <= had[1] and s[3] != "L") else had
        out.append(had or out[-1])
    return out


def test_interval_repair_of_deeply_nested_segments():
    import time

    def seconds(n):
        began, sweep = time.process_time(), intervals._Open(4 * n)
        for k in range(n):
            sweep.add(k, k, 4 * n - k if k % 3 else 2 * n + k // 7, k % 5 == 0, {"pos": k})
        sweep.tell()
        return time.process_time() - began, sweep.told

    (small, told), (large, _) = seconds(2_000), seconds(100_000)
    assert large < 200 * small + 2
    segments = [(k, 8_000 - k if k % 3 else 4_000 + k // 7, k % 5 == 0) for k in range(2_000)]
    for at, own in told[:: 97]:
        covering = [(k, end, lecture) for k, (start, end, lecture) in enumerate(segments) if start <= at < end]
        had = covering[0] if covering else None
        for new in covering[1:]:
            had = new if new[1] <= had[1] and not new[2] else had
        assert (own and own["pos"]) == (had and had[0])


def test_interval_repair_by_owners_of_seconds(spark):
    import random
    from itertools import groupby

    rng = random.Random(3)
    talks = {}
    for talk in range(120):
        duration = rng.randint(1, 300)
        talks[talk] = duration, [(rng.randint(-20, duration), rng.randint(0, duration + 30), rng.choice("LQT")) for _ in range(rng.randint(1, 7))]
    kind = {"L": "lecture", "Q": "qa", "T": "tips"}
    rows = [(t, i, a, b, kind[k], str(i), d) for t, (d, spans) in talks.items() for i, (a, b, k) in enumerate(spans)]
    df = spark.createDataFrame([*rows, (None, 0, 0, 9, "qa", "", 10), (999, 0, 0, 9, "qa", "", None)], "video_id int, pos int, start_sec long, end_sec long, label string, summary string, duration long")
    pts = spark.createDataFrame([], "video_id int, start_sec long")
    got = {}
    for r in intervals.repaired_segments(df, pts, "video_id").orderBy("video_id", "pos").collect():
        got.setdefault(r["video_id"], []).append((r["start_sec"], r["end_sec"], int(r["summary"])))
    for t, (duration, spans) in talks.items():
        runs, at = [], 0
        for owner, seconds in groupby(owners(spans, duration)):
            length = len(list(seconds))
            runs.append([at, at + length, owner[2]])
            at += length
        merged = []
        for run in runs:
            if merged and spans[run[2]][2] == "L" and run[1] - run[0] < 20:
                merged[-1][1] = run[1]
            else:
                merged.append(run)
        if len(merged) > 1 and spans[merged[0][2]][2] == "L" and merged[0][1] - merged[0][0] < 20:
            merged[1][0] = 0
            merged.pop(0)
        assert got.get(t, []) == [tuple(m) for m in merged], (spans, duration)


def test_anchor_chunks_of_null_keys_and_starts(spark):
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(None, 0, 0), (None, 1, 5), (None, 2, 40), (big, 0, None), (big, 1, 7), (big, 2, 30), (big, 3, 40), (big - 1, 0, 3)], "k long, pos int, at long")
    before = rows.schema.simpleString()
    for _ in range(2):
        got = sorted((tuple(r) for r in seq.anchor_chunks(rows, ["k"], ["pos"], "at", 30).collect()), key=str)
    assert rows.schema.simpleString() == before
    expected = [(None, 0, 0, 0, 0), (None, 1, 5, 0, 0), (None, 2, 40, 1, 40), (big, 0, None, 0, None), (big, 1, 7, 0, 7), (big, 2, 30, 0, 7), (big, 3, 40, 1, 40), (big - 1, 0, 3, 0, 3)]
    assert got == sorted(expected, key=str)


def test_unique_paths_never_meet(spark):
    rows = [("d", i, b) for i, b in enumerate(["x", "x", "x-2", "x-2", "x", "y", "y", "x-2-2", "-2", "-2", "z-9"])] + [("e", 99, "x-2")]
    got = {r["pos"]: r["path"] for r in seq.unique_paths(spark.createDataFrame(rows, "f string, pos int, base string"), "f", "base", ["pos"], "md").collect()}
    taken = set()
    for folder, pos, base in rows:
        name, n = f"{folder}/{base}.md", 1
        while name in taken:
            n += 1
            name = f"{folder}/{base}-{n}.md"
        taken.add(name)
        assert got[pos] == name


def test_nearest_of_many_rows_of_one_key(spark):
    import time

    rows = spark.range(40_000).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("at"))
    began = time.perf_counter()
    found = seq.nearest(rows, rows.select("k", (F.col("at") + 4).alias("t")), ["k"], "at", "t", 4.0)
    assert found.filter("snapped = at + 4").count() == 40_000 and time.perf_counter() - began < 60


def test_write_cache_twice(spark, tmp_path):
    path = f"{tmp_path}/cache"
    entries = spark.createDataFrame([("aa", 2, "late"), ("aa", 1, "early"), ("bb", 1, "b"), (None, 1, "x")], "key string, pos int, value string")
    assert writers.read_cache(spark, path, entries.schema).count() == 0
    writers.write_cache(entries, path, "pos")
    writers.write_cache(entries.unionByName(spark.createDataFrame([("cc", 1, "c"), ("aa", 0, "newer")], entries.schema)), path, "pos")
    assert sorted((r["key"], r["value"]) for r in writers.read_cache(spark, path, entries.schema).collect()) == [("aa", "early"), ("bb", "b"), ("cc", "c")]
    assert spark.read.parquet(path).count() == 3


def test_caches_of_parallel_writers_lose_and_repeat_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/cache"
    sets = [spark.createDataFrame([(f"k{k}", 1, f"w{w}") for k in range(w * 10, w * 10 + 30)], "key string, pos int, value string") for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda s: writers.write_cache(s, path, "pos"), sets))
    got = [r["key"] for r in writers.read_cache(spark, path, sets[0].schema).collect()]
    assert sorted(got) == sorted(f"k{k}" for k in range(60))
    writers.write_cache(sets[0], path, "pos")
    assert [r["value"] for r in writers.read_cache(spark, path, sets[0].schema).filter("key = 'k0'").collect()] == ["w0"]


def test_fidelity_refuses_a_spelling_of_two_terms(spark):
    texts = spark.createDataFrame([("v", "Spark ｓｐａｒｋ")], "video_id string, text string")
    with pytest.raises(ValueError):
        rollups.fidelity(texts, "video_id", "text", [("Spark", ["sprak"]), ("Spork", ["ＳＰＲＡＫ"])], 20)
    assert rollups.fidelity(texts, "video_id", "text", [("Spark", ["ｓｐａｒｋ"])], 20).count() == 0


def test_topic_merge(spark):
    rows = [
        (0, 0, "Concept A", ["x", "x", "z"], ["v1", "v1"], "", [("v1", "00:01 ~ 00:02", "one")]), (0, 1, "B", None, [""], "", None), (1, 0, "concept a ", ["y", "x", "y"], ["v2", "v1"], "s", [("v2", "r", "two"), ("v2", "r", "two")]),
        (1, 1, " ", ["lost"], ["v9"], "", None), (2, 0, "\u3000CONCEPT A", ["w"], None, "late", []),
    ]
    topics = spark.createDataFrame(rows, "batch int, pos int, label string, aliases array<string>, source_videos array<string>, summary string, excerpts array<struct<video_id:string,range_str:string,quote:string>>")
    got = [tuple(r) for r in rollups.merged_topics(topics, ["batch", "pos"]).orderBy("topic_id").collect()]
    quotes = [("v1", "00:01 ~ 00:02", "one"), ("v2", "r", "two"), ("v2", "r", "two")]
    assert got == [("t001", "Concept A", ["x", "x", "z", "y", "w"], ["v1", "v2"], 2, "supporting", "s", quotes), ("t002", "B", [], [""], 1, "unique", "", [])]


def test_run_totals(spark):
    runs = spark.createDataFrame([("a", True, "qa", 50), ("a", None, "tips", None), ("a", False, "qa", 80), (None, True, None, 1)], "k string, ok boolean, label string, s int")
    got = {r["k"]: tuple(r)[1:] for r in rollups.run_totals(runs, ["k"], F.col("ok"), {"qa": F.col("label") == "qa"}, F.col("s")).collect()}
    assert got == {"a": (1, 2, 2, 2), None: (1, 0, 0, 0)}


def test_first_of_each_text(spark):
    rows = spark.createDataFrame([(3, "x", "c"), (1, "x", "a"), (2, None, "n"), (5, None, "m"), (4, "", "e")], "id int, t string, v string")
    assert sorted(map(tuple, rollups.first_of_each_text(rows, F.col("t"), "id", ["id", "v"]).collect())) == [(1, "a"), (2, "n"), (4, "e")]


def test_cost_breakdown(spark):
    rows = [(0, Decimal(".01"), None, None), (1, Decimal(".01"), "m", Decimal(".05")), (2, None, "m", Decimal(".05"))]
    runs = spark.createDataFrame(rows, "pos int, c2 decimal(18,6), m string, c4 decimal(18,6)")
    got = {r["stage"]: (float(r["cost"]), r["model"]) for r in rollups.cost_breakdown(runs, [("02", "c2", "m"), ("04", "c4", "m")], "pos").collect()}
    assert got == {"02": (0.02, "?"), "04": (0.1, "m"), "total": (0.12, None)}


def test_fidelity_caps_terms(spark):
    glossary = [(f"Canon{k}", [f"vari{k}"]) for k in range(5)]
    texts = spark.createDataFrame([("v", " ".join(f"vari{k}" for k in range(5)) + " VARI0")], "video_id string, text string")
    got = rollups.fidelity(texts, "video_id", "text", glossary, 2).orderBy("rank").collect()
    assert [(r["canonical"], r["surfaces"]) for r in got] == [("Canon0", "vari0、VARI0"), ("Canon1", "vari1")]


def test_shards(spark):
    sizes = lambda n, k: [r["n"] for r in seq.shards(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], k).groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()]
    assert sizes(23, 3) == [8, 8, 7] and sizes(2, 3) == [1, 1]


def test_noun_sheet_round_trip(spark):
    content = "lost\tx\n# comment\n## [v1] Title one\nterm a\tfixed\tmore\nterm b\n\n## [v2] Two\n\tnone\nc\t\n"
    rows = readers.noun_sheets(spark.createDataFrame([("p", content)], "path string, content string"))
    got = [tuple(r) for r in rows.select("video_id", "system_term", "user_correction").orderBy("row_pos").collect()]
    assert got == [("v1", "term a", "fixed\tmore"), ("v1", "term b", ""), ("v2", "c", "")]
    assert writers.rendered_sheet(rows).first()["content"] == "## [v1] Title one\nterm a\tfixed\tmore\nterm b\n\n## [v2] Two\nc\n"


def test_glossary_is_strict():
    assert readers.parse_glossary('{"version": 1, "entries": [{"canonical": "A", "aliases": ["b"]}]}') == [(0, "A", ["b"], "", "")]
    for bad in ('{"entries": [{"canonical": " "}]}', '{"entries": [{"canonical": "A", "x": 1}]}', '{"version": true, "entries": []}', "[]"):
        with pytest.raises(ValueError):
            readers.parse_glossary(bad)


def test_media_and_folders(spark):
    files = spark.createDataFrame([("m/b [abcdefghijk].mp4",), ("m/a [abcdefghijk].MKV",), ("m/x.txt",), ("m/talk.webm",)], "path string")
    got = {r["name"]: (r["video_id"], r["title"]) for r in readers.local_media(files).collect()}
    assert set(got) == {"a [abcdefghijk].MKV", "talk.webm"} and got["a [abcdefghijk].MKV"] == ("abcdefghijk", "a")
    names = ["2024-01-02-0900 Talk", "2024-01-02 My Talk", "2024-01-01 Talk", "2023-02-30 Talk", "2024-01-03 Talk", "2024-01-01 Other"]
    folders = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in readers.candidate_folders(folders, "2024-01-02", "2024-01-02-0900 Talk", "Talk").collect()]
    assert got == ["2024-01-02-0900 Talk", "2024-01-02 My Talk", "2024-01-01 Talk"]


def test_stats_stream(spark, tmp_path):
    from lorespark.schemas import STATS
    from lorespark.streaming import events

    rows = [("v1", "c", "t", "p", "auto", "en", f"2024-01-01 00:{m:02d}:00", None, 1, None) for m in range(3)]
    frame = spark.createDataFrame(rows, STATS.replace("timestamp", "string")).withColumn("retrieved_at", F.to_timestamp("retrieved_at"))
    writers.write_stats(frame, str(tmp_path / "s"))
    stream = events.tier_counts(events.read_stats(spark, str(tmp_path / "s"), STATS + ", stat_date date"))
    done = stream.writeStream.format("memory").queryName("tiers").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination()
    assert [r["videos"] for r in spark.table("tiers").collect()] == [3]
