"""Every registered query over whole small tables with odd rows: columns, types, thresholds, and what may not matter to a result."""

import html
import re
import shutil
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import queries as llm
from lorespark.llm import htmlmain, langid, mixing, quality, toxicity
from lorespark.llm.common import clear, drop, new_path, remainder, shared_dir, store

TABLES = ("documents", "labels", "pages", "embeddings", "benchmark")
COLUMNS = {
    "op1_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_token_binary": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op4_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_decontamination": "doc_id bigint, item_id bigint, score double",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_minhash_near_dedup": "doc_id bigint, class_id bigint, kept boolean",
    "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op13_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}
QUERIES = llm.queries()


def write(spark, folder, change):
    """The smallest tables, each passed through ``change``."""
    for name in TABLES:
        change(name, spark.read.parquet(str(DATA / f"{name}.parquet"))).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd(spark):
    """Rows with nulls in every column, empty, blank, symbolic and very long texts, repeated rows and clashing columns."""

    def change(name, rows):
        docs = "doc_id long, text string, lang string, source string, n_chars long"
        long_text = " ".join(f"w{k % 977}" for k in range(120_000))
        extra = {
            "documents": ([(None, "no id here", None, None, None), (None, None, None, None, None), (90_000, None, "en", "s", 0), (90_001, "", "en", None, 0), (90_002, " \n\t", None, "s", 3), (90_003, "\U0001f600\U0001f680", "en", "s", 2), (90_004, long_text, "en", "s", 1), (90_005, "x" * 300_000, None, "s", 1), (90_006, "same row", "en", "s", 8), (90_006, "same row", "en", "s", 8)], docs),
            "labels": ([(None, 1, 1), (90_001, None, None), (90_006, 1, 0), (90_006, 1, 0)], "doc_id long, quality int, toxic int"),
            "pages": ([(None, None, None), (90_000, "u", ""), (90_001, None, "<p>" * 3000 + "deep"), (90_001, None, "<p>" * 3000 + "deep")], "page_id long, url string, html string"),
            "embeddings": ([(None, [1.0] * 64, 1), (90_000, None, 1), (90_001, [0.0] * 64, 1), (90_002, [float("nan")] * 64, 1), (90_003, [1.0] * 64, None), (90_004, [2.0] * 64, 1), (90_004, [2.0] * 64, 1)], "vec_id long, embedding array<double>, label int"),
            "benchmark": ([(None, "no id"), (90_000, None), (90_001, "")], "item_id long, text string"),
        }[name]
        more = spark.createDataFrame(*extra)
        rows = rows.unionByName(more.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c in more.columns]), allowMissingColumns=True)
        clash = {"documents": ("score", "size", "taken", "predicted", "held_out", "class_id", "lang_pred", "_id"), "pages": ("text", "n_chars"), "embeddings": ("node", "n", "cell", "kept"), "benchmark": ("doc_id", "score"), "labels": ("text", "score")}[name]
        return rows.withColumns({c: F.lit("clash") for c in clash})

    return change


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), odd(spark))


@pytest.fixture(scope="module")
def results(spark, odd_dir):
    return {name: (query(spark, odd_dir).schema.fields, query(spark, odd_dir).collect()) for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, odd_dir, results, name):
    fields, rows = results[name]
    wanted = COLUMNS[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in fields][: len(wanted)] == wanted
    source = {"op3_embedding_near_dedup": "embeddings", "op9_html_extraction": "pages"}.get(name, "documents")
    if name != "op6_decontamination":
        key = wanted[0].split()[0]
        given = [r[0] for r in spark.read.parquet(f"{odd_dir}/{source}.parquet").select(key).collect()]
        assert sorted(map(str, given)) == sorted(str(r[key]) for r in rows)


@pytest.mark.parametrize("name,mod,held,column,least", [("op5_toxicity", 4, 2, "predicted", 0.3), ("op10_quality", 4, 2, "predicted", 0.7), ("op7_language_id", 3, 1, None, None)])
def test_held_out_rows_and_thresholds(results, name, mod, held, column, least):
    for r in results[name][1]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == held)
        assert 0 <= r["score"] <= 1 and (column is None or r[column] == int(r["score"] >= least))


def test_texts_without_letters_are_of_no_language(results):
    by = {r["doc_id"]: r for r in results["op7_language_id"][1]}
    assert {by[k]["lang_pred"] for k in (90_000, 90_001, 90_002, 90_003)} == {"und"} and by[90_006]["lang_pred"] != "und"


def test_labels_of_held_out_rows_do_not_matter(spark, odd_dir, results, tmp_path):
    for name in TABLES:
        shutil.copytree(f"{odd_dir}/{name}.parquet", f"{tmp_path}/{name}.parquet") if name not in ("labels", "documents") else None
    labels, docs = (spark.read.parquet(f"{odd_dir}/{n}.parquet") for n in ("labels", "documents"))
    held = remainder(F.col("doc_id"), 4) == 2
    labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}).write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumns({"lang": F.when(remainder(F.col("doc_id"), 3) == 1, F.lit("zz")).otherwise(F.col("lang")), "source": F.lit("other")}).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op5_toxicity", "op7_language_id", "op10_quality"):
        assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(str, results[name][1])), name


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, tmp_path, name):
    folder = write(spark, tmp_path, lambda _, rows: rows.limit(0))
    assert QUERIES[name](spark, folder).count() == 0


def test_pages_give_their_article(spark):
    def gold(page):
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S).group(1))
        return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if t)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(str(DATA / "pages.parquet")).collect()}
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op9_html_extraction"](spark, str(DATA)).collect()} == {k: (gold(p), len(gold(p))) for k, p in pages.items()}


# Scores against plain loops

def test_quality_is_the_plain_loop_over_passages():
    texts = [" ".join(f"Word{k % (7 + i)}," for k in range(40 * i + 5)) for i in range(12)]
    model = quality.train(texts, np.array([i % 2 for i in range(12)]), steps=20)
    w, sig = model.weights, lambda x: 1 / (1 + np.exp(-x))
    for text in [*texts[:4], "", "one"]:
        found, _ = quality.passages([text])
        hidden, energies = [], []
        for features in found:
            h = np.tanh(np.clip((features - model.mean) / model.scale, -8, 8) @ w["encode"] + w["encode_bias"])
            hidden.append(h)
            energies.append(float((np.tanh(h @ w["attend"]) * sig(h @ w["gate"])) @ w["attention"]))
        attention = np.exp(energies) / np.exp(energies).sum()
        z = sum(a * h for a, h in zip(attention, hidden))
        assert model.score([text])[0] == pytest.approx(sig(z @ w["out"] + w["out_bias"]), abs=1e-9)


def test_language_is_the_plain_loop_over_pieces():
    texts = ["the cat and the dog", "der hund und die katze", "a b c the", "und der die das"] * 3
    model = langid.train(texts, ["en", "de"] * 6, landmarks=6)
    for text in ("the hund", "katze " * 250 + "cat"):
        h, piece, n = langid.grams(text)
        values = []
        for k in range(n):
            own = set(h[piece == k].tolist()) & set(model.vocabulary.tolist())
            row = np.isin(model.vocabulary, list(own))
            values.append((row @ model.presence) / np.sqrt(max(len(own), 1)) @ model.weights)
        assert model.scores([text])[0] == pytest.approx(np.mean(values, 0), abs=1e-4)


def test_toxicity_finds_the_sentence_it_scores(spark):
    model = toxicity.Model({"=vile": 9.0}, -6.0)
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "Fine. A vile one! Fine."), (2, "Fine."), (3, None), (None, "vile")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["start"], r["end"]) for r in toxicity.offending(docs, model).collect()), key=str) == [(big, 5, 17), (None, 0, 4)]


# The pipeline

def test_stages_on_odd_rows_and_empty_tables(spark, odd_dir, tmp_path):
    empty = write(spark, tmp_path, lambda _, rows: rows.limit(0))
    for folder in (odd_dir, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count() * (3 if name == "mixing" else 1)
        assert stage_rows(spark, folder) >= 0


def stage_rows(spark, folder):
    return corpus_pipeline.run(spark, folder).count()


def test_quality_stage_keeps_what_scores_enough(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op10_quality"](spark, odd_dir).collect() if r["doc_id"] is not None}
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, odd_dir).select("doc_id").collect() if r["doc_id"] is not None}
    assert kept == {k for k, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY}


def test_mixing_stage_takes_whole_passes(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").filter("doc_id is not null")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_report(docs).collect()}
    times = {r["doc_id"]: r["count"] for r in corpus_pipeline.mixing_stage(spark, docs, odd_dir).groupBy("doc_id").count().collect()}
    for key, (size, words) in taken.items():
        if key != 90_006:  # two equal rows
            assert times.get(key, 0) == (words // size + (2 * (words % size) >= size > 0 and words % size > 0) if size else 0)
    again = [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs.repartition(9), odd_dir).collect()]
    assert again == [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, odd_dir).collect()]


# Stored tables

def test_stored_tables_can_be_dropped(spark):
    import os

    kept, gone = store(spark.range(3), "kept"), store(spark.range(4), "gone")
    drop(gone)
    folder = os.path.dirname(new_path(spark, "x"))
    assert kept.count() == 3 and folder.startswith(shared_dir(spark)) and not any(n.startswith("gone-") for n in os.listdir(folder))
    assert htmlmain.main_text(None, htmlmain.Weights([])) == "" and callable(clear)
