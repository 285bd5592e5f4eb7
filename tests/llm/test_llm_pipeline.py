"""The pipeline's stages, each on its own input, against brute force."""

import pytest
from conftest import DATA

import corpus_pipeline
from lorespark.llm import words
from lorespark.llm.common import store


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(str(DATA / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        kept = store(stage(spark, docs, str(DATA)), name)
        out.append((name, docs, kept))
        docs = kept
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    for _, before, after in stages[:-1]:
        assert before.columns == after.columns and after.count() > 0


def test_near_dedup_leaves_no_pair(stages):
    _, before, after = stages[1]
    sets = {r["doc_id"]: words.shingles(r["text"], 5) for r in after.collect()}
    keys = sorted(sets)
    assert all(words.jaccard(sets[a], sets[b]) < 0.8 for n, a in enumerate(keys) for b in keys[:n])
    everything = {r["doc_id"]: words.shingles(r["text"], 5) for r in before.collect()}
    assert all(any(words.jaccard(s, t) >= 0.8 for k, t in everything.items() if k != i) for i, s in everything.items() if i not in sets)


def test_decontamination_drops_copies(spark, stages):
    _, before, after = stages[2]
    items = [" ".join(words.words(r["text"])) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
    texts = {r["doc_id"]: " ".join(words.words(r["text"])) for r in before.collect()}
    left = {r["doc_id"] for r in after.collect()}
    assert {i for i, t in texts.items() if any(x in t for x in items)} == set(texts) - left


def test_tokens_cover_the_mix(stages):
    _, before, after = stages[4]
    rows = after.orderBy("start").collect()
    assert len(rows) == before.count()
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))


def test_queries_return_their_columns(spark):
    from lorespark.llm import queries

    for name, function in queries.queries().items():
        rows = function(spark, str(DATA))
        assert rows.columns[0] in ("doc_id", "page_id", "vec_id"), name
