"""Spellings found by an automaton: the same as one pattern of all of them, and fast for many."""

import re
import time

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from lorespark.functions.python import rewritten_terms
from lorespark.functions.variants import MOST_CHARS, Variants, in_lower_case
from lorespark.operators import rollups


def pattern(spellings):
    word = "A-Za-z0-9_"
    edge = lambda c: c.isascii() and (c.isalnum() or c == "_")
    one = lambda s: (f"(?<![{word}])" if edge(s[0]) else "") + re.escape(s) + (f"(?![{word}])" if edge(s[-1]) else "")
    return re.compile("|".join(map(one, sorted(spellings, key=len, reverse=True))), re.I)


def test_variants_are_what_one_pattern_finds():
    rng = np.random.default_rng(3)
    parts = ["a", "A", "b", "ab", " ", "-", "é", "É", "日", "本", "_", "1", "K", "ſ", "s", "k", "\U0001f600", "İ"]
    for _ in range(300):
        spellings = {"".join(rng.choice(parts, int(rng.integers(1, 5)))).strip() for _ in range(6)} - {""}
        variants = Variants([("Zcanon", sorted(spellings))])
        finder = pattern(spellings)
        for _ in range(5):
            text = "".join(rng.choice(parts, 40))
            assert [(s, e) for s, e, _ in variants.find(text)] == [m.span() for m in finder.finditer(text)], (spellings, text)


def test_lower_case_keeps_places():
    text = "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert len(in_lower_case(text)) == len(text) and in_lower_case("ſK") == "sk"


def test_many_spellings_over_documents(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text").filter("text is not null")
    real = sorted({w for r in docs.limit(50).collect() for w in re.findall(r"[A-Za-z]{5,}", r["text"])}, key=str.casefold)
    few = [(f"Canon{k}", [w]) for k, w in enumerate({w.casefold(): w for w in real}.values())][:40]
    many = few + [(f"Other{k}", [f"zq{k}x", f"zq{k}y"]) for k in range(50_000)]
    began = time.perf_counter()
    got = sorted(map(tuple, rollups.fidelity(docs, "doc_id", "text", many, 20).collect()))
    assert time.perf_counter() - began < 60
    finder = pattern([a[0] for _, a in few])
    owner = {a[0].lower(): c for c, a in few}
    want = []
    for r in docs.collect():
        found = {}
        for m in finder.finditer(r["text"]):
            found.setdefault(owner[m.group().lower()], {})[m.group()] = None
        want += [(r["doc_id"], c, "、".join(s), k) for k, (c, s) in enumerate(list(found.items())[:20], 1)]
    assert got == sorted(want) and want


def test_glossaries_have_a_bound(monkeypatch, spark):
    import pytest

    from lorespark.functions import variants

    assert MOST_CHARS >= 2_000_000
    monkeypatch.setattr(variants, "MOST_CHARS", 5)
    with pytest.raises(ValueError):
        Variants([("A", ["spelling"])])
    assert spark.range(1).select(rewritten_terms(F.lit("same"), [])).first()[0] == "same"


def test_findings_are_numbered_and_texts_read_once(spark):
    texts = spark.createDataFrame([(k, f"vari{k % 3} and vari{k % 2}") for k in range(40)], "doc_id long, text string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    found = rollups.fidelity(texts.mapInPandas(counted, texts.schema), "doc_id", "text", [(f"Canon{k}", [f"vari{k}"]) for k in range(3)], 20)
    got = [tuple(r) for r in rollups.finding_ids(found, ["doc_id", "rank"]).orderBy("finding_id").collect()]
    assert [r[-1] for r in got] == [f"f{k:03d}" for k in range(1, len(got) + 1)] and [r[:1] + r[3:4] for r in got] == sorted(r[:1] + r[3:4] for r in got)
    assert reads.value == 40
