"""Resampling, substring repeats and token alignment against brute force, on small tables with nulls, ties, repeats and long texts."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lorespark.llm import queries as llm
from lorespark.llm import crosstok, resample, substrings
from lorespark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


# 13: importance resampling

def drawn_by_hand(docs, target, n=1, buckets=10_000, percent=10, least=20, seed="2024"):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t = (collections.Counter(b for x in of for b in features(x)[1]) for of in ([d[1] for d in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for key, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = percent * len(able) // 100
    rows = [(*r[:4], k + 1 if k < draw else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in out if r[4] < least]
    return sorted(rows, key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_is_the_plain_computation(spark, n):
    rng = np.random.default_rng(n)
    vocabulary = ["Alpha", "beta", "Été", "日本", "x1", "\U0001f600", "gamma", "d"]
    docs = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for k in range(200)]
    docs += [(None, None), (None, "alpha, beta-beta"), (900, ""), (901, " .,\n"), (902, "same words " * 12), (902, "same words " * 12), (902, "other words " * 12), (903, "long " * 40_000)]
    target = ["beta gamma x1 " * 5, None, "", "Été d d"]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("score", "rank", "hash", "bucket", "words", "_part")})
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample_report(frame.repartition(7), items, n=n)
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn_by_hand(docs, target, n)
    drawn = resample.resample(frame, items, n=n)
    assert drawn.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(r["doc_id"]) for r in got.filter("rank is not null").collect())


def test_resampling_without_target_and_with_a_hot_source(spark):
    docs = [(k, "one and the same text " * 5) for k in range(300)]
    frame, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "text string")
    assert sorted((tuple(r) for r in resample.resample_report(frame, none).collect()), key=str) == drawn_by_hand(docs, [])


# 11: token alignment

def aligned_by_hand(texts, path_a, path_b):
    """Rows of the report without ids, groups of each text and the counts of id pairs, by the libraries and plain loops."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(name):
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x..>", name) else name.replace("\u2581", " ").encode()

    counts, found = collections.Counter(), []
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False) if text else None
        ib = b.encode(text) if text else []
        ta, tb = [bytes(letters.get(c, 0) for c in t) for t in ia.tokens] if ia else [], [piece(b.id_to_piece(k)) for k in ib]
        ia = ia.ids if ia else []
        if not text or not b"".join(ta) == b"".join(tb) == b" " + text.encode():
            ia, ib, ta, tb = [], [], [], []
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append(([k for k, e in zip(ia, ends_a) if low < e <= cut], [k for k, e in zip(ib, ends_b) if low < e <= cut]))
            low = cut
        links = [(ia[ends_a.index(c)], ib[ends_b.index(c)]) for c in cuts]
        counts.update(links)
        found.append((len(ia), len(ib), groups, links))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    rows = []
    for na, nb, groups, links in found:
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((na, nb, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return rows, [f[2] for f in found], {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_alignment_is_the_plain_loop(spark):
    paths = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    texts = [r["text"] for r in spark.read.parquet(str(DATA / "documents.parquet")).select("text").limit(60).collect()]
    texts += [None, "", " ", "  two  blanks ", "line\nbreak\ttab", "naïve café", "日本語テキスト and more", "\U0001f600 smile", "a\u2581b", "<|endoftext|> </s> <unk> <0x41>", "same", "same", "don't won't", "x" * 3000, "\x00 nul", "ﬁ １ NFKC", "ა\u0800"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, "another text of an id")]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("row", "pair", "n", "best", "count")}).repartition(3)
    rows, groups, pairs = aligned_by_hand([t for _, t in docs], *paths)
    want = sorted(((key, *row) for (key, _), row in zip(docs, rows)), key=str)
    for broadcast in (crosstok.BROADCAST, 0):
        assert sorted((tuple(r) for r in crosstok.alignment_report(frame, *paths, broadcast=broadcast).collect()), key=str) == want
    assert {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in crosstok.id_pairs(frame, *paths).collect()} == pairs
    for r in crosstok.groups(frame.filter("doc_id <> 5"), *paths).collect():
        cut = lambda ids, ends: [ids[i:j] for i, j in zip([0, *ends], ends)]
        assert list(zip(cut(r["a"], r["a_ends"]), cut(r["b"], r["b_ends"]))) == groups[r["doc_id"]]
    assert crosstok.groups(frame.limit(0), *paths).count() == 0


def test_tokens_without_bytes_are_linked_with_all_that_end_there():
    sizes = np.array([0, 1, 2])
    batch = crosstok.Batch(np.array([2, 0, 1]), np.array([1, 1, 0, 1]), sizes, sizes, np.array([3]), np.array([4]))
    a, b, many = batch.links
    assert list(zip(a.tolist(), b.tolist())) == [(2, 1), (2, 0), (0, 1), (0, 0), (1, 1)] and many.tolist() == [4, 1]
    assert batch.per_text(many).tolist() == [5] and batch.per_text().tolist() == [2]


# 12: substring repeats

def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def gone_by_hand(docs, length):
    """For each row the places of the words that go."""
    owner = {}
    for key, text in docs:
        words = split(text)
        for i in range(len(words) - length + 1 if key is not None else 0):
            window = tuple(words[i : i + length])
            owner[window] = min(owner.get(window, key), key)
    out = []
    for key, text in docs:
        words = split(text)
        starts = [i for i in range(len(words) - length + 1) if key is not None and owner[tuple(words[i : i + length])] < key]
        out.append({k for i in starts for k in range(i, i + length)})
    return out


def passages(seed, n):
    """Documents of few words, so that short windows repeat by chance, with shared passages, copies, near copies and one hot passage."""
    rng = np.random.default_rng(seed)
    hot, out = list(rng.choice(list("abcdef"), 14)), []
    for k in range(n):
        words = list(rng.choice(["a", "b", "c", "é", "Ab", "_", "x\u00a0y"], int(rng.integers(0, 40))))
        if k % 3 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = hot
        if k % 7 == 0 and out:
            words = split(out[int(rng.integers(0, len(out)))][1]) + words[:3]
        if k % 11 == 0:
            words = ["same"] * int(rng.integers(1, 30))
        out.append((int(k), " ".join(words)))
    out += [(7, out[7][1]), (7, "another text of an id " + " ".join(hot)), (None, " ".join(hot)), (None, None), (400, None), (401, ""), (402, " \t\n"), (403, "\n".join(hot) + "\x1f\x85 end"), (404, out[3][1]), (404, out[3][1])]
    return out


@pytest.mark.parametrize("seed,length,gram", [(1, 6, 3), (2, 8, 8), (3, 5, 1), (4, 12, 5)])
def test_substring_repeats_are_the_plain_search(spark, seed, length, gram):
    docs = passages(seed, 150)
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("hash", "anchor", "words", "n_words", "owner", "windows", "value")}).repartition(5)
    gone, rows, left, spans = gone_by_hand(docs, length), [], [], []
    for (key, text), out in zip(docs, gone):
        words = split(text)
        kept = " ".join(w for k, w in enumerate(words) if k not in out)
        rows.append((key, len(words), len(out), hashlib.sha256(kept.encode()).hexdigest()))
        left.append((key, kept if out else text))
    assert sorted((tuple(r) for r in substrings.repeat_report(frame, length=length, gram=gram).collect()), key=str) == sorted(rows, key=str)
    shorter = substrings.remove_repeats(frame, length=length, gram=gram)
    assert shorter.columns == frame.columns and sorted(((r["doc_id"], r["text"]) for r in shorter.collect()), key=str) == sorted(left, key=str)
    covered = collections.defaultdict(set)
    for r in substrings.repeats(frame, length=length, gram=gram).collect():
        assert r["end"] - r["start"] >= length
        covered[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert all(covered[k] == out for (k, _), out in zip(docs, gone) if k not in (None, 7))


def test_a_passage_that_a_third_of_all_documents_share(spark):
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 70)) + (f" {passage} tail{k}" if k % 3 == 0 else "")) for k in range(900)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.repeat_report(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {k: 60 if k % 3 == 0 and k else 0 for k in range(900)}


def test_very_long_texts_repeat(spark):
    long = " ".join(f"w{k * k % 100_003}" for k in range(200_000))
    docs = [(1, long), (2, "begin " + long + " end"), (3, "x" * 1_000_000)]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.repeat_report(spark.createDataFrame(docs, DOCS)).collect()} == {1: (200_000, 0), 2: (200_002, 200_000), 3: (1, 0)}


def test_runs_are_equal_for_equal_words_only():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    for size in range(1, 11):
        want = [tuple(h[i : i + size]) for i in range(len(h) - size + 1)]
        got = substrings.runs(h, size).tolist()
        assert len(got) == len(want) and len(set(got)) == len(set(want))
        assert all((a == b) == (x == y) for a, x in zip(got, want) for b, y in zip(got, want))


# SQL

@pytest.mark.parametrize("name", [n for n in llm.oracle_sql() if n != "op1_mixing"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = llm.queries()[name](spark, str(DATA))
    want = duck.sql(llm.oracle_sql()[name])
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
