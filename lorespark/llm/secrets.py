"""Secrets in texts, by regular expressions behind a trigram index.

From every rule's expression a Boolean query over trigrams is derived: trigrams that
each match must contain, joined by AND, or by OR where the expression branches. Texts
are indexed in blocks, as an index's segments are: for each trigram of the queries
the set of the block's texts that contain it. The query of a rule, over those sets,
gives its candidates, which the expression then verifies. Rules without a mandatory
trigram scan all texts. The index lower-cases ASCII letters, and the queries with it.

Kinds ``assign``, ``access`` and ``hex`` are the base; the other rules add spans and
never take one away. Spans are in code points, end exclusive; matches of a kind are
leftmost and do not overlap, and those shorter than the rule demands are dropped.

Defined results: null and empty texts have no spans; repeated rows repeat; an empty
table gives an empty result. Other columns are carried by :func:`scan`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A query is True (no mandatory trigram), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
#: Most strings that a stretch of an expression is spelled out to, and the largest character class that is.
SPELLED, CLASS = 64, 6


def _both(*parts: Query) -> Query:
    left = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not left else left[0] if len(left) == 1 else ("and", tuple(left))


def _either(*parts: Query) -> Query:
    left = list(dict.fromkeys(parts))
    return True if True in left else left[0] if len(left) == 1 else ("or", tuple(left))


def _of_strings(strings: set[str]) -> Query:
    """Every one of the strings' trigrams, of one string or another."""
    return _either(*[_both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _derive(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that the nodes match, or None; the query of the nodes)."""
    exact: set[str] | None = {""}
    run: set[str] = {""}  # what has been spelled out since the last gap
    query: Query = True

    def gap() -> None:
        nonlocal exact, run, query
        query = _both(query, _of_strings(run))
        exact, run = None, {""}

    def add(strings: set[str] | None, inner: Query = True) -> None:
        nonlocal exact, run, query
        if strings is None or len(run) * len(strings) > SPELLED:
            gap()
            query = _both(query, inner)
        if strings is not None:
            run = {a + b for a, b in product(run, strings)}
            exact = run if exact is not None else None

    for op, value in nodes:
        if op is sre.LITERAL:
            add({chr(value).lower()})
        elif op is sre.IN:
            letters: set[str] | None = set()
            for kind, v in value:
                if kind is sre.LITERAL:
                    letters.add(chr(v).lower())
                elif kind is sre.RANGE and v[1] - v[0] < 64:
                    letters |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    letters = None
                    break
            add(letters if letters and len(letters) <= CLASS else None)
        elif op is sre.SUBPATTERN:
            add(*_derive(value[-1]))
        elif op is sre.BRANCH:
            found = [_derive(part) for part in value[1]]
            if all(e is not None for e, _ in found):
                add(set().union(*[e for e, _ in found]))
            else:
                add(None, _either(*[_both(q, _of_strings(e)) if e is not None else q for e, q in found]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            strings, inner_query = _derive(inner)
            if strings is not None and (low, high) == (0, 1):
                add(strings | {""})
            elif low:
                for _ in range(min(low, 8)):
                    add(strings, inner_query)
                if low != high or low > 8:
                    gap()
            else:
                gap()
        elif op is not sre.AT:
            gap()
    if exact is not None:
        return exact, _of_strings(exact)
    return None, _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of ``pattern`` fulfils."""
    return _derive(parser.parse(pattern))[1]


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams_of, query[1]))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that the match, or the group named, must have
    group: int = 0
    any_case: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m.group(self.group)) >= self.least]


#: The base rules, then rules for well-known formats of keys.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs are maximal, so this is [0-9a-f]+ of 24 characters or more
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"sk_live_[0-9A-Za-z]{16,}"),
)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Index:
    """Derives the rules' queries once, and finds the spans of blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # A trigram of other characters than ASCII is not indexed and so never demanded.
        self.queries = [q if all(t.isascii() for t in trigrams_of(q)) else True for q in self.queries]
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.place = np.zeros(1 << 21, np.int16)
        for i, t in enumerate(self.trigrams):
            a, b, c = t.encode()
            self.place[(a << 14) | (b << 7) | c] = i + 1

    def postings(self, texts: list[str]) -> np.ndarray:
        """Trigrams x texts: which text contains which trigram."""
        out = np.zeros((len(self.trigrams) + 1, len(texts)), bool)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(FOLD), np.uint8).astype(np.int32)
            if len(codes) < 3:
                continue
            key = (codes[:-2] << 14) | (codes[1:-1] << 7) | codes[2:]
            plain = (codes < 128)[:-2] & (codes < 128)[1:-1] & (codes < 128)[2:]
            out[self.place[key[plain]], i] = True
        return out[1:]

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, str):
            return postings[self.trigrams.index(query)]
        parts = [self.candidates(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of all spans of each text, in that order."""
        given = [t or "" for t in texts]
        postings = self.postings(given)
        out: list[list[tuple[int, int, int]]] = [[] for _ in given]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in np.flatnonzero(self.candidates(query, postings)):
                out[i] += [(a, k, b) for a, b in rule.spans(given[i])]
        return [sorted(spans) for spans in out]


def scan(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, name: str = "secrets") -> DataFrame:
    """``docs`` with the column ``name``: array of struct(kind, start, end), by start, then kind as listed."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(rules)
        for texts in batches:
            spans = []
            for at in range(0, len(texts), 200):
                spans += index.find(texts.iloc[at : at + 200].tolist())
            yield pd.Series([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in spans], dtype=object)

    return docs.withColumn(name, found(F.col(text)))


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, as text."""
    base = [r.kind for r in BASE]
    spans = scan(docs.select(doc_id, text), text=text).drop(text)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("secrets", _is_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    of_base = joined(F.filter("secrets", lambda s: s["kind"].isin(base)))
    return spans.select(doc_id, *counts, F.sha2(of_base, 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
