"""Spellings of glossary terms in texts, found by one automaton of all spellings.

A text is read once, however many spellings there are. Of the spellings found, the leftmost counts, of those
that start together the longest, and none that overlaps one before it. A spelling is not found inside a longer ASCII word where its
own edge is a letter, digit or underscore of ASCII. Case does not matter, letter by letter, as in a pattern that ignores it.

Executors get the spellings, of at most ``MOST_CHARS`` characters in all, and build the automaton once a worker.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Sequence

#: Most characters of all spellings; a worker's automaton takes about 100 bytes for each.
MOST_CHARS = 10_000_000
_automata: dict[str, object] = {}


def folded(term: str) -> str:
    """The key under which spellings of a term are one: NFKC, then case folding, then stripping."""
    return unicodedata.normalize("NFKC", term).casefold().strip()


class _Letters(dict):
    """One lower-case letter for each letter, so that places in a text stay what they are."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        self[code] = letter = ord((upper if len(upper) == 1 else chr(code)).lower()[0])
        return letter


LETTERS = _Letters()


def in_lower_case(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LETTERS)


def is_word(letter: str) -> bool:
    return letter.isascii() and (letter.isalnum() or letter == "_")


class Variants:
    """The spellings of a glossary, pairs of a canonical term and its aliases, that are not the canonical one's own fold.

    A fold that two terms have is an error.
    """

    def __init__(self, glossary: Sequence[tuple[str, Sequence[str]]]):
        owner: dict[str, str] = {}
        self.spellings: dict[str, tuple[str, list[tuple[bool, bool]]]] = {}
        for canonical, aliases in glossary:
            for surface in (canonical, *aliases):
                if owner.setdefault(folded(surface), canonical) != canonical:
                    raise ValueError(f"{surface!r} belongs to {owner[folded(surface)]!r} and to {canonical!r}")
            for alias in aliases:
                if folded(alias) and folded(alias) != folded(canonical):
                    edges = self.spellings.setdefault(in_lower_case(alias), (canonical, []))[1]
                    if (own := (is_word(alias[0]), is_word(alias[-1]))) not in edges:
                        edges.append(own)
        if sum(map(len, self.spellings)) > MOST_CHARS:
            raise ValueError(f"spellings have over {MOST_CHARS} characters; split the glossary")
        self.name = hashlib.sha256(repr(sorted(self.spellings.items())).encode("utf-8", "surrogatepass")).hexdigest()

    def automaton(self):
        if self.name not in _automata:
            import ahocorasick

            made = ahocorasick.Automaton()
            for spelling, (canonical, edges) in self.spellings.items():
                made.add_word(spelling, (len(spelling), canonical, edges))
            made.make_automaton()
            _automata[self.name] = made
        return _automata[self.name]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, canonical) of the spellings in a text, in order."""
        if not self.spellings or not text:
            return []
        text = in_lower_case(text)
        hits = []
        for last, (n, canonical, edges) in self.automaton().iter(text):
            start, end = last + 1 - n, last + 1
            before, after = start > 0 and is_word(text[start - 1]), end < len(text) and is_word(text[end])
            if any(not (head and before or tail and after) for head, tail in edges):
                hits.append((start, -end, canonical))
        out, at = [], 0
        for start, end, canonical in sorted(hits):
            if start >= at:
                at = -end
                out.append((start, at, canonical))
        return out
