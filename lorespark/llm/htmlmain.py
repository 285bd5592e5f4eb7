"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Each gets a weight by its kind: the log-odds
of lying in the main text, for a word by the elements around it (tag names, and
names in class and id), for a tag by its name; words are pushed up by ``MARGIN`` and
tags are always negative. Weights are learned from labelled pages: those whose markup itself names
the main text (one ``article`` or ``main`` outside the parts below), at most ``sample`` of them. The
two tags only label; they are no part of a word's kind, so pages that use them for something else, or
not at all, are weighed like others. One linear scan
finds the contiguous run with the largest sum.

Elements may be suspect: those that HTML itself sets beside the text (``nav``, ``aside``, ``form``, page headers and
footers, landmark roles), those with a class or id that labelled pages have shown ``HIDES`` or more in
log-odds outside the main text, on ``SEEN`` pages or more, and those whose class or id only has words for adverts, notices,
menus, readers' comments or the like (labels cannot teach these, as adverts and comments also stand inside articles).
Suspicion alone decides nothing. A word in a suspect element counts ``FAINT`` of its weight (``HALF`` if it lies
in the only ``article`` or ``main`` there), and an element that still has more than half of what counts on the page
is cleared, the outermost first, after which words are counted anew. So a form, a menu that is never closed or a
``content-sidebar-wrap`` around the text is cleared and the side bar in it is not. Words of elements that stay suspect
weigh what tags do in the scan, which may pass over them, and their blocks are no part of the text. A page's only ``h1`` is not
left out for names around it.

Only one run comes out: of two articles far apart it is that with the larger sum.

Defined results: null and empty pages, and pages without a word outside such
elements, give an empty text; a page cut off in the middle is read to its end, and a
tag with a quote that is never closed ends at its first bracket; equal
sums give the earlier and shorter run; repeated pages repeat. Parsing takes time in
proportion to the page, however deep its elements lie. Other columns are
carried by :func:`extract`.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches

SAMPLE, MARGIN, HIDES, SEEN = 600, 1.0, 3.0, 3
#: What a word in a suspect element counts, and what it counts in the only article there.
FAINT, HALF = 0.05, 0.5
#: Fixed values of HTML: elements without content, elements whose content is no text, elements that do not break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select object canvas".split())
#: Ends of raw elements, looked for in the source itself, as lower-casing can change its length.
ENDS = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup svg time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Fixed values of HTML: elements and roles beside the main text, and elements in which a header or footer belongs to a part of it.
BESIDE = frozenset("head nav footer aside form button dialog menu".split())
BESIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
SECTIONS = frozenset("article main section".split())
#: Words of names that make an element suspect, and words that say nothing about that.
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar masthead footer sidebar aside "
    "notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus share sharing social related recommended recommendations".split()
)
FRAME_WORDS = frozenset(
    "area bar bottom box buttons block container content form global header icons inline inner item items left links list message "
    "outer panel policy posts primary reader readers right secondary section site slot strip thread top unit user widget wrap wrapper".split()
)
HEADERS = frozenset(("header", "page-header", "site-header"))
TAG = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">{0}]++|\"[^\"{0}]*\"|'[^'{0}]*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)"
#: A page's tokens; and those after a quote that is never closed, where no other quote may span a tag, so that each is looked for nearby.
TOKEN, WARY_TOKEN = re.compile(TAG.format(""), re.S), re.compile(TAG.format("<"), re.S)
NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that label.
MAIN = frozenset(("article", "main"))
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    name: str
    parent: int  # place among the page's elements, -1 for none
    names: tuple[str, ...] = ()  # of class and id, but for those that an element around it has too
    suspect: bool = False  # by its element, role or place
    named: bool = False  # suspect by its names
    article: bool = False  # a ``MAIN`` element, but for readers' comments
    section: bool = False  # lies in a ``SECTIONS`` element
    paragraph: int = -1  # depth of the paragraph that the next block would end, -1 for none


@dataclass(slots=True)
class Token:
    element: int  # innermost open element
    tag: str | None  # None for words
    words: int = 0
    around: tuple[str, ...] = ()


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    tokens: list[Token] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # (first token, text, innermost block element)

    def beside(self, weight: np.ndarray, hiding: frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        """Whether each element lies in one that stays suspect, and in one that does so not only for its names; the last entry is for no element.

        ``weight``: what the words of each element itself count.
        """
        elements = self.elements
        suspect = np.array([e.suspect or e.named or not hiding.isdisjoint(e.names) for e in elements] + [False])
        while suspect.any():
            near, article, only = [-1] * (len(elements) + 1), [-1] * (len(elements) + 1), Counter()
            for k, e in enumerate(elements):  # an element comes before those in it
                near[k] = k if suspect[k] else near[e.parent]  # innermost suspect element around it
                article[k] = -1 if suspect[k] else article[e.parent]  # outermost article around it in that
                if e.article and not suspect[k] and article[k] < 0:
                    article[k] = k
                    only[near[k]] += 1
            share = [1.0 if s < 0 else HALF if article[k] >= 0 and only[s] == 1 else FAINT for k, s in enumerate(near)]
            held = weight * share
            for k in range(len(elements) - 1, -1, -1):
                held[elements[k].parent] += held[k]  # elements without parent add to the last entry
            cleared = -1
            for k in np.flatnonzero(suspect[:-1]).tolist():
                above = near[elements[k].parent]
                if held[k] > held[-1] / 2 and (above < 0 or above == cleared and held[k] >= 0.9 * held[above]):
                    cleared, suspect[k] = k, False
            if cleared < 0:
                break
        plain = suspect & [*(e.suspect for e in elements), False]
        for k, e in enumerate(elements):
            suspect[k] |= suspect[e.parent]
            plain[k] |= plain[e.parent]
        return suspect, plain


def _names(attributes: str) -> tuple[list[str], list[str]]:
    """(names in class and id, roles), lower-cased, words joined by hyphens."""
    names: list[str] = []
    roles: list[str] = []
    for kind, a, b, c in NAMED.findall(attributes):
        for name in (a or b or c).split():
            plain = "-".join(PART.findall(CAMEL.sub(" ", name))).lower()
            (roles if kind.lower() == "role" else names).append(plain)
    return [n for n in dict.fromkeys(names) if n], roles


def _says_beside(name: str) -> bool:
    words = set(name.split("-"))
    return bool(words & BESIDE_WORDS) and words <= BESIDE_WORDS | FRAME_WORDS


def parse(source: str | None) -> Page:
    """One pass over the markup; tolerant of elements that are never closed."""
    page = Page()
    elements, stack, open_tags, open_names = page.elements, [], Counter(), Counter()
    text: list[str] = []
    block_at = 0

    def top() -> int:
        return stack[-1] if stack else -1

    def flush() -> None:
        nonlocal block_at
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            page.blocks.append((block_at, joined, top()))
        block_at = len(page.tokens)

    def close(depth: int) -> None:
        for at in stack[depth:]:
            open_tags[elements[at].name] -= 1
            open_names.subtract(elements[at].names)
        del stack[depth:]

    raw, at, token = source or "", 0, TOKEN
    while at < len(raw):
        m = token.match(raw, at)
        if m is None:
            break
        at = m.end()
        plain = m.group(7)
        if plain is not None:
            words = html.unescape(plain)
            if words.strip():
                around = {elements[k].name for k in stack[-4:]} - INLINE - MAIN
                page.tokens.append(Token(top(), None, len(words.split()), tuple(sorted(around))))
            text.append(words)
            continue
        if m.group(5):
            token = WARY_TOKEN
        closing, name, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        page.tokens.append(Token(top(), name))
        if name not in INLINE:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            if open_tags[name] > 0:
                depth = len(stack) - 1
                while elements[stack[depth]].name != name:
                    depth -= 1
                close(depth)
        elif name in RAW:
            end = ENDS[name].search(raw, at)
            at = end.start() if end else len(raw)
            stack.append(len(elements))
            elements.append(Element(name, stack[-2] if len(stack) > 1 else -1))
            open_tags[name] += 1
        elif name not in VOID:
            above = elements[top()] if stack else Element("", -1)
            if name in ENDS_P and above.paragraph >= 0:
                close(above.paragraph)
                above = elements[top()] if stack else Element("", -1)
            names, roles = _names(attributes)
            page_part = (name == "header" or bool(HEADERS.intersection(names))) and not above.section
            article = name in MAIN and not any(n.endswith(("comment", "comments")) for n in names)
            whole = name in ("html", "body") or article
            suspect = name in BESIDE or page_part or (not whole and bool(BESIDE_ROLES.intersection(roles)))
            element = Element(name, top(), tuple(n for n in names if not open_names[n]), suspect, not whole and any(map(_says_beside, names)), article, above.section or name in SECTIONS)
            element.paragraph = len(stack) if name == "p" else above.paragraph if name in INLINE else -1
            stack.append(len(elements))
            elements.append(element)
            open_tags[name] += 1
            open_names.update(element.names)
    flush()
    return page


class Weights:
    """Log-odds of tags and names, from labelled pages; unknown ones have 0.

    Pages with no or several ``MAIN`` elements (marks in scripts, lists of teasers) do not say which text is the main one and are left out.
    """

    def __init__(self, pages: list[Page]):
        inside, outside, seen = Counter(), Counter(), Counter()
        for page in pages:
            counts = np.zeros(len(page.elements) + 1)
            for t in page.tokens:
                counts[t.element] += t.words
            beside, _ = page.beside(counts)
            main, mains = [False] * (len(page.elements) + 1), 0
            for k, e in enumerate(page.elements):
                main[k] = main[e.parent] or (e.article and not beside[k])
                mains += main[k] and not main[e.parent]
            if mains != 1:
                continue
            words = np.zeros((len(page.elements) + 1, 2), np.int64)  # outside and inside, of each element; the last row has none
            for t in page.tokens:
                label = main[t.element] and not beside[t.element]
                if main[t.element] and beside[t.element] and t.tag is None:
                    continue  # an advert in an article says nothing about the names around it
                for part in [("tag", t.tag)] if t.tag else [("word", a) for a in t.around] or [("word", "")]:
                    (inside if label else outside)[part] += max(t.words, 1)
                words[t.element, int(label)] += t.words
            for k in range(len(page.elements) - 1, -1, -1):  # an element comes before those in it
                e = page.elements[k]
                words[e.parent] += words[k]
                for n in e.names:
                    outside["name", n] += int(words[k, 0])
                    inside["name", n] += int(words[k, 1])
            seen.update({("name", n) for e in page.elements for n in e.names})
        total_in, total_out = max(sum(inside.values()), 1), max(sum(outside.values()), 1)
        self.odds = {k: float(np.clip(np.log((inside[k] + 1) / (total_in + 2)) - np.log((outside[k] + 1) / (total_out + 2)), -4, 4)) for k in {*inside, *outside}}
        self.hiding = frozenset(n for (kind, n), k in seen.items() if k >= SEEN and self.odds[kind, n] <= -HIDES)

    def of(self, page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each token, and :meth:`Page.beside`)."""
        best, counts = np.zeros(len(page.elements) + 1), np.zeros(len(page.elements) + 1)
        best[-1] = -np.inf
        for k, e in enumerate(page.elements):
            best[k] = max(best[e.parent], *[self.odds.get(("name", n), 0.0) for n in e.names]) if e.names else best[e.parent]
        out = np.empty(len(page.tokens))
        for i, t in enumerate(page.tokens):
            if t.tag is None:
                odds = max([best[t.element], *[self.odds.get(("word", a), 0.0) for a in t.around]])
                out[i] = t.words * ((odds if odds > -np.inf else 0.0) + MARGIN)
                counts[t.element] += max(out[i], 0)
            else:
                out[i] = -0.1 - 0.3 * max(MARGIN - self.odds.get(("tag", t.tag), 0.0), 0)
        return out, *page.beside(counts, self.hiding)


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, the earlier and shorter of equals; empty if none is positive."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums[:-1])
    gain = sums[1:] - lowest
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0
    start = int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1])
    return start, end + 1


def main_text(source: str | None, weights: Weights) -> str:
    page = parse(source)
    scores, beside, plain = weights.of(page)
    headings = [k for k, e in enumerate(page.elements) if e.name == "h1"]
    out = [bool(plain[at] if headings == [at] else beside[at]) for _, _, at in page.blocks]
    hidden = np.zeros(len(scores), bool)
    # Words of a block that goes anyway count as tags do: a run may pass over them, at a cost.
    bounds = [b[0] for b in page.blocks] + [len(scores)]
    for first, after, goes in zip(bounds, bounds[1:], out):
        hidden[first:after] = goes
    scores = np.where(hidden, np.minimum(scores, -0.1), scores)
    start, end = best_run(scores)
    return "\n".join(t for (_, t, _), first, after, goes in zip(page.blocks, bounds, bounds[1:], out) if not goes and first < end and after > start)


def fit(pages: DataFrame, *, page_id: str = "page_id", source: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` pages (smallest hash of the id) whose markup names the main text."""
    labelled = pages.filter(F.col(source).rlike("(?i)<(article|main)[\\s>]")).select(F.col(page_id).alias("_id"), F.col(source).alias("_html"))
    rows = bounded_sample(labelled, F.col("_id"), sample).toPandas().sort_values(["_id", "_html"])
    return Weights([parse(t) for t in rows["_html"]])


def extract(pages: DataFrame, weights: Weights, *, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the column ``name``: the main text, blocks joined by line feeds."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(s, shared.value) for s in sources], dtype=object)

    return pages.withColumn(name, text_of(F.col(source)))
