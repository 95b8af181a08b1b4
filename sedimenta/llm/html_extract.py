"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by what surrounds them,
tags score negative, and a linear scan finds the contiguous region of the
greatest sum. The weights are log-odds of lying inside the main text, learned
from labelled pages (those whose markup names their article or main element)
by features that don't use that mark, so that they speak for unmarked pages.

Inside the region, elements that are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments stay out. What an element is called
(class, id, role) is evidence, not a verdict: whole names and their last words
tell most, states such as "has-sidebar" or "comments-open" nothing, names
learned from labelled pages and the share of links are added, and no element
falls by its name that holds most of the page's text.

Edge cases: a null or empty page and one without words have the empty text;
markup cut off at the end of a page is dropped; unclosed elements end with
their parent, and an article or main element ends whatever a menu left open;
repeated rows are extracted each; other columns than those kept are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, map_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# fixed values of HTML and of common page templates
RAW = frozenset("script style template textarea title iframe svg select".split())
TO_THE_END = frozenset(("script", "style", "title", "textarea"))  # of RAW, those that take the rest of the page where they aren't closed
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark noscript q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input object math semantics mrow mi mn mo ms mtext mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_TEXT = frozenset("nav footer button dialog menu head".split())
SELDOM_TEXT = frozenset(("aside", "form"))  # and header outside an article
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
JUNK_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer copyright colophon masthead"
    " ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner dfp adsense"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer toast"
    " newsletter subscribe subscription signup login signin search form"
    " comment comments commentlist disqus reply replies respond discussion"
    " share sharing social related recommended recommendations trending toolbar skip".split()
)
OUTSIDE_ONLY = frozenset(("header", "topbar"))  # junk unless inside an article
STATES = frozenset("has with without no is show hide open opened closed close enabled disabled on off active inactive visible expanded collapsed".split())  # words of a name that tell a state, not a kind
HOLDERS = frozenset("list wrapper wrap container box bar area section block link links item items inner outer body content text title form button buttons group panel slot unit left right top bottom main site page post posts article articles story stories icon icons row col".split())  # words that say nothing of the kind
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Evidence from which an element stays out, and the share of the page's text that it may hold then.
VERDICT, MOST = 2.0, 0.5


@dataclass
class Element:
    """An element of a page and what its subtree holds."""

    name: str
    parent: int
    inside: bool  #: in an article or main element
    always: bool = False  #: never main text
    evidence: float = 0.0  #: by its name, role and class, that it isn't main text
    names: frozenset[str] = frozenset()
    plain: int = 0  #: words outside links
    linked: int = 0
    contents: int = 0  #: article and main elements, itself included
    junk: bool = False


@dataclass
class Block:
    """Text between two block tags, with what surrounds it."""

    tag: str
    inside: bool  #: in an article or main element
    element: int
    at: int  #: place in the page's sequence of tokens
    junk: bool = False
    words: list[tuple[int, bool]] = field(default_factory=list)  #: (words, in a link)
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class Page:
    blocks: list[Block]
    tags: list[tuple[int, str, int]]  #: (place, tag, element) of block tags
    elements: list[Element]
    named: bool = False  #: names its content


def name_evidence(value: str, inside: bool) -> float:
    """How much a class or id speaks for a menu, notice, advert and the like."""
    most = 0.0
    for name in value.split():
        pieces = [x.lower() for x in PIECE.findall(name)]
        hits = [x in JUNK_WORDS or not inside and x in OUTSIDE_ONLY for x in pieces]
        if not any(hits) or len(pieces) > 1 and (pieces[0] in STATES or pieces[-1] in STATES):
            continue
        last = max((i for i, x in enumerate(pieces) if x not in HOLDERS and not x.isdigit() or hits[i]), default=-1)
        if last >= 0 and hits[last]:
            most = max(most, 3.0 if last == len(pieces) - 1 else 2.5)
        else:
            most = max(most, 0.5)
    return most


def _described(name: str, attrs: str, inside: bool, parent: int) -> Element:
    out = Element(name, parent, inside, name in NEVER_TEXT, 2.5 if name in SELDOM_TEXT or name == "header" and not inside else 0.0, contents=int(name in CONTENT))
    if not attrs or name in ("body", "html"):
        return out
    for key, a, b, c in ATTRIBUTE.findall(attrs) if "=" in attrs else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            out.evidence = max(out.evidence, name_evidence(value, inside))
            out.names |= {x.lower() for x in value.split()}
        elif key == "role" and value.lower() in JUNK_ROLES:
            out.evidence = max(out.evidence, 3.0)
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            out.always = True
    if "hidden" in attrs and "hidden" in re.sub(ATTRIBUTE, " ", attrs).split():
        out.always = True
    if name in HEADINGS:  # a heading tells of its section, not of itself
        out.evidence = min(out.evidence, 1.0)
    return out


def parse(page: str, marks: bool = True) -> Page:
    """A page's blocks, block tags and elements; without `marks`, article and main are elements like any other."""
    out = Page([], [], [Element("", -1, False)])
    stack: list[int] = [0]  # open elements
    inside = links = at = 0
    block: Block | None = None
    place, end = 0, len(page)
    elements = out.elements

    def say(raw: str) -> None:
        nonlocal block, at
        text = html.unescape(raw) if "&" in raw else raw
        n = len(text.split())
        if block is None:
            if not n:
                return
            name = next((elements[e].name for e in reversed(stack) if elements[e].name not in INLINE), "") or "body"
            block = Block(name, inside > 0, stack[-1], at)
            out.blocks.append(block)
        block.parts.append(text)
        if n:
            block.words.append((n, links > 0))
            if links:
                elements[stack[-1]].linked += n
            else:
                elements[stack[-1]].plain += n
            at += 1

    def pop(to: int) -> None:
        nonlocal inside, block
        while len(stack) > to:
            e = elements[stack.pop()]
            inside -= e.contents
            block = None if e.name not in INLINE or e.evidence or e.always else block

    for token in iter(lambda: TOKEN.search(page, place), None):
        start = token.start()
        if start > place:
            say(page[place:start])
        place = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        closing = bool(token["close"] or token["close2"])
        attrs = token["attrs"] or token["attrs2"] or ""
        if name == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if name in RAW and not closing:
            if not attrs.rstrip().endswith("/") or name in TO_THE_END:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, place)
                if stop or name in TO_THE_END:
                    place = stop.end() if stop else end
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in ("td", "th") and block is not None:
            block.parts.append(" ")
            continue
        if not marks and name in CONTENT:
            name = "div"
        if name not in INLINE:
            block = None
            out.tags.append((at, f"/{name}" if closing else name, stack[-1]))
            at += 1
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if elements[stack[i]].name == name), None)
            if depth is not None:
                pop(depth)
            continue
        if name in VOID or attrs.endswith("/") and name in INLINE:
            continue
        if name in PARAGRAPH_ENDS and elements[stack[-1]].name == "p":
            pop(len(stack) - 1)
        if name == "li" and elements[stack[-1]].name == "li":
            pop(len(stack) - 1)
        if name in ("body", "html") or name in CONTENT and not inside:
            if any(elements[e].always or elements[e].name in SELDOM_TEXT for e in stack):
                pop(1)  # a menu or a head that was left open
        element = _described(name, attrs, inside > 0, stack[-1])
        bad = element.always or element.evidence >= VERDICT
        if name in INLINE and not bad:
            continue
        if name in INLINE:
            block = None
        stack.append(len(elements))
        elements.append(element)
        inside += element.contents
    if place < end:
        say(page[place:])
    return out


def _judge(page: Page, learned: dict[str, float]) -> None:
    """Mark the elements and blocks that aren't main text wherever they stand."""
    elements = page.elements
    for e in elements[1:]:
        e.always |= elements[e.parent].always
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.plain, up.linked, up.contents = up.plain + e.plain, up.linked + e.linked, up.contents + (0 if e.always else e.contents)
    total = elements[0].plain - sum(e.plain for e in elements[1:] if e.always and not elements[e.parent].always)
    for e in elements[1:]:
        words = e.plain + e.linked
        told = e.evidence + max(-2.0, min(2.0, sum(learned.get(x, 0.0) for x in e.names)))
        if told > 0 and words:
            told += 0.5 if e.linked > 0.6 * words else 0.0
        elif not e.inside and e.name in ("ul", "ol", "div") and words and e.linked > 0.9 * words and e.linked >= 8:
            told += VERDICT  # a menu without a name
        most = e.plain > (MOST if told < 3 else MOST + 0.2) * total and e.contents == elements[0].contents
        e.junk = elements[e.parent].junk or e.always or told >= VERDICT and not most
    for b in page.blocks:
        b.junk = elements[b.element].junk
    page.named = any(e.name in CONTENT and not e.junk for e in elements)


@dataclass
class Weights:
    """Scores of words by their surroundings, of tags, and of the names of elements."""

    words: dict[str, float]
    tags: dict[str, float]
    names: dict[str, float] = field(default_factory=dict)  #: log-odds of lying outside the main text

    def word(self, block: Block, link: bool, named: bool) -> float:
        w = self.words
        place = w["inside" if block.inside else "outside"] if named else w["unnamed"]
        kind = "link" if link else "text"
        return min(1.0, max(-4.0, place + w["junk" if block.junk else "plain"] + w.get(f"{block.tag} {kind}", 0.0) + w[kind]))

    def tag(self, name: str, junk: bool) -> float:
        return -0.02 if junk else self.tags.get(name, -0.2)

    def block(self, block: Block, named: bool) -> float:
        """A block's score; a block that stays out anyway can't part the region by more than a little."""
        total = sum(n * self.word(block, link, named) for n, link in block.words)
        return max(total, -0.1) if block.junk else total


def learn(pages: Iterable[str]) -> Weights:
    """Log-odds of main text over the rest, from pages that name their article or main element.

    Words are counted by tag and link, names by the pages on which an element
    of that name lies outside or inside the main text. Without labelled pages
    the smoothing alone speaks: paragraphs and headings count, links don't.
    """
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    names: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for source in pages:
        page = parse(source)
        _judge(page, {})
        if not page.named:
            continue
        good = [b.inside and not b.junk for b in page.blocks]
        for b, y in zip(page.blocks, good, strict=True):
            for n, link in b.words:
                kind = "link" if link else "text"
                words[y].update({"junk" if b.junk else "plain": n, "all": n, f"{b.tag} {kind}": n, kind: n})
                if not b.junk:
                    words[y].update({"inside" if b.inside else "outside": n})
        of = [e.inside and not e.junk for e in page.elements]
        for y in (True, False):
            names[y].update({x for e, inner in zip(page.elements, of, strict=True) if inner == y and e.name not in CONTENT and not e.contents for x in e.names})
        spans = [b.at for b, y in zip(page.blocks, good, strict=True) if y]
        for at, name, e in page.tags:
            if not page.elements[e].junk:
                tags[bool(spans) and spans[0] <= at <= spans[-1]][name] += 1
    prior = {f"{t} text": 20 for t in ("p", "h1", "h2", "h3", "blockquote", "pre")} | {"text": 30, "plain": 30, "inside": 30}
    against = {"link": 30, "junk": 300, "outside": 60}

    def odds(name: str) -> float:
        scale = (words[False]["all"] + 100) / (words[True]["all"] + 100)
        return float(np.clip(0.5 * np.log((words[True][name] * scale + prior.get(name, 0) + 10) / (words[False][name] + against.get(name, 0) + 10)), -3, 1))

    weights = {n: odds(n) for n in {*words[True], *words[False], *prior, *against} - {"all"}} | {"unnamed": 0.1}
    for n in weights:  # a tag seen in labelled pages must not speak alone for a page that has none
        if n.endswith(" text"):
            weights[n] = max(-0.3, weights[n])
    weights |= {"inside": max(weights["inside"], 0.3), "junk": min(weights["junk"], -1.5), "outside": min(weights["outside"], -1.0), "link": min(weights["link"], -0.5), "text": max(weights["text"], 0.1), "plain": max(weights["plain"], 0.1)}
    scores = {n: float(np.clip(0.5 * np.log((tags[True][n] + 1) / (tags[False][n] + 1)), -0.5, -0.02)) for n in {*tags[True], *tags[False]}}
    told = {n: float(0.5 * np.log((names[False][n] + 1) / (names[True][n] + 1))) for n in {*names[True], *names[False]} if names[False][n] + names[True][n] >= 3}
    return Weights(weights, scores, told)


def region(page: Page, weights: Weights) -> tuple[int, int]:
    """(first, last + 1) block of the maximum-scoring contiguous region, by one linear scan."""
    tokens = [(at, weights.tag(name, page.elements[e].junk), -1) for at, name, e in page.tags]
    tokens += [(b.at, weights.block(b, page.named), i) for i, b in enumerate(page.blocks)]
    tokens.sort(key=lambda x: x[0])
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for k, (_, score, _) in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, span = total, (start, k + 1)
    inside = [i for _, _, i in tokens[span[0] : span[1]] if i >= 0]
    return (min(inside), max(inside) + 1) if inside else (0, 0)


def extract(source: str, weights: Weights, marks: bool = True) -> str:
    page = parse(source, marks)
    _judge(page, weights.names)
    a, b = region(page, weights)
    return "\n".join(t for x in page.blocks[a:b] if not x.junk and (not page.named or x.inside) and (t := x.text))


def train(pages: DataFrame, column: str = "html", rows: int = 400, chars: int = 100_000) -> Weights:
    """Weights from at most `rows` labelled pages of at most `chars` characters, in the order of a hash of the page."""
    named = pages.select(column).where(F.length(column) <= chars).where(F.col(column).rlike("(?i)<(article|main)[\\s>]"))
    return learn(sorted(hashed_sample(named, column, rows)))


def main_text(pages: DataFrame, weights: Weights, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """`keep` columns, text and n_chars of each page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(x or "", weights) for x in batch.column(column).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(pages.select(*keep, column), work, f"{kinds}, text string, n_chars long", 500)
