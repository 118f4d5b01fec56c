"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass one decides a block by the containers that it
is in (navigation, adverts, comments and the like are never text), its link density (links are
boilerplate) and its length with its stop-word density (long blocks of common words are text);
where no block of the page has common words, length alone decides. What is left is ambiguous:
headings, short blocks, blocks without common words. Pass two gives each of those the label of its
nearest decided neighbours: of those in the smallest element around it that has any, else of the
page's, whose ends count as boilerplate. A tie goes to the block before, a heading goes with the
block after. Where a page has an ``article`` or ``main`` with text in it, all else is boilerplate.

A class or id counts as a container's name if each of its parts is a known word (``post-comments``,
not ``share-of-market``) or one of them has no other use (``sidebar``); a name of a state
(``has-comments``) is none. A form that holds all of a page's text is no container.

Defined results: a null page is empty; a page without blocks has the empty text; a page on which
nothing is decided keeps all that is in no such container; repeated rows give repeated rows; an
empty table gives no rows; other columns are not read. Malformed pages take linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HINT = re.compile(r"class|id|role|hidden|style", re.I)
_RAW = frozenset("script style noscript template textarea title iframe svg select button audio video canvas".split())
#: Of these an unclosed one reaches to the page's end.
_RAW_TO_END = frozenset("script style textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INSIDE_P = frozenset("body html head option caption tbody td tfoot th thead tr".split())
#: An element of these ends one of the same kind that is still open right around it.
_SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_BAD_TAG = frozenset("nav footer aside menu dialog fieldset search head".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_a-zA-Z]+")

#: Names of containers that hold no text of the article...
_BAD_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers comment comments commentlist disqus cookie cookies "
    "consent gdpr notice notices alert alerts popup popups modal overlay newsletter newsletters subscribe subscription signup login "
    "share sharing social respond reply replies search form forms related recommended recommendations pagination pager copyright toolbar topbar masthead skip".split()
)
#: ...of those that do so outside of an article only, as the article's own parts may have these names...
_OUTER_NAME = frozenset("header side foot legal meta byline tag tags widget widgets rail".split())
#: ...of those that hold the article...
_GOOD_NAME = frozenset("content article post entry story main body text".split())
#: ...and words that go with any of them.
_NEUTRAL = frozenset(
    "a an the and box boxes list lists item items container wrap wrapper wrapped area areas section sections block blocks bar bars button "
    "buttons link links icon icons left right top bottom upper lower middle first last site page pages global primary secondary inner outer "
    "col column columns row group panel pane slot unit zone holder js new posts articles stories single hentry blog view "
    "user users reader readers header footer widget widgets thread count title div region module component "
    "small large mobile desktop sticky fixed policy center inline in out law info message messages msg settings preferences dark light toggle placeholder "
    "label head heading image img photo video embed only print fb facebook twitter google wp".split()
)
#: One of these is enough, whatever stands beside it; with one of the others a name tells a state.
_STRONG = frozenset(
    "sidebar sidebars breadcrumb breadcrumbs navbar disqus advert adverts advertisement advertising adsense gdpr newsletter newsletters "
    "pagination masthead commentlist toolbar topbar popup popups".split()
)
_STATE = frozenset("has is no not with without open closed enabled disabled show hide free".split())
_KNOWN = _NEUTRAL | _GOOD_NAME | _BAD_NAME | _OUTER_NAME

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the "
    "their them there they this to was we were what which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour qu que qui sa se "
    "ses son sur un une vous "
    "al como con del el ella entre era es esta este fue ha lo los las mas mi muy no o para pero por que se sin sobre su sus "
    "un una y ya yo "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit "
    "nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wie wird zu zum zur".split()
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Block:
    """``links``: characters in links; ``bad``: 1 in a form, 2 in another container without text;
    ``good``: 1 in one named after the article, 2 in an ``article`` or ``main``; ``node``: its element."""

    text: str
    links: int
    bad: int
    good: int
    heading: bool
    paragraph: bool
    node: int


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id has a name of ``names`` beside neutral words only; names of states are passed over."""
    for word in value.split():
        parts = {x.lower() for x in _PARTS.findall(word)}
        if parts & names and not parts & _STATE:
            if names is _OUTER_NAME and parts & _GOOD_NAME:  # the article's own header
                continue
            if parts & names & _STRONG or all(x in _KNOWN or x.isdigit() or len(x) == 1 for x in parts):
                return True
    return False


def _container(tag: str, attributes: str, bad: int, good: int) -> tuple[int, int]:
    """(bad, good) of an element within one of that ``bad`` and ``good``."""
    if tag in _BAD_TAG or (tag == "header" and good < 2):
        bad = 2
    elif tag == "form":
        bad = max(bad, 1)
    fresh = 2 if tag in ("article", "main") else good
    if attributes and bad < 2 and tag not in ("html", "body") and _HINT.search(attributes):
        for key, *values in _ATTR.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                if _named(value, _BAD_NAME) or (good < 2 and tag not in ("article", "main") and _named(value, _OUTER_NAME)):
                    bad = 2
                elif _named(value, _GOOD_NAME):
                    fresh = max(fresh, 1)
            elif key == "role":
                if value.lower() in _BAD_ROLE:
                    bad = 2
                elif value.lower() in ("main", "article"):
                    fresh = 2
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                bad = 2
    return bad, fresh


class _Page:
    """Reads a page once from left to right."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parents = [-1]  # of every element; 0 is the page
        self.stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, bad, good, node
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.links = 0

    def data(self, piece: str) -> None:
        if piece:
            self.parts.append(piece)
            if self.links and not piece.isspace():
                self.linked += len(piece)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                tag, bad, good, node = self.stack[-1]
                heading = any(t in _HEADINGS for t, *_ in self.stack[-3:])
                self.blocks.append(Block(text, self.linked, bad, good, heading, heading or tag in ("p", "blockquote", "pre"), node))
            self.parts = []
        self.linked = 0

    def pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def start(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.open["p"] and tag not in _INSIDE_P and any(t == "p" for t, *_ in self.stack[-4:]):
            while self.stack[-1][0] != "p":
                self.pop()
            self.pop()
        ends = _SIBLINGS.get(tag, "").split()
        while ends and self.stack[-1][0] in ends:
            self.pop()
        self.links = 0
        if tag == "hr":
            return
        _, bad, good, node = self.stack[-1]
        bad, good = _container(tag, attributes, bad, good)
        self.stack.append((tag, bad, good, len(self.parents)))
        self.parents.append(node)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self.flush()
        self.links = 0
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def read(self, page: str) -> None:
        at, last_end, strict = 0, page.rfind(">"), True
        unclosed: set[str] = set()
        while True:
            start = page.find("<", at)
            if start < 0 or start > last_end:
                break
            self.data(page[at:start])
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", at + 3)
                at = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith("![CDATA[", at):
                end = page.find("]]>", at)
                end = len(page) if end < 0 else end
                self.data(html.escape(page[at + 8 : end]))
                at = end + 3
                continue
            if page.startswith(("!", "?"), at):
                at = page.find(">", at) + 1
                continue
            name = _NAME.match(page, at)
            if name is None:
                self.data("&lt;")
                continue
            rest = _REST.match(page, name.end()) if strict else None
            if rest is None:  # a quote that is never closed: from here on tags end at the first sign that can end them
                strict = False
                end = page.find(">", name.end())
                attributes, at = page[name.end() : end], end + 1
            else:
                attributes, at = rest[1], rest.end()
            tag = name[0].lower()
            if tag.startswith("/"):
                tag = tag[1:]
                if tag == "a":
                    self.links = max(0, self.links - 1)
                elif tag in _BLOCK:
                    self.end(tag)
            elif tag == "br":
                self.data(" ")
            elif tag == "a":
                self.links += 1
            elif tag in _BLOCK:
                self.start(tag, attributes)
            elif tag in _RAW and not attributes.rstrip().endswith("/"):
                closing = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if closing is None:
                    unclosed.add(tag)
                    at = len(page) if tag in _RAW_TO_END else at
                else:
                    at = closing.start()
        self.data(page[at:])
        self.flush()


def _decide(block: Block, page_has_common_words: bool, max_link_density: float, short: int, stop: float, stops: float) -> bool | None:
    """Pass one for a block that is in no container without text."""
    long = len(block.text) >= short
    told = stops >= stop and len(block.text) - block.links >= 2 * short  # sentences that have links in them
    if block.links > max_link_density * len(block.text) and not (told and block.links * 2 <= len(block.text)):
        return None if block.good == 2 and block.paragraph and not long else False
    if block.heading:
        return None
    if long and (stops >= stop or block.good == 2 or not page_has_common_words):
        return True
    return True if block.good == 2 and stops >= 2 * stop else None


def _inherit(labels: list[bool | None], blocks: list[Block], outside: list[bool], parents: list[int]) -> list[bool]:
    """Pass two: each open block takes the label of its nearest decided neighbours.

    ``outside`` marks blocks that containers decided: they are neighbours only where the open
    block's own elements have no block that its content decided.
    """
    n = len(blocks)
    first, last = [n] * len(parents), [-1] * len(parents)
    decided = [False] * len(parents)
    for i, b in enumerate(blocks):
        first[b.node], last[b.node] = min(first[b.node], i), max(last[b.node], i)
        decided[b.node] = decided[b.node] or (labels[i] is not None and not outside[i])
    for node in range(len(parents) - 1, 0, -1):  # elements come after those that they are in
        p = parents[node]
        first[p], last[p], decided[p] = min(first[p], first[node]), max(last[p], last[node]), decided[p] or decided[node]
    anchor = [0] * len(parents)
    for node in range(1, len(parents)):
        anchor[node] = node if decided[node] else anchor[parents[node]]

    def nearest(usable: list[bool]) -> tuple[list[int], list[int]]:
        before, after, seen = [-1] * n, [n] * n, -1
        for i in range(n):
            before[i] = seen
            seen = i if usable[i] else seen
        seen = n
        for i in range(n - 1, -1, -1):
            after[i] = seen
            seen = i if usable[i] else seen
        return before, after

    own = nearest([x is not None and not o for x, o in zip(labels, outside, strict=True)])
    every = nearest([x is not None for x in labels])
    out = [bool(x) for x in labels]
    for i, b in enumerate(blocks):
        if labels[i] is not None:
            continue
        node = anchor[b.node]
        if node:
            left, right = own[0][i], own[1][i]
            left, right = left if left >= first[node] else None, right if right <= last[node] else None
        else:
            left, right = every[0][i], every[1][i]  # -1 and n are the page's ends
        if right is None or (left is not None and i - left <= right - i and not b.heading):
            out[i] = left >= 0 and bool(labels[left])
        else:
            out[i] = right < n and bool(labels[right])
    return out


def main_text(page: str | None, max_link_density: float = 0.33, short: int = 70, stop: float = 0.10) -> str:
    """The main text of one page; blocks joined by a line feed."""
    if not page:
        return ""
    reader = _Page()
    reader.read(page)
    blocks = reader.blocks
    stops = []
    for b in blocks:
        words = _WORD.findall(b.text.lower()) if len(b.text) >= short or b.good == 2 else ()
        stops.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
    # A form around all the text is not one of the page's forms.
    limit = 1 if any(b.bad == 0 and len(b.text) >= short for b in blocks) else 2
    outside = [b.bad >= limit for b in blocks]
    links = [b.links > max_link_density * len(b.text) for b in blocks]
    common = any(len(b.text) >= short and s >= stop for b, s, o, x in zip(blocks, stops, outside, links, strict=True) if not (o or x))

    def first_pass() -> list[bool | None]:
        return [False if o else _decide(b, common, max_link_density, short, stop, s) for b, o, s in zip(blocks, outside, stops, strict=True)]

    labels = first_pass()
    if any(b.good == 2 and x for b, x in zip(blocks, labels, strict=True)) or (
        any(b.good == 2 and not o for b, o in zip(blocks, outside, strict=True)) and not any(labels)
    ):
        outside = [o or b.good < 2 for b, o in zip(blocks, outside, strict=True)]
        labels = first_pass()
    if not any(labels):
        labels = [x is None for x in labels]
    out = _inherit(labels, blocks, outside, reader.parents)
    return "\n".join(b.text for b, x in zip(blocks, out, strict=True) if x)


def html_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """``keys, text, n_chars`` of every row, from its whole page."""
    names = [*keys, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names
            )

    fields = [pages.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keys, page).mapInArrow(run, schema)
