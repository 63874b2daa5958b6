"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words of running text score positive, words
in the places of links, headings of the site, footers and the like negative, and
tags negative; the weights are log-odds learned from labelled pages.  One linear
scan finds the contiguous region of greatest score.  What is never part of an
article (menus, adverts, forms, notices, scripts, comments, ...) scores nothing
and is left out of the region's text.  A class, id or role says so only if it names
nothing else; ``related-work`` or ``has-sidebar`` makes a place less likely, no more.
Headings and what stands in an article's running text are never left out by name,
and a form or marked place around the article itself is none.

Labelled pages are pages whose author marked the article (``<article>`` or
``<main>``): what it holds, those places left out, is content.  A mark that covers a
small part of the page's running text is that of teasers; such a page teaches nothing
and is scored as one without a mark.

Parsing and scan are a row-local Arrow UDF.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.html import tag_end
from precis.llm import common


@dataclass(frozen=True)
class ExtractConfig:
    pages: int = 500  # labelled pages that are learned from, at most
    max_chars: int = 200_000  # longest page of that sample
    smooth: float = 2.0
    tag_cost: float = 0.5  # of a tag that only occurs outside of articles
    least_marked: float = 0.25  # share of the running text that a marked article has at least
    least_parts: float = 0.5  # if several elements mark it, as teasers do
    weak_cost: float = 0.5  # share that a word loses where a name only contains a mark, if no such place was learned


DEFAULT = ExtractConfig()

# Elements whose content is raw text up to their end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template"}
# Elements that never hold a part of the article.
EXCLUDED = RAW | {"head", "nav", "aside", "footer", "form", "button", "select", "option", "menu", "svg", "canvas",
                  "object", "audio", "video", "dialog", "datalist"}
# Words in class, id and role that mark such places.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "aside", "complementary",
    "comment", "comments", "respond", "disqus", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "contentinfo", "masthead", "share", "sharing", "social", "related", "recommended", "newsletter",
    "subscribe", "subscription", "signup", "popup", "modal", "overlay", "widget", "pagination", "login", "search",
}
# Marks of adverts and of what readers write, which are no part of an article in whatever element they stand.
FOREIGN = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "comment", "comments",
           "respond", "disqus"}
# Words that, beside such a mark, still name the place and not what it tells of.
NEUTRAL = {"box", "container", "wrapper", "wrap", "bar", "slot", "unit", "inner", "outer", "top", "bottom", "left", "right",
           "site", "main", "primary", "secondary", "button", "buttons", "icon", "icons", "link", "links", "list", "area", "section",
           "block", "row", "col", "column", "item", "items", "thread", "panel", "module", "holder", "zone", "reader", "readers",
           "user", "users", "group", "card", "cell"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that are part of the running text where they stand in an article.
RUNNING = HEADINGS | {"section", "p", "blockquote", "pre", "code", "figure", "figcaption", "table", "thead", "tbody", "tr", "td",
                      "th", "dl", "dt", "dd", "em", "strong", "b", "i", "mark", "q", "cite"}
SITE_MARKS = {"header", "banner", "masthead", "topbar"}  # of the page, not of the article
# Elements that stand within a line; every other tag ends a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr", "img", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Start tags that end an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
MAIN = {"article", "main"}
UNMARKED = {"html", "body"} | MAIN  # whose classes describe the page, not a place in it

NAME = re.compile(r"/?([a-zA-Z][^\t\n\f\r />]*)")
MARK_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _named(attrs: list[tuple], in_main: bool, block: bool) -> tuple[bool, bool, bool]:
    """Whether a class, id or role names a place that is no part of an article, such a place in any element, or contains such a word.

    In an article an id is an anchor and names nothing but a block of comments or adverts.
    """
    marks = MARKS if in_main else MARKS | SITE_MARKS
    whole = foreign = part = False
    for key, value in attrs:
        if key not in ("class", "id", "role"):
            continue
        for name in value.split():
            words = {w.lower() for w in MARK_WORD.findall(name) if not w.isdigit()}
            if not words & marks:
                continue
            part = True
            if words <= marks | NEUTRAL:
                whole = whole or not (in_main and key == "id")
                foreign = foreign or bool(words & FOREIGN) and (block or key != "id")
    return whole, foreign, part


def _standing(tag: str, attrs: list[tuple], in_main: bool) -> tuple[bool, bool, bool]:
    """(never part of an article, not unless it holds the article, less likely) of an element of its own."""
    if tag != "form" and tag in EXCLUDED or (tag == "header" and not in_main):
        return True, False, False
    if not attrs or tag in UNMARKED:
        return False, tag == "form", False
    if any(k == "hidden" or k == "aria-hidden" and v.strip().lower() == "true" for k, v in attrs):
        return True, False, False
    whole, foreign, part = _named(attrs, in_main, tag not in INLINE and tag not in HEADINGS and tag != "p")
    cut = whole and not (tag in HEADINGS or in_main and tag in RUNNING) or foreign and tag not in HEADINGS
    return False, cut or tag == "form", part


def _around_article(elements: list[tuple], texts: list[tuple]) -> set[int]:
    """The elements that would be left out but hold the article, among forms and marked places.

    On a page without any ``<article>`` or ``<main>`` a marked place that holds nearly
    all of the running text is none: its words are three times those outside of all
    such places, and half at least of those inside.

    Such an element holds most of the text that is marked as article on the page (a
    form may do without a mark), and more words than remain without all of them.  In
    an article it must hold a single further one: several are cards or comments.
    """
    size = len(elements)
    held = [0] * size  # outermost <article> and <main> elements in it
    for e in range(size - 1, -1, -1):  # a parent stands before what it holds
        if elements[e][0] >= 0:
            held[elements[e][0]] += 1 if elements[e][1] in MAIN else held[e]
    bare = not any(x[1] in MAIN for x in elements)
    asked = {e for e, (_, tag, main, _, soft, _) in enumerate(elements) if soft and (
        bare or (held[e] == 1 if main else held[e] or tag == "form"))}
    if not asked:
        return asked
    words, marked, rest, total = [0] * size, [0] * size, 0, 0
    for what, e in texts:
        if e < 0:
            rest += len(what.split())
        else:
            words[e] += len(what.split())
    cut, within = [False] * size, [False] * size
    for e, (parent, _, _, never, soft, _) in enumerate(elements):
        cut[e] = parent >= 0 and cut[parent] or never or soft and e not in asked
        within[e] = parent >= 0 and within[parent] or e in asked
        if cut[e]:
            words[e] = 0
        elif not within[e]:
            rest += words[e]
    for e in range(size - 1, -1, -1):
        parent, tag = elements[e][:2]
        inner = words[e] if tag in MAIN else marked[e]
        if parent >= 0:
            words[parent] += words[e]
            marked[parent] += inner
        else:
            total += inner
    if bare:
        inside = sum(words[e] for e in asked if not (elements[e][0] >= 0 and within[elements[e][0]]))
        return {e for e in asked if words[e] > 0 and words[e] > 3 * rest and 2 * words[e] >= inside}
    return {e for e in asked if (words[e] if elements[e][1] == "form" else marked[e]) > rest and (
        elements[e][2] or 2 * marked[e] >= total)}


def tokens(page: str) -> Iterator[tuple]:
    """The page as ("text", raw text, place, excluded, in article) and ("tag", name, block, excluded, in article).

    The place of a text is its innermost element, after a ~ where a name makes it less likely.  Damaged markup is read as
    browsers do, roughly: an end tag closes everything opened since its start tag,
    a stray one is ignored, a block's start tag ends an open paragraph, an unclosed
    comment or script runs to the end of the page, and a "<" that begins no tag is text.
    """
    parts, elements = _parse(page)
    lifted: set[int] = set()
    if any(x[4] for x in elements):
        lifted = _around_article(elements, [(x[1], x[3]) for x in parts if x[0] == "text"])
    state = []  # excluded, in article, less likely
    for e, (parent, _, main, never, soft, weak) in enumerate(elements):
        out, _, less = state[parent] if parent >= 0 else (False, False, False)
        state.append((out or never or soft and e not in lifted, main, less or weak))
    for kind, what, block, e in parts:
        out, main, less = state[e] if e >= 0 else (False, False, False)
        if kind == "text":
            place = elements[e][1] if e >= 0 else ""
            yield kind, what, "~" + place if less else place, out, main
        else:
            yield kind, what, block, out, main


def _parse(page: str):
    """("text", raw text, False, element) and ("tag", name, block, element) in order, and the elements.

    An element is (parent, tag, in article, never, not unless it holds the article, less likely).
    """
    parts: list[tuple] = []
    elements: list[tuple] = []
    stack: list[int] = []
    open_: Counter = Counter()  # open elements of each name: a stray end tag costs no search
    at, start, size = 0, 0, len(page)

    def close(depth):
        for e in stack[depth:]:
            open_[elements[e][1]] -= 1
        del stack[depth:]

    def text(upto):
        if upto > start:
            parts.append(("text", page[start:upto], False, stack[-1] if stack else -1))

    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            text(at)
            end = page.find("-->", at + 4)
            at = start = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            text(at)
            end = page.find(">", at)
            at = start = size if end < 0 else end + 1
            continue
        m = NAME.match(page, at + 1)
        attrs: list[tuple] = []
        end = tag_end(page, m.end(), attrs) if m else -1
        if end < 0:
            at += 1
            continue
        text(at)
        at = start = end
        tag = m[1].lower()
        if m[0][0] == "/":
            inner = stack[-1] if stack else -1
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]][1] == tag))
            parts.append(("tag", "/" + tag, tag not in INLINE, inner))
            continue
        if tag in ENDS_P:
            # an open paragraph ends, unless a block of its own stands in between
            for i in range(len(stack) - 1, -1, -1) if open_["p"] else ():
                name = elements[stack[i]][1]
                if name == "p":
                    close(i)
                    break
                if name not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and elements[stack[-1]][1] == tag:
            close(len(stack) - 1)
        parent = stack[-1] if stack else -1
        main = tag in MAIN or parent >= 0 and elements[parent][2]
        parts.append(("tag", tag, tag not in INLINE, len(elements)))
        elements.append((parent, tag, main, *_standing(tag, attrs, main)))
        if tag in VOID or page[end - 2] == "/":
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = start = size if end is None else end.start()
        stack.append(len(elements) - 1)
        open_[tag] += 1
    text(size)
    return parts, elements


@dataclass
class Weights:
    """Score of a word by its place, and of a tag (never positive).

    ``words``: by (place, whether in the marked article, or None where the page marks none).
    """

    words: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)
    word: float = 1.0  # of a place that was not seen in training
    tag: float = -0.05
    weak: float = DEFAULT.weak_cost
    least_marked: float = DEFAULT.least_marked
    least_parts: float = DEFAULT.least_parts

    def marks(self, parts: list[tuple]) -> bool:
        """Whether the page marks its article: what it marks is no small part of the words that score."""
        inside = outside = count = depth = 0
        for kind, what, place, out, main in parts:
            if kind == "tag":
                if main and what in MAIN:
                    count += depth == 0 and not out
                    depth += 1
                elif depth and what[0] == "/" and what[1:] in MAIN:
                    depth -= 1
            elif not out and (main or self.of_word(place, False, False) > 0):
                n = len(what.split())
                inside, outside = (inside + n, outside) if main else (inside, outside + n)
        return inside > 0 and inside >= (self.least_parts if count > 1 else self.least_marked) * (inside + outside)

    def of_word(self, place: str, marked: bool, inside: bool) -> float:
        if marked:
            w = self.words.get(inside, 1.0 if inside else -1.0)
            return max(w, 0.1) if inside else min(w, -0.1)
        if place.startswith("~") and place not in self.words:
            w = self.words.get(place[1:], self.word)
            return w - self.weak * abs(w)
        return self.words.get(place, self.word)


def learn(pages: list[str], cfg: ExtractConfig = DEFAULT) -> Weights:
    """Log-odds of content for words (by place) and tags, from pages that mark their article.

    Pages without a marked article teach nothing; without any such page words score 1
    everywhere and tags a little less than 0.
    """
    word, tag = Counter(), Counter()
    w = Weights(weak=cfg.weak_cost, least_marked=cfg.least_marked, least_parts=cfg.least_parts)
    for page in pages:
        parts = list(tokens(page))
        if not w.marks(parts):
            continue
        for kind, what, place, out, main in parts:
            if out:
                continue  # scores nothing in any page
            if kind == "tag":
                tag[what, main] += 1
            elif n := len(what.split()):
                word[place, main] += n
                word[main, main] += n
    if not word[True, True]:
        return w
    w.words = {
        p: max(-1.0, min(1.0, math.log((word[p, True] + cfg.smooth) / (word[p, False] + cfg.smooth)) / 2)) for p, _ in list(word)
    }
    # a tag costs what its share outside of articles says, next to nothing if it belongs to running text
    w.tags = {
        t: -0.001 - cfg.tag_cost * (tag[t, False] + 0.01) / (tag[t, True] + tag[t, False] + 0.02) for t, _ in list(tag)
    }
    return w


def extract(page: str, weights: Weights) -> str:
    """The main text of a page; empty if it has none."""
    parts = list(tokens(page))
    marked = weights.marks(parts)
    best, total, begin, region = 0.0, 0.0, 0, None
    decoded: dict[int, str] = {}
    for i, (kind, what, place, out, main) in enumerate(parts):
        if kind == "text" and not out:
            decoded[i] = text = _html.unescape(what)
            score = len(text.split()) * weights.of_word(place, marked, main)
        elif kind == "tag" and not out:
            score = weights.tags.get(what, weights.tag)
            if marked and main:
                score = max(score, -0.001)  # markup within the marked article does not part it
        else:
            score = 0.0
        if total <= 0 and score > 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, region = total, (begin, i)
    if region is None:
        return ""
    out_text: list[str] = []
    for i in range(region[0], region[1] + 1):
        kind, _, block, out, _ = parts[i]
        if kind == "tag":
            if block:
                out_text.append(" ")
        elif not out:
            out_text.append(decoded[i])
    return " ".join("".join(out_text).split())


def train(pages: DataFrame, html: str, order: str, cfg: ExtractConfig = DEFAULT) -> Weights:
    """Learn from a bounded sample of the pages that mark an article: those with the smallest hash of ``order``, up to ``cfg.pages``."""
    marked = pages.where((F.length(html) <= cfg.max_chars) & F.col(html).rlike(r"(?i)<(?:article|main)[\s/>]"))
    ids = marked.select(F.xxhash64(order).alias("h"), F.col(order).alias("o")).orderBy("h", "o").limit(cfg.pages)
    keys = [r["o"] for r in ids.collect() if r["o"] is not None]
    if not keys:
        return Weights()
    spark = pages.sparkSession
    picked = spark.createDataFrame([(k,) for k in keys], pages.select(F.col(order).alias("o")).schema).distinct()
    rows = (
        pages.select(F.col(order).alias("o"), F.col(html).alias("h")).where(F.length("h") <= cfg.max_chars)
        .join(F.broadcast(picked), "o").groupBy("o").agg(F.min("h").alias("h")).orderBy("o").collect()  # at most cfg.pages rows
    )
    return learn([r["h"] for r in rows], cfg)


def main_text(html: Column, weights: Weights) -> Column:
    """Main text of a column of pages; a null page counts as empty and gives an empty text."""

    @F.arrow_udf("string")
    def text_of(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in common.portions(it):
            yield pa.array([extract(p, weights) if p else "" for p in a.to_pylist()], pa.string())

    return text_of(html)
