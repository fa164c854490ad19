"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text in page order. A linear classifier over a block's length, link share, punctuation and kind gives its
evidence, to which what stands around it adds: a capacity from the source (content) or to the sink (boilerplate). Blocks
that follow each other, and blocks of the same or a near parent, are joined by smoothness edges. A maximum flow finds the
cheapest cut; blocks on the source's side are the main text.

The classifier is trained on the pages themselves, on blocks whose place is certain (inside an article or main element against
navigation, footers and the like). These are counted by their features, of which there are at most COMBINATIONS, over all pages, so
what comes to the driver is bounded; where there are few, the weights stay near fixed ones.

An element's mark of boilerplate (kind, role, or class names of which every part says so) holds for what is below it, unless the
element is the page's frame: it holds an article, main or h1 element, or most of the page's prose.

Null and empty html give an empty text; unclosed and stray tags, unclosed comments and truncated pages are read
as far as they go; repeated rows give repeated rows; an empty table gives an empty table. Only the named
columns are read, so further columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.llm.common import bounded_batches

# Elements of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
BOILER = {"nav", "aside", "footer", "dialog", "menu", "head", "datalist"}
CONTROLS = {"button", "select", "option"}
FORMS = {"form", "fieldset"}
CONTENT = {"article", "main"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
FORM_ROLES = {"form", "search"}
BOILER_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "promo", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "menus",
    "breadcrumb", "breadcrumbs", "sidebar", "aside", "related", "recommended", "footer", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "newsletter", "subscribe",
    "subscription", "signup", "login", "popup", "modal", "overlay", "share", "sharing", "pagination", "pager", "toolbar", "copyright", "topbar",
}
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
#: Names that boilerplate and articles share: weak evidence that the text itself and its neighbours can outvote.
UNSURE_NAMES = {"banner", "disclaimer", "legal", "masthead", "privacy", "promotion", "search", "skip", "social", "tags", "widget"}
#: Parts of a class name that say nothing either way; a name with any other part is taken for another word.
NEUTRAL_NAMES = {
    "area", "bar", "body", "bottom", "box", "block", "button", "buttons", "col", "column", "container", "content", "entry", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list",
    "main", "outer", "page", "panel", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "text", "title", "top", "unit", "user", "wrap", "wrapper",
}
#: A class with such a part says what stands beside an element, not what it is.
BESIDE = {"has", "no", "not", "with", "without"}
CONTENT_NAMES = {"article", "entry", "post", "story", "content", "main", "text", "body"}
#: A block of this text opens the readers' comments of its container.
COMMENTS_BEGIN = re.compile(r"(?:\d+\s+)?(?:reader |user )?(?:comments?|commentaires?|kommentare?|comentarios?)(?:\s*\(?\d+\)?)?:?|leave a (?:comment|reply)", re.I)
#: A short block with both is a notice about cookies.
COOKIE, ASKS = re.compile(r"\bcookies?\b", re.I), re.compile(r"accept|agree|consent|policy|we use|verwende|akzept|utilis|accepte|utiliza|acepta", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEAVES, HEADINGS = {"p", "li", "dt", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPES = {"table", "ul", "ol", "dl", "div", "article", "section", "body", "main", "aside", "nav", "footer", "header", "form", "td", "blockquote", "select"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: One attribute: its whole name, then its value, so that what stands in a value is never taken for a name.
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Hundredths of a nat: what marks and content elements add, by kind, and the edges of blocks by their distance in the tree.
W_MARK = {"tag": -700, "control": -1500, "hidden": -1500, "form": -600, "name": -500, "comment": -700, "unsure": -300, "cookie": -600}
W_INSIDE, W_OUTSIDE = 250, -350
NEXT_EDGE, NEAR_EDGE, COUSIN_EDGE, SIBLING_EDGE = 90, 60, 30, 70
#: Shares of a page's prose beyond which a marked element is the page's frame; the others are never one by that.
FRAME = {"form": 0.5, "name": 0.5, "unsure": 0.5, "comment": 0.9}

#: Features of a block: length (doubling from 8 characters), links (none, some, half, most, all), end of a sentence, and kind (paragraph, heading, list
#: item, other), each as one of so many; and the fixed weights that training starts from.
LENGTHS, LINKS, KINDS = 8, 5, 4
COMBINATIONS = LENGTHS * LINKS * 2 * KINDS
WEIGHTS = (-120, *(45 * k for k in range(LENGTHS)), 0, -60, -180, -300, -350, 60, 100, 125, 125, 0)
#: Weight of the fixed weights in training, in blocks.
RIDGE = 200.0


class Block:
    __slots__ = ("text", "chars", "link_chars", "tag", "parent", "grand", "mark", "inside", "deeper", "heading")


class Mark(NamedTuple):
    """A mark of boilerplate: its kind, the mark around it (-1: none), and whether it stands inside an element of content."""

    kind: str
    around: int
    inside: bool


class Open(NamedTuple):
    """An open element: its own number, its innermost mark (-1: none), and whether it is inside content, its mark further inside still."""

    tag: str
    number: int
    mark: int = -1
    inside: bool = False
    deeper: bool = False


def _named(word: str) -> set[str]:
    """The parts of a class name, in lower case: at hyphens, underscores, digits and before capitals."""
    return set(x.lower() for x in NAME.findall(word))


def _judge(tag: str, attrs: str) -> tuple[str, bool]:
    """The kind of mark that an element is (none: empty), and whether it is content."""
    mark = "tag" if tag in BOILER else "control" if tag in CONTROLS else "form" if tag in FORMS else ""
    content = tag in CONTENT
    if attrs and tag not in ("html", "body"):
        for name, *values in ATTR.findall(attrs):
            name, raw = name.lower(), (values[0] or values[1] or values[2]).strip()
            value = raw.lower()
            if name == "role":
                mark = "tag" if value in BOILER_ROLES else mark or ("form" if value in FORM_ROLES else "")
                content |= value in ("main", "article")
            elif name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return "hidden", False
            elif name in ("class", "id") and tag != "h1":
                for word in raw.split():
                    parts = _named(word)
                    own = parts - NEUTRAL_NAMES
                    if not own.isdisjoint(BESIDE):
                        continue
                    if own and own <= BOILER_NAMES | COMMENT_NAMES | UNSURE_NAMES:
                        kind = "comment" if own & COMMENT_NAMES else "name" if own & BOILER_NAMES else "unsure"
                        # An article that is called an advert or related may be one, but its text has to tell.
                        mark = mark or (kind if tag not in CONTENT or kind == "comment" else "unsure" if own & {"related", "promo"} else "")
                    content |= name == "id" and bool(parts & CONTENT_NAMES) and parts <= CONTENT_NAMES | NEUTRAL_NAMES
    return mark, content and not mark


class Stack:
    """The open elements, with the places of each kind, so that no look-up walks over them."""

    def __init__(self) -> None:
        self.all, self.at, self.scopes = [Open("", 0)], {}, [0]

    def push(self, e: Open) -> None:
        self.at.setdefault(e.tag, []).append(len(self.all))
        if e.tag in SCOPES:
            self.scopes.append(len(self.all))
        self.all.append(e)

    def cut(self, k: int) -> None:
        """Close all elements from place k on."""
        for e in reversed(self.all[k:]):
            self.at[e.tag].pop()
            if e.tag in SCOPES:
                self.scopes.pop()
        del self.all[k:]

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a kind; 0 if none is open."""
        places = self.at.get(tag)
        return places[-1] if places else 0


def blocks(html: str) -> list[Block]:
    """Blocks of text of a page in page order, each with the mark that holds for it, if any, as ``mark``: frames are taken off."""
    out: list[Block] = []
    marks: list[Mark] = []
    begun: list[int] = []  # the first block of each mark
    holds: set[int] = set()  # marks with an element of content or an h1 below
    opened = Stack()
    stack = opened.all
    count, parts, chars, links, in_link, at = 0, [], 0, 0, False, 0

    def end_block() -> None:
        nonlocal parts, chars, links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                b, top = Block(), stack[-1]
                b.text, b.chars, b.link_chars, b.tag, b.parent = text, max(1, chars), links, top.tag, top.number
                b.grand = stack[-2].number if len(stack) > 1 else 0
                if top.tag in LEAVES and len(stack) > 1:  # a paragraph's place is its container
                    b.parent, b.grand = stack[-2].number, stack[-3].number if len(stack) > 2 else 0
                b.mark, b.inside, b.deeper = top.mark, top.inside, top.deeper
                b.heading = top.tag in HEADINGS
                out.append(b)
                if chars <= 40 and COMMENTS_BEGIN.fullmatch(text):  # from here on its container holds comments
                    at_ = len(stack) - (2 if top.tag in LEAVES and len(stack) > 1 else 1)
                    stack[at_] = marked(stack[at_], "comment")
                    b.mark, b.deeper = stack[at_].mark, True
            parts, chars, links = [], 0, 0

    def marked(e: Open, kind: str) -> Open:
        marks.append(Mark(kind, e.mark, e.inside))
        begun.append(len(out))
        return e._replace(mark=len(marks) - 1, deeper=True)

    def words(s: str) -> None:
        nonlocal chars, links
        if s:
            parts.append(s)
            n = len(s.strip())
            chars += n
            links += n if in_link else 0

    m = TOKEN.search(html)
    while m:
        words(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            pass
        elif closing:
            if tag == "a":
                in_link = False
            if tag in ("p", "br"):
                end_block()
            if tag not in INLINE and opened.last(tag):
                end_block()
                opened.cut(opened.last(tag))
                in_link = False
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else len(html)
        elif tag == "br":
            words(" ")
        elif tag in INLINE:
            in_link = tag == "a" or in_link
        else:
            end_block()
            in_link = False
            if tag in CLOSES:
                k = max(map(opened.last, CLOSES[tag]))
                if k and k >= opened.scopes[-1]:
                    opened.cut(k)
            elif stack[-1].tag == "p":  # a block element ends an open paragraph
                opened.cut(len(stack) - 1)
            if tag not in VOID:
                count += 1
                mark, content = _judge(tag, attrs)
                up = stack[-1]
                if tag == "header" and not up.inside:
                    mark = mark or "tag"
                if content or tag == "h1":
                    k = up.mark
                    while k >= 0 and k not in holds:
                        holds.add(k)
                        k = marks[k].around
                e = Open(tag, count, up.mark, up.inside or content, up.deeper and not content)
                opened.push(marked(e, mark) if mark else e)
        m = TOKEN.search(html, at)
    words(html[at:])
    end_block()
    return _framed(out, marks, begun, holds)


def _prose(b: Block) -> int:
    """Characters of a block that reads like text rather than like a menu."""
    return b.chars if b.chars >= 40 and 3 * b.link_chars < b.chars else 0


def _framed(found: list[Block], marks: list[Mark], begun: list[int], holds: set[int]) -> list[Block]:
    """Blocks with the mark that holds for each; marks of the page's frame hold for none."""
    sums, prose = [0] * len(marks), [_prose(b) for b in found]
    for b, n in zip(found, prose):
        if b.mark >= 0:
            sums[b.mark] += n
    for k in range(len(marks) - 1, -1, -1):  # a mark's number is above that of the one around it
        if marks[k].around >= 0:
            sums[marks[k].around] += sums[k]
    total = max(1, sum(prose))
    strong: list[str] = []
    for k, m in enumerate(marks):
        wide = m.kind in FRAME and sums[k] > FRAME[m.kind] * total
        frame = m.kind not in ("control", "hidden") and (wide or k in holds and m.kind != "comment")
        outer = strong[m.around] if m.around >= 0 else ""
        own = "" if frame else m.kind
        strong.append(own if not outer or own and W_MARK[own] < W_MARK[outer] else outer)
    for b in found:
        b.deeper = b.deeper and b.mark >= 0 and bool(strong[b.mark])
        b.mark = strong[b.mark] if b.mark >= 0 else ""
        if not b.mark and b.chars <= 400 and COOKIE.search(b.text) and ASKS.search(b.text) and not b.inside:
            b.mark = "cookie"
    return found


def features(b: Block) -> int:
    """A block's features as one number below COMBINATIONS."""
    share = min(b.link_chars, b.chars) / b.chars
    links = 0 if not b.link_chars else 1 if share < 0.25 else 2 if share < 0.5 else 3 if share < 0.9 else 4
    kind = 0 if b.tag in ("p", "blockquote", "pre") else 1 if b.heading else 2 if b.tag in ("li", "dt", "dd") else 3
    length = min(LENGTHS - 1, (len(b.text) // 8).bit_length())
    return ((length * LINKS + links) * 2 + (b.text[-1] in ".!?:;\"'»”…。")) * KINDS + kind


def _parts(combination: int) -> list[int]:
    """Places in WEIGHTS of a combination's features."""
    rest, kind = divmod(combination, KINDS)
    rest, stop = divmod(rest, 2)
    length, links = divmod(rest, LINKS)
    return [0, 1 + length, 1 + LENGTHS + links, *([1 + LENGTHS + LINKS] if stop else []), 2 + LENGTHS + LINKS + kind]


def odds(weights: tuple[int, ...] = WEIGHTS) -> list[int]:
    """The classifier's log-odds for content of every combination of features, in hundredths."""
    return [sum(weights[p] for p in _parts(c)) for c in range(COMBINATIONS)]


ODDS = odds()


def evidence(b: Block, has_inside: bool, table: list[int] | None = None) -> int:
    """A block's log-odds for content, in hundredths: the classifier's and what stands around it."""
    score = (table or ODDS)[features(b)]
    if b.mark:
        score += W_MARK[b.mark]
    if has_inside:
        score += W_INSIDE if b.inside and not b.deeper else W_OUTSIDE
    return score


def certain(html: str | None) -> list[tuple[int, bool]]:
    """Features of a page's blocks whose place is certain, and whether they are content."""
    out = []
    for b in blocks(html) if html else []:
        if b.inside and not b.deeper and not b.mark:
            out.append((features(b), True))
        elif b.mark in ("tag", "name", "comment"):
            out.append((features(b), False))
    return out


def fit(counts: dict[tuple[int, bool], int], rounds: int = 25) -> tuple[int, ...]:
    """Weights of a logistic regression over counted combinations, both classes of equal weight in all, drawn towards WEIGHTS as by
    RIDGE blocks; by Newton's steps, so the same for the same counts. Without either class WEIGHTS themselves."""
    sides = [sum(n for (_, y), n in counts.items() if y == side) for side in (False, True)]
    start = np.array(WEIGHTS) / 100
    if not min(sides):
        return WEIGHTS
    keys = sorted(counts)
    x = np.zeros((len(keys), len(WEIGHTS)))
    for k, (c, _) in enumerate(keys):
        x[k, _parts(c)] = 1
    y = np.array([float(y) for _, y in keys])
    n = np.array([counts[k] * sum(sides) / 2 / sides[k[1]] for k in keys])
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + RIDGE * (w - start)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
        w -= np.clip(step, -1, 1)
    return tuple(int(v) for v in np.clip(np.rint(100 * w), -600, 600))


def min_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Per node whether it is on the source's side of a minimum cut. gains: capacity from the source, or to
    the sink where negative; edges: both ways. Dinic's algorithm; ties go to the source's side."""
    n = len(gains)
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[int] = []
    for a, b, c in edges:
        near[a].append(len(to))
        to.append(b)
        cap.append(c)
        near[b].append(len(to))
        to.append(a)
        cap.append(c)
    supply = [max(0, g) for g in gains]
    demand = [max(0, -g) for g in gains]
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i]]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            reached |= demand[i] > 0
            for e in near[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            break
        turn = [0] * n
        for s in range(n):
            while supply[s]:
                path, i, dead = [], s, False
                while not demand[i]:
                    while turn[i] < len(near[i]):
                        e = near[i][turn[i]]
                        if cap[e] and level[to[e]] == level[i] + 1:
                            break
                        turn[i] += 1
                    else:
                        if not path:
                            dead = True
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        turn[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if dead:
                    break
                flow = min([supply[s], demand[i], *(cap[e] for e in path)])
                supply[s] -= flow
                demand[i] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
    # What can still reach the sink is boilerplate; the rest is content.
    sink = [d > 0 for d in demand]
    queue = [i for i in range(n) if sink[i]]
    for i in queue:
        for e in near[i]:
            if cap[e ^ 1] and not sink[to[e]]:
                sink[to[e]] = True
                queue.append(to[e])
    return [not s for s in sink]


def main_text(html: str | None, table: list[int] | None = None) -> str:
    """The content blocks of a page, joined by one space. table: the classifier's log-odds."""
    if not html:
        return ""
    found = blocks(html)
    if not found:
        return ""
    has_inside = any(b.inside and not b.mark for b in found)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            near = b.parent in (a.grand, a.parent) or a.parent == b.grand or a.grand == b.grand
            edges.append((i - 1, i, NEXT_EDGE if a.parent == b.parent else NEAR_EDGE if near else COUSIN_EDGE))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING_EDGE))
        elif ("g", b.grand) in last and last["g", b.grand] != i - 1:
            edges.append((last["g", b.grand], i, COUSIN_EDGE))
        last[b.parent] = last["g", b.grand] = i
    keep = min_cut([evidence(b, has_inside, table) for b in found], edges)
    return " ".join(b.text for b, k in zip(found, keep) if k)


def learn(df: DataFrame, html_col: str = "html") -> tuple[int, ...]:
    """The classifier's weights, from the certain blocks of all pages; at most twice COMBINATIONS counts come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, bool]] = Counter()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                for html in b.slice(k, 1000).column(0).to_pylist():
                    seen.update(certain(html))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.int32()), pa.array([y for _, y in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["c", "y", "n"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "c int, y boolean, n long").groupBy("c", "y").agg(F.sum("n").alias("n")).collect()
    return fit({(r["c"], r["y"]): r["n"] for r in rows})


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[int, ...] | None = None) -> DataFrame:
    """id, url and main text of every page. weights: of the classifier; by default learned from df."""
    out = T.StructType([df.schema[id_col], df.schema[url_col], T.StructField("text", T.StringType())])
    table = odds(learn(df, html_col) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                texts = [main_text(h, table) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    bounded_batches(df.sparkSession)
    return df.select(id_col, url_col, F.col(html_col).cast("string").alias("html")).mapInArrow(run, out)
