"""Main text of an HTML page, by a minimum cut.

A page is a row of text blocks. A logistic classifier gives each block a cost of being
called content and one of being called boilerplate; these are the capacities to the two
terminals. Edges between neighbours, and between blocks that follow each other under the
same element, make it cost something to part them. The minimum cut is the cheapest
labelling. A block whose own preference outweighs all its edges keeps it in every minimum
cut, so only the doubtful blocks need the flow.

The classifier starts from stated prior weights and is fitted, on a bounded sample of
pages, to blocks whose place in the page leaves no doubt.
"""

from __future__ import annotations

import html
import re
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacansight.llm.common import mapped
from vacansight.llm.maxflow import Flow

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=[a-zA-Z/])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
NAME = re.compile(r"[a-z0-9]+")

SILENT = frozenset("script style noscript template svg math canvas iframe object audio video select option textarea button head title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "body"}
#: Words of class, id and role that tell what a region is for.
SIGNS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager skip sitemap toc".split(),
    "edge": "header masthead topbar footer foot bottom copyright legal imprint colophon banner".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more teaser complementary".split(),
    "note": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall promo toast message".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promoted promotion adsense adslot commercial".split(),
    "reader": "comment comments commentlist disqus respond reply replies discussion discussions reviews share sharing social".split(),
    "main": "article articlebody post entry content main maincontent story body text prose".split(),
}
SIGN_OF = {w: k for k, words in SIGNS.items() for w in words}
TAG_SIGN = {"nav": "menu", "menu": "menu", "header": "edge", "footer": "edge", "aside": "side", "dialog": "note", "form": "form", "fieldset": "form", "article": "article", "main": "main_tag"}
FEATURES = ["bias", "menu", "edge", "side", "note", "advert", "reader", "form", "article", "main", "main_tag", "links", "words", "stops", "paragraph", "heading", "item"]
PRIOR = dict(zip(FEATURES, [-0.6, -7, -7, -7, -7, -8, -8, -7, 3.5, 2, 2.5, -3, 0.35, 0.4, 0.8, 0.3, -0.3]))
AWAY = frozenset(["menu", "edge", "side", "note", "advert", "reader", "form"])
NEAR, SAME = 0.35, 0.5  #: what it costs to part neighbours, and blocks that follow each other under one element


def region(tag: str, attributes: str, inside: frozenset, within_article: bool) -> frozenset:
    """Signs of an element: those of the elements around it and its own."""
    own = set()
    if tag in TAG_SIGN and not (tag == "header" and within_article):
        own.add(TAG_SIGN[tag])
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()
            words = NAME.findall(value)
            found = {SIGN_OF[w] for w in words if w in SIGN_OF}
            if "main" in found and found & AWAY:
                found.discard("main")
            if within_article or tag in ("article", "main"):
                found.discard("edge")
            own |= found
    return inside | own if own else inside


def blocks_of(page: str) -> list[tuple[str, str, frozenset, int, float]]:
    """(text, element, signs, number of the parent element, share of link text) of each non-empty block, in page order."""
    out, parts, linked, length = [], [], 0, 0
    stack: list[tuple[str, frozenset, int, bool]] = [("", frozenset(), 0, False)]  # element, signs, number, shown
    born, links, hidden, at = 0, 0, 0, 0

    def end_block() -> None:
        nonlocal parts, linked, length
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, signs, _, _ = next((x for x in reversed(stack) if x[0] in BLOCKS), stack[0])
                parent = next((x[2] for x in reversed(stack) if x[0] in BLOCKS and x[0] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")), 0)
                out.append((text, tag, signs, parent, linked / max(length, 1)))
        parts, linked, length = [], 0, 0

    def say(text: str) -> None:
        nonlocal linked, length
        if text and not hidden:
            parts.append(text)
            length += len(text)
            linked += len(text) if links else 0

    def close(upto: int) -> None:
        nonlocal links, hidden
        while len(stack) > upto:
            tag, _, _, silent = stack.pop()
            links -= tag == "a"
            hidden -= silent

    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in BLOCKS:
                end_block()
            if place and (tag in BLOCKS or not any(x[0] in BLOCKS for x in stack[place:])):
                close(place)
            continue
        if tag in BLOCKS:
            end_block()
            if tag in CLOSES_P and (p := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)) and stack[p][0] == "p":
                close(p)
            if tag in ("li", "dd", "dt", "tr", "td", "th"):
                stop = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in ("ul", "ol", "dl", "table", "tr") or stack[i][0] == tag), 0)
                if stop and stack[stop][0] == tag:
                    close(stop)
        elif tag == "br":
            say("\n")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        born += 1
        signs = stack[-1][1]
        silent = tag in SILENT or bool(m[3] and HIDDEN.search(m[3]))
        stack.append((tag, region(tag, m[3], signs, "article" in signs), born, silent))
        hidden += silent
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    say(page[at:])
    end_block()
    return out


def vector(block: tuple) -> list[float]:
    text, tag, signs, _, links = block
    words = text.count(" ") + 1
    place = {"p": "paragraph", "pre": "paragraph", "blockquote": "paragraph", "li": "item"}.get(tag, "heading" if len(tag) == 2 and tag[0] == "h" else "")
    own = {"bias": 1.0, "links": links, "words": log(words), "stops": min(3, text.count(". ") + text.count(", ") + (text[-1] in ".!?")), place: 1.0}
    return [own.get(f, 1.0 if f in signs else 0.0) for f in FEATURES]


def evident(block: tuple) -> int:
    """1 and 0 where the place of a block says what it is, else -1."""
    text, tag, signs, _, links = block
    if signs & AWAY:
        return 0
    return 1 if signs & {"article", "main_tag"} and tag == "p" and links < 0.2 and text.count(" ") >= 10 else -1


def labelled(blocks: list[tuple], weights: np.ndarray) -> list[bool]:
    """Content or not, by the minimum cut."""
    n = len(blocks)
    if not n:
        return []
    want = (np.array([vector(b) for b in blocks]) @ weights).tolist()
    edges: list[tuple[int, int, float]] = [(i, i + 1, NEAR) for i in range(n - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b[3] in last:
            edges.append((last[b[3]], i, SAME))
        last[b[3]] = i
    around = [0.0] * n
    for a, b, c in edges:
        around[a] += c
        around[b] += c
    open_ = [i for i in range(n) if abs(want[i]) <= around[i]]
    keep = [w > 0 for w in want]
    if open_:
        place = {i: k + 2 for k, i in enumerate(open_)}
        pull = {i: want[i] for i in open_}
        flow = Flow(len(open_) + 2)
        for a, b, c in edges:
            if a in place and b in place:
                flow.edge(place[a], place[b], c, c)
            elif a in place or b in place:  # the other end is settled
                i, other = (a, b) if a in place else (b, a)
                pull[i] += c if keep[other] else -c
        for i in open_:
            flow.edge(0, place[i], pull[i]) if pull[i] > 0 else flow.edge(place[i], 1, -pull[i])
        flow.run(0, 1, 1e-9)
        side = flow.reached(0, 1e-9)
        for i in open_:
            keep[i] = side[place[i]]
    return keep


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = 500, pull: float = 0.02, steps: int = 300) -> np.ndarray:
    """Logistic weights: nearest the prior that explain the evident blocks of ``sample`` pages, taken in the
    order of a hash of the id. Without such blocks the prior stands."""
    some = pages.select(F.col(id_col).alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample).distinct()
    picked = pages.join(F.broadcast(some), pages[id_col] == some["_id"], "left_semi").select(html_col)  # at most ``sample`` ids

    def start():
        def work(texts):
            return ([None] * len(texts), [["%d %s" % (evident(b), " ".join(f"{x:.4g}" for x in vector(b))) for b in blocks_of(t or "") if evident(b) >= 0] for t in texts])

        return work

    rows = mapped(picked, html_col, {html_col: "string", "_rows": "array<string>"}, start).select(F.explode("_rows").alias("r"))
    counted = rows.groupBy("r").count().collect()
    prior = np.array([PRIOR[f] for f in FEATURES], float)
    if not counted:
        return prior
    data = np.array([[float(x) for x in r["r"].split()] + [r["count"]] for r in sorted(counted)])
    y, x, n = data[:, 0], data[:, 1:-1], data[:, -1] / data[:, -1].sum()
    w = prior.copy()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ ((q - y) * n) + pull * (w - prior))
    return w


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the content blocks joined by a line break, and ``n_chars``; without the html.

    Null, empty and text-free pages give an empty text. Repeated rows are answered alike,
    and columns with the two names are replaced.
    """

    def start():
        def work(texts):
            out = []
            for t in texts:
                blocks = blocks_of(t or "")
                out.append("\n".join(b[0] for b, k in zip(blocks, labelled(blocks, weights)) if k))
            return [None] * len(texts), out, [len(t) for t in out]

        return work

    return mapped(pages, html_col, {html_col: "string", "text": "string", "n_chars": "bigint"}, start).drop(*({html_col} - {"text"}))
