"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes with their root-to-leaf tag paths. For every path the text length and
the punctuation are summed over its nodes; the path's ratios are text per node and punctuation per node (the
latter raised by its spread over the page). Both are smoothed along the page by a Gaussian over neighbouring
nodes, fused as their product, and thresholded at a share of the page's standard deviation: nodes above it
are content. The text is the smallest element that holds the content nodes, or the articles that hold them and
the content nodes outside of articles; every block in them is returned but for menus, headers, footers, sidebars, notices, adverts, forms and
comments, which are known by tag, role or class name. A form, and an element that is known by role or class name only, is no furniture if it
holds most of the content: it wraps the page.

Blocks are block-level elements (and table cells); white space inside a block becomes one blank, character
references are decoded, blocks are joined by \\n in page order. Parsing is lenient: unclosed and stray tags,
missing </body> and truncated pages give what can be read.

Defined results: null, empty and text-less pages give the empty text; text outside any tag counts as one block.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var".split())
SKIP = frozenset("script style textarea title xmp iframe noembed noframes template svg math head nav footer aside "
                 "noscript button select option input dialog menu object canvas audio video map".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                      "h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body main".split())

#: Class, id and role words of page furniture (whole words after splitting at -, _ and capitals).
FURNITURE = frozenset("ad ads advert advertisement adverts advertising banner promo promoted sponsor sponsored menu nav "
                      "navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent "
                      "gdpr notice popup modal newsletter subscribe signup login share sharing social related recommended "
                      "comment comments disqus replies reply respond pagination pager widget toolbar skip "
                      "contentinfo search complementary copyright".split())
#: Those of them that name what readers write.
REMARKS = frozenset("comment comments disqus replies reply respond".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                   r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
PUNCT = re.compile(r"[.,;:!?。，！？…\"¿¡]")
SIGMA, SHARE = 1.0, 0.3
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr pre blockquote dd dt".split()) | INLINE


class Element:
    __slots__ = ("tag", "parent", "depth", "path", "skip", "soft", "remark")

    def __init__(self, tag: str, parent: Element | None, skip: bool, soft: bool = False, remark: bool = False) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.skip = skip or (parent is not None and parent.skip)
        # the innermost element around (or itself) that is furniture unless it wraps the content
        self.soft = self if soft else parent.soft if parent else None
        self.remark = remark


def furniture(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether the element is page furniture: (by tag or hidden, by role, class, id or as a form, of readers' remarks)."""
    if tag in SKIP or (tag == "header" and not inside_article):
        return True, False, False
    soft, remark = tag == "form", False
    if not attrs or tag in ("body", "html", "article", "main"):
        return False, soft, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False, False
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True, False, False
        elif name != "aria-hidden":
            words = {w.lower() for w in WORDS.findall(value)}
            soft = soft or not words.isdisjoint(FURNITURE)
            remark = remark or not words.isdisjoint(REMARKS)
    return False, soft, remark


def nodes_of(page: str) -> list[tuple[Element, int, str, Element | None]]:
    """(block element, block number, raw text, innermost soft furniture) of the page's text nodes outside hard furniture."""
    root = Element("#", None, False)
    here, block, number, articles = root, root, 0, 0
    out: list[tuple[Element, int, str, Element | None]] = []
    at = 0

    def text(raw: str) -> None:
        if raw and not here.skip:
            out.append((block, number, raw, here.soft))

    def pop_to(el: Element) -> None:
        nonlocal here, block, number, articles
        while here is not el:
            articles -= here.tag in ("article", "main")
            if here.tag not in INLINE:
                number += 1
            here = here.parent
        e = here
        while e.tag in INLINE and e.parent:
            e = e.parent
        block = e

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            e = here
            while e is not root and e.tag != tag:
                # a stray inline end tag does not close blocks
                if tag in INLINE and e.tag not in INLINE:
                    e = root
                    break
                e = e.parent
            if e is not root:
                pop_to(e.parent)
            elif tag == "p":
                number += 1
            continue
        if tag in VOID:
            if tag == "hr":
                number += 1
            elif tag == "br" and not here.skip:
                out.append((block, number, " ", here.soft))
            continue
        if tag in P_CLOSERS:
            e = here
            while e.tag in INLINE or e.tag == "p":
                if e.tag == "p":
                    pop_to(e.parent)
                    break
                e = e.parent
        elif tag in SELF_CLOSING:
            e = here
            while e is not root and e.tag not in SCOPES:
                if e.tag in SELF_CLOSING[tag]:
                    pop_to(e.parent)
                    break
                e = e.parent
        here = Element(tag, here, *furniture(tag, m[3], articles > 0))
        articles += tag in ("article", "main")
        if tag not in INLINE:
            block = here
            number += 1
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    return out


def blocks_of(nodes: list[tuple[Element, int, str, Element | None]]) -> list[tuple[Element, str]]:
    """(block element, clean text) in page order; blocks without text are left out."""
    held: list[tuple[Element, int, list[str]]] = []
    for element, number, raw, _ in nodes:
        if held and held[-1][1] == number and held[-1][0] is element:
            held[-1][2].append(raw)
        else:
            held.append((element, number, [raw]))
    out = []
    for element, _, raws in held:
        raw = "".join(raws)
        clean = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if clean:
            out.append((element, clean))
    return out


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; the page's ends repeat."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), w / w.sum(), mode="valid")


def content_nodes(blocks: list[tuple[Element, str]]) -> np.ndarray:
    """Numbers of the blocks that the fused tag-path ratios select."""
    length: dict[str, list[int]] = defaultdict(list)
    marks: dict[str, list[int]] = defaultdict(list)
    for element, clean in blocks:
        length[element.path].append(len(clean))
        marks[element.path].append(len(PUNCT.findall(clean)))
    text = {p: sum(v) / len(v) for p, v in length.items()}
    # a path with much text and marks of uneven number is prose; menus are short and even
    punct = {p: (sum(v) / len(v)) * (1.0 + float(np.std(length[p]))) for p, v in marks.items()}
    t = smoothed(np.array([text[e.path] for e, _ in blocks]))
    q = smoothed(np.array([punct[e.path] for e, _ in blocks]))
    fused = t * np.log1p(q)
    limit = min(SHARE * float(fused.std()), float(fused.max()))
    return np.flatnonzero(fused >= limit)


def ancestors(e: Element) -> list[Element]:
    out = []
    while e is not None:
        out.append(e)
        e = e.parent
    return out


def outermost(soft: Element | None, open_: set[int]) -> Element | None:
    """The outermost soft furniture from ``soft`` up that is not open."""
    out = None
    while soft is not None:
        if id(soft) not in open_:
            out = soft
        soft = soft.parent.soft if soft.parent else None
    return out


def visible_nodes(nodes: list[tuple[Element, int, str, Element | None]]) -> list[tuple[Element, int, str, Element | None]]:
    """The nodes outside soft furniture; soft elements that hold most of the page's content are opened, from the
    outermost inwards, until an article or main comes to light."""
    if all(soft is None for *_, soft in nodes):
        return nodes
    every: list[tuple[Element, str, Element | None]] = []
    by_soft: dict[int, list] = defaultdict(list)
    for node in nodes:
        by_soft[id(node[3])].append(node)
    for some in by_soft.values():
        every += [(e, clean, some[0][3]) for e, clean in blocks_of(some)]
    if not every:
        return nodes
    order = {}
    for i, (e, *_) in enumerate(nodes):
        order.setdefault(id(e), i)
    every.sort(key=lambda x: order[id(x[0])])
    chosen = set(content_nodes([x[:2] for x in every]).tolist())
    open_: set[int] = set()
    while True:
        weight: dict[int, int] = defaultdict(int)
        shut: dict[int, Element] = {}
        article = False
        for k, (e, clean, soft) in enumerate(every):
            top = outermost(soft, open_)
            if top is None:
                article = article or any(a.tag in ("article", "main") for a in ancestors(e))
            else:
                shut[id(top)] = top
            weight[id(top)] += len(clean) * (k in chosen)
        out = weight.get(id(None), 0)
        # readers' remarks may outweigh the text that they are about
        shut = {i: x for i, x in shut.items() if not x.remark or not out}
        best = max(shut, key=lambda i: weight[i], default=None)
        if article or best is None or not weight[best] or (out and 2 * weight[best] <= sum(weight.values())):
            return [x for x in nodes if outermost(x[3], open_) is None]
        open_.add(best)


def main_text(page: str | None) -> str:
    blocks = blocks_of(visible_nodes(nodes_of(page or "")))
    if not blocks:
        return ""
    chosen = content_nodes(blocks)
    lines = [ancestors(e) for e, _ in blocks]
    # articles that hold chosen nodes are returned whole, with the chosen nodes outside of articles; without such an
    # article, the smallest element that holds all chosen nodes
    own = [next((x for x in reversed(line) if x.tag in ("article", "main")), None) for line in lines]
    whole = {id(own[k]) for k in chosen if own[k] is not None}
    if whole:
        keep = set(chosen.tolist())
        return "\n".join(clean for k, (_, clean) in enumerate(blocks) if k in keep or id(own[k]) in whole)
    common = {id(x) for x in lines[chosen[0]]}
    for k in chosen[1:]:
        common &= {id(x) for x in lines[k]}
    best = next(x for x in lines[chosen[0]] if id(x) in common)
    while best.tag in LEAVES and best.parent:
        best = best.parent
    return "\n".join(clean for (_, clean), line in zip(blocks, lines) if best in line)


def extractor():
    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    return extract


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    pages: DataFrame = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", "url", extractor()(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
