"""Main text of web pages by consensus host paths (operator 2).

Each page's containers are scored by the text of their blocks.  The best one votes, with its generalised tag-class path, for its host;
votes are counted in Spark.  Then every page is extracted anew with that of its paths that has most votes on its host; a page
that has none of the host's paths uses its own best container.

Parsing takes time in proportion to the page, however broken it is: each sign is passed once, and what an element inherits is kept with
it, so nothing walks up the tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash

#: Characters from which a path is named by its hash.
LONG_PATH = 300

# Elements by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "iframe", "textarea", "title", "head"}
DRAWN = {"svg", "math"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "option", "select", "button", "legend"}
CONTAINER = {"article", "main", "section", "div", "td", "body", "html", "center"}
LISTS = {"ul", "ol", "menu", "dl"}
DROPPED = {"noscript", "template", "object", "canvas", "svg", "math", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "label", "input", "option"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status"}
#: Words of a class or id that mark what is not the article.
DROPPED_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "navi", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promoted", "promotion", "recommend", "recommended", "related", "respond", "responses", "rightbar", "leftbar", "search", "searchbox", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "topbar", "topnav", "tracking", "trending", "widget", "widgets"}
#: Words of a class or id that mark it outside an article or main element only.
OUTER_WORDS = {"byline", "disclaimer", "replies", "reply", "search", "tags", "teaser"}
#: Words that mark an element as a frame of the article, whatever else it is called.
FRAME_WORDS = {"article", "body", "content", "container", "entry", "has", "layout", "main", "page", "post", "story", "text", "with", "wrap", "wrapper"}
#: Page headers, unless inside an article.
HEADER_WORDS = {"header", "head", "hero"}

_ATTR = re.compile(r"(?:^|(?<=[\s\"'/>=]))([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME, _STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[>\"']")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSE_RAW = {t: re.compile(rf"</{t}\b" + (r"|<body\b" if t == "head" else ""), re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "parent", "path", "dropped", "link", "article", "container", "block", "list", "score", "chars", "link_chars", "items", "inside", "menu")

    def __init__(self, tag: str, parent: "Element | None", attrs: dict[str, str]):
        self.tag, self.parent = tag, parent
        names = (attrs.get("class", "") + " " + attrs.get("id", "")).strip()
        words = {w.lower() for w in _NAME_WORDS.findall(names)} if names else set()
        label = tag + "".join(sorted({"." + re.sub(r"\d+", "", c).lower() for c in attrs.get("class", "").split()})) if "class" in attrs else tag
        self.path = f"{parent.path}/{label}" if parent else label
        if len(self.path) > LONG_PATH:
            self.path = f"#{hashlib.md5(self.path.encode('utf-8', 'replace')).hexdigest()}"
        above = bool(parent and parent.article)
        self.article = tag in ("article", "main") or above
        self.link = tag == "a" or bool(parent and parent.link)
        frame = tag in ("html", "body", "main", "article") or bool(words & FRAME_WORDS) and not words & {"comment", "comments", "sidebar", "footer", "nav", "menu", "ad", "ads", "related", "cookie"}
        self.dropped = bool(
            parent and parent.dropped
            or tag in DROPPED
            or (tag == "header" or words & HEADER_WORDS and tag not in ("h1", "h2", "h3")) and not self.article
            or (words & DROPPED_WORDS or words & OUTER_WORDS and not above) and not frame
            or attrs.get("role", "").lower() in DROPPED_ROLES
            or attrs.get("aria-hidden", "").lower() == "true"
            or "hidden" in attrs
            or "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I)
        )
        self.container = self if tag in CONTAINER or parent is None else parent.container
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.list = self if tag in LISTS else None if tag in CONTAINER or parent is None else parent.list
        self.score = self.chars = self.link_chars = self.items = 0
        self.inside = self.menu = False


class _Open:
    """The open elements, and where those of each kind are among them."""

    def __init__(self, root: Element):
        self.stack, self.at, self.blocks, self.bars = [root], {}, [], []

    def push(self, e: Element) -> None:
        n = len(self.stack)
        self.stack.append(e)
        self.at.setdefault(e.tag, []).append(n)
        if e.tag in BLOCK:
            self.blocks.append(n)
        if e.tag in CONTAINER or e.tag in LISTS or e.tag == "table":
            self.bars.append(n)

    def cut(self, k: int) -> None:
        """Closes the k-th element and all in it."""
        while len(self.stack) > k:
            n = len(self.stack) - 1
            self.at[self.stack.pop().tag].pop()
            for places in (self.blocks, self.bars):
                if places and places[-1] == n:
                    places.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def _tag_end(html: str, at: int) -> int:
    """Place of the '>' that ends a tag, quoted ones left out; a quote that nothing closes is none; -1: the tag doesn't end."""
    i = at
    while m := _STOP.search(html, i):
        if m[0] == ">":
            return m.start()
        i = html.find(m[0], m.end()) + 1
        if not i:
            return html.find(">", m.end())
    return html.find(">", at)


def parse(html: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements in the order that they begin, and the blocks (element, text) of the page in order.  Works on any input, however broken.

    An element that nothing closes ends with what it is in; one whose content would be passed over as it stands (a script) is then
    passed over up to the next tag only.
    """
    root = Element("html", None, {})
    now, elements, blocks, text, links, at, n = _Open(root), [root], [], [], 0, 0, len(html)
    endless: set[str] = set()

    def end_block() -> None:
        nonlocal links
        if text:
            made = " ".join(unescape("".join(text)).split())
            if made:
                e = now.stack[-1].block
                blocks.append((e, made))
                if e.list is not None:
                    e.list.chars += len(made)
                    e.list.link_chars += min(links, len(made))
                    e.list.items += 1
                if not e.dropped:
                    gain = max(0, len(made) - 2 * links)
                    e.container.score += gain
                    if e.container.parent:
                        e.container.parent.container.score += gain / 2
            text.clear()
        links = 0

    def add(s: str) -> None:
        nonlocal links
        if s and not now.stack[-1].dropped:
            text.append(s)
            if now.stack[-1].link:
                links += len(s)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        add(html[at:start])
        at = start + 1
        if html.startswith("!--", at):
            end = html.find("-->", at + 3) if "!--" not in endless else -1
            if end < 0:
                endless.add("!--")
                end = html.find(">", at)
            at = end + 3 if end >= 0 and html.startswith("-->", end) else end + 1 if end >= 0 else n
        elif html[at : at + 1] in ("!", "?"):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else n
        elif m := _NAME.match(html, at):
            end = _tag_end(html, m.end())
            if end < 0:
                add(html[start:])
                break
            tag, rest, at = m[0].lower(), html[m.end() : end], end + 1
            attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(rest)} if "=" in rest else {}
            if "hidden" in rest and re.search(r"(?:^|\s)hidden(?:\s|/|$)", rest, re.I):
                attrs["hidden"] = ""
            if tag in BLOCK:
                end_block()
                if (k := now.last(DRAWN)) > 0:  # a drawing holds no blocks: it was not closed
                    now.cut(k)
                k = now.last(CLOSES.get(tag, set()) | {"p"})
                if k > 0 and k >= (now.bars[-1] if now.bars else 0):
                    now.cut(k)
            if tag in RAW and not rest.endswith("/"):
                m = _CLOSE_RAW[tag].search(html, at) if tag not in endless else None
                if m:
                    end = html.find(">", m.end())
                    at = m.start() if m[0][1] != "/" else end + 1 if end >= 0 else n
                else:
                    endless.add(tag)
                    if tag != "head":
                        end = html.find("<", at)
                        at = end if end >= 0 else n
            elif tag != "html" and tag not in VOID and not (rest.endswith("/") and tag not in BLOCK):
                e = Element(tag, now.stack[-1], attrs)
                now.push(e)
                elements.append(e)
        elif html[at : at + 1] == "/" and (m := _NAME.match(html, at + 1)):
            end = html.find(">", m.end())
            if end < 0:
                add(html[start:])
                break
            tag, at = m[0].lower(), end + 1
            if tag in BLOCK:
                end_block()
            k = now.last((tag,))
            if k > 0 and (tag in BLOCK or not now.blocks or k > now.blocks[-1]):
                now.cut(k)
        else:
            add("<")
    end_block()
    return elements, blocks


def weight(e: Element) -> float:
    return 0.0 if e.dropped else e.score * (1.5 if e.tag in ("article", "main") else 1.0)


def best_container(elements: list[Element]) -> Element | None:
    best = max((e for e in elements if e.container is e), key=weight)
    return best if weight(best) > 0 else None


def frame(elements: list[Element], parts: list[Element]) -> Element:
    """The smallest element that holds all of parts; if it is in an article or main element, the innermost such one."""
    held = {id(e): 1 for e in parts}
    for e in reversed(elements):  # what is in an element begins after it
        if e.parent is not None and id(e) in held:
            held[id(e.parent)] = held.get(id(e.parent), 0) + held[id(e)]
    up = shared = [e for e in elements if held.get(id(e)) == len(parts)][-1]
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up or shared


def main_text(html: str, paths: list[str]) -> tuple[str, str]:
    """Text of the page's article and the path used ('' if there is none): the first of the paths that the page has, else its own best."""
    elements, blocks = parse(html)
    own = best_container(elements)
    if own is None:
        return "", ""
    by_path: dict[str, list[Element]] = {}
    for e in elements:
        if e.container is e and weight(e) > 0:
            by_path.setdefault(e.path, []).append(e)
    path = next((p for p in paths if p in by_path), own.path)
    chosen = frame(elements, by_path[path])
    for e in elements:
        e.inside = e is chosen or e.parent is not None and e.parent.inside
        e.menu = e.tag in LISTS and e.items > 1 and e.link_chars > 0.8 * e.chars or e.parent is not None and e.parent.menu
    return " ".join([text for e, text in blocks if e.inside and not e.menu and not e.dropped]), path


def host(url: Column) -> Column:
    """Host of a URL in lower case; '' if it has none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def page_paths(pages: DataFrame) -> DataFrame:
    """(rid, host, best, paths) of pages (rid, url, html) that have an article: the best container's path, and those of all that could be it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, best, paths = [], [], []
            for k, html in enumerate(b.column("html").to_pylist()):
                elements, _ = parse(html or "")
                own = best_container(elements)
                if own is not None:
                    at.append(k)
                    best.append(own.path)
                    paths.append(sorted({e.path for e in elements if e.container is e and weight(e) > 0}))
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid").take(took), b.column("host").take(took), pa.array(best, pa.string()), pa.array(paths, pa.list_(pa.string()))], names=["rid", "host", "best", "paths"])

    return pages.select("rid", host(F.col("url")).alias("host"), "html").mapInArrow(read, "rid long, host string, best string, paths array<string>")


def consensus(read: DataFrame) -> DataFrame:
    """(rid, path) for read (rid, host, best, paths): of each page's paths the one with most votes on its host, of equal ones the first by name;
    only where it isn't the page's best.

    Votes are counted by host and path, whatever their number; pages of one text and host are one row.
    """
    votes = read.groupBy(F.col("host").alias("h"), F.col("best").alias("p")).agg(F.count(F.lit(1)).alias("votes"))
    rows = read.dropDuplicates(["rid"]).select("rid", "host", "best", F.explode("paths").alias("path"))
    held = rows.join(votes, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    # the most votes, then the first name: the smallest of (-votes, path)
    won = held.groupBy("rid").agg(F.min(F.struct((-F.col("votes")).alias("order"), "path")).alias("w"), F.first("best").alias("best"))
    return won.where("w.path <> best").select("rid", F.col("w.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every row of pages.

    Null and empty html, and pages without an article, have an empty text and path.  Null urls and urls without a host share one host.
    Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [main_text(h or "", [p] if p else []) for h, p in zip(b.column("html").to_pylist(), b.column("use").to_pylist())]
            texts, used = ([x[k] for x in made] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    rows = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("rid"))
    other = stash(consensus(stash(page_paths(rows), "page_paths")), "consensus").select(F.col("rid").alias("of"), F.col("path").alias("use"))
    return rows.join(other, F.col("rid") == F.col("of"), "left").select("page_id", "url", "html", "use").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")


def op2_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() over all pages."""
    return extract(read_table(spark, sf_dir, "pages"))
