"""Main text of web pages, with site templates counted out.

A page is parsed once, by a tolerant tree builder, into blocks of text.  Every
element keeps a hash of its subtree, that is of its tags and text.  Spark counts
these hashes per host, over pages that differ; a subtree that recurs on many
pages of its host is template and is deleted, with all blocks in it.  What does
not recur, because a host has few pages or a part changes with the page, but is
declared to be no article by markup or names (navigation, headers, footers,
sidebars, notices, adverts, forms, reader comments, hidden parts), goes too.

Containers, and outside an article every element, are template from
``MIN_PAGES`` pages on if these are ``MIN_SHARE`` of the host's, and from
``ENOUGH_PAGES`` on whatever the host's size.  A paragraph, heading or list item
inside an article is template only if it stands on ``LINE_SHARE`` of the host's
pages, as a site-wide notice does: one that fewer articles quote is part of each
of them.  Of articles that are copies of each other but for a few places, only
those count that differ in their least other block, so a much copied article is
no template.

Counts are partial sums per host and hash, so a host with a third of all pages
is no single group; the join of template hashes back to pages splits its skewed
partitions.

All elements of the highest rank (article, main, a container named so) that are
not inside each other are the article; where they hold less than ``HELD_SHARE``
of the page's text outside links, a lower rank's are, and at last the page.

Defined cases: null or empty html gives an empty text; unclosed, misnested and
unknown tags are taken as browsers do, nearly; a null url is a host of its own;
each row is a page, equal pages count as one for the template; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: A subtree is template from so many differing pages of a host on, if these are so large a share of them.
MIN_PAGES, MIN_SHARE = 10, 0.05
#: So many differing pages are enough on any host.
ENOUGH_PAGES = 100
#: Share of the host's pages for a paragraph, heading or list item inside an article.
LINE_SHARE = 0.5
#: The elements of a rank hold the article if they hold so large a share of the page's text.
HELD_SHARE = 0.25

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = {"aside", "button", "canvas", "dialog", "fieldset", "footer", "form", "head", "iframe", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "blockquote", "figure", "details", "address", "center"}
#: What holds a line of an article.
LINES = BLOCKS - CONTAINERS
CLOSES_P = BLOCKS - {"body", "caption", "dd", "dt", "head", "html", "legend", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: An opening tag ends these open ones, up to the list or table that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_SCOPE = {"table", "td", "th", "button", "object", "template", "html", "body"}
_JUNK_WORDS = "ad|ads|adbox|adslot|advert|adverts|advertisement|advertising|alert|announcement|banner|breadcrumb|breadcrumbs|byline|comment|comments|commentlist|consent|cookie|cookies|copyright|disclaimer|disqus|footer|gdpr|header|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|outbrain|pager|pagination|paywall|popup|promo|promoted|promotion|related|recommended|recommendations|replies|reply|respond|responses|rail|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|taboola|teaser|toolbar|topbar|trending|warning|widget"
_PARTS = "area|bar|block|body|bottom|box|button|buttons|container|content|desktop|first|form|fixed|group|holder|icons|inner|item|items|last|left|link|links|list|main|mobile|nav|outer|panel|posts|primary|right|row|secondary|section|site|slot|sticky|text|title|top|unit|widget|widgets|wrap|wrapper|module|section|modal|banner|overlay|media|card|cards|feed|thread|count|reply|author|meta|toggle|logo|info|message|notice|close"
_JUNK = re.compile(rf"^(?:(?:{_JUNK_WORDS})(?:[-_]?[0-9x]+|[-_](?:{_PARTS})[0-9]*)*|.*[-_](?:{_JUNK_WORDS})[0-9]*)$", re.I)
_JUNK_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_BODY = re.compile(r"^(?:(?:article|post|entry|story|main|page|blog|news)[-_]?(?:body|content|text)|articlebody|content|main|maincontent|story|article|post|entry)$", re.I)
_KEPT_NAMES = {"html", "body", "main", "article"}
#: Names that fit these say what stands beside the text, or what it is about, not that it is none.
_ABOUT = re.compile(r"(?:^|[-_])(?:with|has|no|is|without|tag|category|topic|type|format|status)[-_]", re.I)


class _Node:
    __slots__ = ("tag", "children", "junk", "body", "size", "ranks")

    def __init__(self, tag: str, junk: int = 0, body: int = 0):
        self.tag, self.junk, self.body = tag, junk, body
        self.children: list = []


#: What declares an element to be no article text: its tag or that it is hidden; or a name or a form, which may wrap the page.
HARD, SOFT = 1, 2


def _attributes(tag: str, raw: str, in_article: bool) -> tuple[int, int]:
    """HARD or SOFT if the element is no article text, else 0, and its rank as the article's container (0: none)."""
    rank = {"article": 3, "main": 2}.get(tag, 0)
    names: list[str] = []
    for name, a, b, c in _ATTR.findall(raw) if raw and not raw.isspace() else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names += value.split()
        elif name == "role":
            if value.lower() in _JUNK_ROLES and tag not in _KEPT_NAMES:
                return SOFT, 0
            rank = max(rank, {"main": 2, "article": 3}.get(value.lower(), 0))
        elif name == "itemprop" and value.lower() == "articlebody":
            rank = max(rank, 3)
        elif (name == "hidden" and tag not in _KEPT_NAMES) or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return HARD, 0
    if tag in ("html", "body", "main"):
        return 0, rank
    for name in names:
        if _JUNK.match(name) and not _ABOUT.search(name) and not (in_article and re.search(r"header|byline|legal", name, re.I)):
            return HARD if tag in DROPPED - {"form"} else SOFT, 0
        if tag in ("div", "section") and _BODY.match(name):
            rank = max(rank, 1)
    if tag == "form":
        return SOFT, rank
    return HARD if tag in DROPPED or (tag == "header" and not in_article) else 0, rank


def _rescue(root: _Node) -> None:
    """Settles SOFT elements: one with the page's main element in it stays, and a form also if it holds an article's container or most of the page's text."""
    order, stack = [], [root]
    while stack:
        order.append(stack.pop())
        stack += [c for c in order[-1].children if not isinstance(c, str)]
    for node in reversed(order):
        below = [c for c in node.children if not isinstance(c, str)]
        node.size = sum(len(c) for c in node.children if isinstance(c, str) and not c.isspace()) + sum(c.size for c in below if c.junk != HARD)
        node.ranks = 1 << node.body
        for c in below:
            node.ranks |= c.ranks * (c.junk != HARD)
        if node.junk == SOFT and node.ranks & (0b1110 if node.tag == "form" else 0b100):
            node.junk = 0
    for node in order:
        if node.junk == SOFT and node.tag == "form" and 2 * node.size > root.size:
            node.junk = 0


def parse(page: str) -> _Node:
    """The tree of a page.  Text is str, decoded; what is declared to be no article is below a junk node."""
    root = _Node("#root")
    stack, at, n = [root], 0, len(page)
    article = 0

    def pop_to(depth: int) -> None:
        nonlocal article
        while len(stack) > depth:
            node = stack.pop()
            article -= node.body >= 2

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        found = _TOKEN.match(page, lt)
        if not found:
            text("<")
            at = lt + 1
            continue
        at = found.end()
        cdata, end, tag, raw, end2, tag2, raw2 = found.groups()
        if cdata is not None:
            text(cdata)
            continue
        tag = tag or tag2
        if not tag:
            continue
        tag, end, raw = tag.lower(), end or end2, raw or raw2 or ""
        if end:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if stack[depth].tag in ("article", "body", "table", "td", "th") and tag not in BLOCKS:
                    break
            else:
                if tag in ("p", "br"):
                    stack[-1].children.append(_Node("br"))
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in _SCOPE:
                    break
        if tag in ENDS:
            closes, scope = ENDS[tag]
            least = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in scope:
                    break
                if stack[depth].tag in closes:
                    least = depth
            if least:
                pop_to(least)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS and tag != "a":
            stack[-1].children.append(_Node(tag))
            continue
        junk, rank = _attributes(tag, raw, article > 0)
        node = _Node(tag, junk, rank)
        stack[-1].children.append(node)
        stack.append(node)
        article += rank >= 2
    _rescue(root)
    return root


def _size(node: _Node) -> tuple[int, int]:
    """Characters of text below a node, and those in links."""
    stack, total, linked = [(node, False)], 0, 0
    while stack:
        x, link = stack.pop()
        for child in x.children:
            if isinstance(child, str):
                k = len(child) if not child.isspace() else 0
                total += k
                linked += k * link
            elif not child.junk:
                stack.append((child, link or child.tag == "a"))
    return total, linked


def _articles(root: _Node) -> tuple[list[_Node], bool]:
    """The elements that hold the article, and whether the page names any: all of the highest rank, or above it, that hold enough of the page's text outside links."""
    tops: dict[int, list[_Node]] = {3: [], 2: [], 1: []}
    stack = [(root, 0)]
    while stack:
        node, rank = stack.pop()
        if node.junk:
            continue
        for r in range(rank + 1, node.body + 1):
            tops[r].append(node)
        rank = max(rank, node.body)
        stack += [(c, rank) for c in reversed(node.children) if not isinstance(c, str)]
    total, linked = _size(root)
    for found in tops.values():
        sizes = [_size(node) for node in found]
        if any(size for size, _ in sizes) and sum(size - links for size, links in sizes) >= HELD_SHARE * (total - linked):
            return [node for node, (size, _) in zip(found, sizes, strict=True) if size], True
    return [root], False


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(found: list[tuple[str, list[int]]], lines: set[int]) -> list[tuple[int, int]]:
    """Each of the hashes ``lines`` with the least digest of a block outside its elements (0: there is none)."""
    least = sorted((_digest(text), own) for text, own in found)
    return [(h, next((d for d, own in least if h not in own), 0)) for h in sorted(lines)]


def _above(root: _Node, bases: list[_Node]) -> set[int]:
    """The elements that hold one of some, by identity."""
    wanted, out, stack = {id(b) for b in bases}, set(), [(root, ())]
    while stack:
        node, path = stack.pop()
        if id(node) in wanted:
            while path:
                out.add(path[0])
                path = path[1]
            continue
        stack += [(c, (id(node), path)) for c in node.children if not isinstance(c, str) and not c.junk]
    return out


def blocks(page: str) -> tuple[list[tuple[str, list[int]]], list[int], list[tuple[int, int]], list[list[int]]]:
    """The article's blocks, each with the subtree hashes of the elements it is in; the hashes that can be template; those of lines inside an article, each with what tells its article from others; the subtree hashes of the page's other blocks, which names and markup put outside the article."""
    root = parse(page)
    bases, found = _articles(root)
    above, base_ids = _above(root, bases), {id(b) for b in bases}
    every: set[int] = set()
    lines: set[int] = set()
    held: list[str] = []
    aside: list[str] = []
    # an element's hash is known at its end; blocks refer to open elements by cells
    open_cells: list[list[int]] = []
    cells: list[tuple[str, list[list[int]]]] = []
    beside: list[list[list[int]]] = []

    def flush() -> None:
        words = " ".join("".join(held).split())
        held.clear()
        if words:
            cells.append((words, list(open_cells)))
        if any(not x.isspace() for x in aside):
            beside.append(list(open_cells))
        aside.clear()

    # iterative, as trees may be very deep: next child, digest, cell, inside the article, outside it by a name
    stack: list[list] = [[root, 0, xxhash.xxh3_64(root.tag.encode()), None, id(root) in base_ids, False]]
    while stack:
        frame = stack[-1]
        node, i, digest, cell, inside, named = frame
        if i == len(node.children):
            if node.tag in BLOCKS:
                flush()
            stack.pop()
            if cell is not None:
                open_cells.pop()
                h = digest.intdigest() - (1 << 63)
                cell.append(h)
                (lines if found and inside and not named and node.tag in LINES and id(node) not in base_ids else every).add(h)
            if stack and stack[-1][5] == named:
                stack[-1][2].update(digest.digest())
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            (aside if named or not inside else held).append(child)
            digest.update(" ".join(child.split()).encode("utf-8", "surrogatepass"))
            continue
        if child.tag in VOID:
            if child.tag == "hr":
                flush()
            if child.tag != "wbr":
                (aside if named or not inside else held).append(" ")
            continue
        if child.tag in BLOCKS:
            flush()
        away = named or bool(child.junk)
        if not found and not away and child.tag in CONTAINERS:
            total, linked = _size(child)
            away = bool(total) and linked > 0.7 * total  # a list of links in a page that names no article
        own = [] if child.tag in BLOCKS and id(child) not in above and (len(bases) > 1 or id(child) not in base_ids) else None
        if own is not None:
            open_cells.append(own)
        stack.append([child, 0, xxhash.xxh3_64(child.tag.encode()), own, inside or id(child) in base_ids, away])
    flush()
    out = [(words, [c[0] for c in own]) for words, own in cells]
    return out, sorted(every - lines), _lines(out, lines), [[c[0] for c in own] for own in beside]


PAGES = "page_id long, url string, host string, content long, blocks array<struct<text:string,inside:array<long>>>, hashes array<long>, lines array<struct<h:long,other:long>>, beside array<array<long>>"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(pa.struct([("text", pa.string()), ("inside", pa.list_(pa.int64()))]))), ("hashes", pa.list_(pa.int64())), ("lines", pa.list_(pa.struct([("h", pa.int64()), ("other", pa.int64())]))), ("beside", pa.list_(pa.list_(pa.int64())))])


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            rows = []
            for page_id, url, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html")), strict=True):
                found, hashes, lines, beside = blocks(page or "")
                content = _digest("\n".join(t for t, _ in found))
                rows.append({"page_id": page_id, "url": url, "host": host, "content": content, "blocks": [{"text": t, "inside": own} for t, own in found], "hashes": hashes, "lines": [{"h": h, "other": other} for h, other in lines], "beside": beside})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def main_text(pages: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough_pages: int = ENOUGH_PAGES, line_share: float = LINE_SHARE) -> DataFrame:
    """One row per page row: page_id, url, its main text and length, and the number of blocks kept, of blocks deleted as template (by counts), and of those that names and markup alone put outside the article."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    parsed = scratch.write(rows.mapInArrow(_parse, PAGES).withColumn("row", F.monotonically_increasing_id()), "parsed")
    one = parsed.groupBy("host", "content").agg(F.min("row").alias("row"))
    total = one.groupBy("host").agg(F.count("*").alias("pages"))
    differing = parsed.select("row", "hashes", "lines").join(one.select("row", "host"), "row")
    many = differing.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = many.join(total, "host").where((F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= enough_pages)).select("host", "h")
    apart = differing.select("host", F.explode("lines").alias("x")).select("host", "x.h", "x.other").distinct()
    often = apart.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = template.union(often.join(total, "host").where(F.col("n") >= line_share * F.col("pages")).select("host", "h")).distinct()
    each = parsed.select("row", "host", F.explode(F.concat("hashes", F.col("lines")["h"])).alias("h"))
    own = each.join(template, ["host", "h"]).groupBy("row").agg(F.collect_set("h").alias("gone"))
    own = scratch.write(own, "template")  # its size is known then: small, it is broadcast and the pages stay where they are
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.arrays_overlap(b["inside"], F.col("gone"))))
    out = parsed.select("row", "page_id", "url", "blocks", "beside").join(own, "row", "left").withColumn("kept", kept)
    named = F.when(F.col("gone").isNull(), F.size("beside")).otherwise(F.size(F.filter("beside", lambda b: ~F.arrays_overlap(b, F.col("gone")))))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    return out.withColumn("text", text).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("kept").alias("n_blocks"), (F.size("blocks") - F.size("kept") + F.size("beside") - named).alias("n_template_blocks"), named.alias("n_named_blocks"))
