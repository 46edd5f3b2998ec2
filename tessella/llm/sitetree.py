"""Main text of HTML pages by site style trees.

The pages of a host are merged into one tree whose nodes are element paths (tags with their classes). A node's importance
is its prior times two weighted entropies over the host's distinct pages: of its presentations (the sequences of its child
elements) and of its content (the texts of its blocks). A path that looks and reads the same on every page has an
importance near 0, one whose content differs from page to page near 1. Low branches are removed from each page. Entropies
are sums over counts, so a host of any size is counted by partial aggregation and never gathered.

The prior is what an element is called: 0 in nav, footer, form, advert classes and the like, 1 elsewhere. The tree can't do
without it: navigation whose words differ on every page looks like an article, and a host of one or two pages says
nothing. Nor is the flow of an article or main element ever low, however often a page is repeated with small changes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import bitmap, bound_batches, in_bitmap, written

#: Importance below which a branch is removed; pages a node must be on to be judged; weight of the presentation.
LOW, LEAST_PAGES, PRESENTATION = 0.3, 3, 0.1
#: Low nodes (8 bytes each) up to which their table is broadcast; beyond, it is joined by host.
BROADCAST_NODES = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math canvas object audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source label br".split())
NOISE = frozenset("nav footer aside form menu dialog head button fieldset datalist".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search menu menubar dialog alert alertdialog form toolbar".split())
#: Elements that hold the page or its text: the words of their class and id (has-sidebar, has-comments) don't make them noise.
HOLDERS = frozenset("html body main article".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments respond replies disqus related recommended pagination pager widget widgets skip alert".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SELF_CLOSING = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",))), "tbody": ("thead tbody tr td th", frozenset(("table",)))}

TOKEN = re.compile(r"""<(?:(?P<comment>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|/?[a-zA-Z!?/][^>]*>)""")
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Za-z]+")


@lru_cache(4096)
def _look(tag: str, attrs: str) -> tuple[str, bool]:
    """An element's part of a path, and whether it is noise by what it is called."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)} if attrs.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    own = PARTS.findall(names)
    noise = tag in NOISE or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    noise = noise or tag not in HOLDERS and any(w.lower() in NOISE_WORDS for w in own)
    return tag + "".join(f".{w}" for w in own), noise


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


class Element:
    """node: the hash of host and path, from the parent's and the own part, so that a deep page takes no more than a flat
    one. style: the same of the sequence of its children. plain: no element of the path has a class or id."""

    __slots__ = ("inline", "last", "main", "mute", "node", "noise", "plain", "style", "tag")

    def __init__(self, tag: str, node: int, noise: bool, main: bool, plain: bool, inline: bool = False, mute: bool = False) -> None:
        self.tag, self.node, self.noise, self.main, self.plain, self.inline, self.mute = tag, node, noise, main, plain, inline, mute
        self.style, self.last = 0, ""


class Block:
    """A run of text in one block-level element: its node, text, prior, whether it is an article's, its flow, mostly links."""

    __slots__ = ("flow", "links", "main", "node", "prior", "text")

    def __init__(self, of: Element, text: str, links: bool) -> None:
        self.node, self.text, self.prior, self.main, self.flow, self.links = of.node, text, 0.0 if of.noise else 1.0, of.main, of.main and of.plain, links


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(html: str, host: str = "") -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks of a host's page in order, and (node, presentation) of its block-level elements."""
    root = Element("", _hash(host), False, False, True)
    stack, blocks, styles = [root], [], []
    holders, there = [root], Counter()  # the block-level elements of the stack; how often each tag is in it
    text: list[str] = []
    linked = total = in_link = muted = 0

    def flush(of: Element) -> None:
        nonlocal linked, total
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                blocks.append(Block(of, words, 2 * linked > total))
            text.clear()
        linked = total = 0

    def enter(e: Element) -> None:
        stack.append(e)
        there[e.tag] += 1
        if not e.inline:
            holders.append(e)

    def close(to: int) -> None:
        nonlocal in_link, muted
        while len(stack) > to:
            e = stack[-1]
            there[e.tag] -= 1
            if e.inline:
                in_link -= e.tag == "a"
                muted -= e.mute
            else:
                flush(e)
                styles.append((e.node, e.style))
                holders.pop()
            stack.pop()

    def put(piece: str) -> None:
        nonlocal linked, total
        if muted:
            return
        text.append(piece)
        n = len(piece)
        total += n
        linked += n if in_link else 0

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        if m["comment"]:
            end = html.find("-->", m.end() - 2)
            at = n if end < 0 else end + 3
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if not there[tag]:
                if tag == "p":
                    flush(holders[-1])
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if stack[i].inline:
                        in_link -= tag == "a"
                        muted -= stack[i].mute
                        there[tag] -= 1
                        del stack[i]
                    else:
                        close(i)
                    break
                if stack[i].tag in ("td", "th", "article", "body") and tag not in ("table", "tr", "article", "body", "html", "main", "section", "div", "tbody", "thead"):
                    break
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                put(" ")
            continue
        attrs = m["attrs"]
        if tag in RAW:
            end = _raw_end(tag).search(html, at)
            at = n if end is None else end.end()
            if tag not in INLINE:
                put(" ")
            continue
        if tag in INLINE:
            if tag == "img" or attrs.endswith("/"):
                continue
            parent = stack[-1]
            noise = _look(tag, attrs)[1]
            # An inline advert or notice is left out of its block, and doesn't part it.
            in_link += tag == "a"
            muted += noise
            enter(Element(tag, parent.node, parent.noise, parent.main, parent.plain, True, noise))
            continue
        if muted:
            if tag not in VOID:
                enter(Element(tag, stack[-1].node, stack[-1].noise, stack[-1].main, stack[-1].plain, True))
            continue
        if tag in CLOSES_P and there["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if not stack[i].inline:
                    break
        elif tag in SELF_CLOSING and any(there[x] for x in SELF_CLOSING[tag][0].split()):
            which, barrier = SELF_CLOSING[tag]
            same = which.split()
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    cut = i
                elif stack[i].tag in barrier:
                    break
            if cut:
                close(cut)
        if tag in ("html", "body") and there[tag]:
            continue
        if tag == "body":
            for i in range(1, len(stack)):
                if stack[i].tag == "head":
                    close(i)
                    break
        parent = holders[-1]
        flush(parent)
        if parent.last != tag:
            parent.style, parent.last = _hash(parent.style, tag), tag
        if tag in VOID:
            continue
        part, noise = _look(tag, attrs)
        main = parent.main or tag in ("article", "main") or 'role="main"' in attrs
        noise = noise or tag == "header" and not parent.main
        enter(Element(tag, _hash(parent.node, part), parent.noise or noise, main, parent.plain and "." not in part))
    close(1)
    flush(root)
    return blocks, styles


def host(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; the empty text where there is none."""
    found = F.regexp_extract(F.trim(F.coalesce(url.cast("string"), F.lit(""))), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def counts(pages: DataFrame) -> DataFrame:
    """(node, kind, what, n) over the distinct pages (by host and html) of pages (url, html).

    kind 0: pages that have a block of the node; 1: those pages by the node's presentation; 2: blocks by their text. Nodes
    with a prior of 0 and the flow of articles are left out: no entropy changes what they are.
    """
    bound_batches(pages.sparkSession)
    base = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[tuple[int, int, int, int], int] = {}
            for own, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, styles = parse(html or "", own)
                page = _hash(own, html)
                judged = [b for b in blocks if b.prior and not b.flow]
                nodes = {b.node for b in judged}
                for node, style in styles:
                    if node in nodes:
                        of[page, node, 1, style] = 1
                for key, n in Counter((page, b.node, 2, _hash(b.text)) for b in judged).items():
                    of[key] = n
                for b in judged:
                    of[page, b.node, 0, 0] = 1
            cols = list(zip(*of, strict=True)) if of else [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array(list(of.values()), pa.int64())], ["page", "node", "kind", "what", "n"])

    seen = base.mapInArrow(run, "page long, node long, kind int, what long, n long")
    # A page that occurs again counts once: its rows are equal.
    return seen.distinct().groupBy("node", "kind", "what").agg(F.sum("n").alias("n"))


def importances(pages: DataFrame) -> DataFrame:
    """(node, pages, importance) of the nodes that have blocks to judge."""
    each = counts(pages)
    of = lambda k, e: F.sum(F.when(F.col("kind") == k, e))
    n_log = F.col("n") * F.log(F.col("n").cast("double"))
    nodes = each.groupBy("node").agg(of(0, F.col("n")).alias("pages"), *[x for k, p in ((1, "p"), (2, "c")) for x in (of(k, F.col("n")).alias(p + "n"), of(k, n_log).alias(p + "log"))])
    entropy = lambda p: F.when(F.col(p + "n") > 1, 1 - F.col(p + "log") / (F.col(p + "n") * F.log(F.col(p + "n").cast("double")))).otherwise(1.0)
    importance = PRESENTATION * F.coalesce(entropy("p"), F.lit(0.0)) + (1 - PRESENTATION) * entropy("c")
    return nodes.filter("pages > 0").select("node", "pages", importance.alias("importance"))


def low_nodes(pages: DataFrame, low: float = LOW) -> DataFrame:
    """(node): hashes of the hosts' low-importance paths, of those on LEAST_PAGES distinct pages or more."""
    return importances(pages).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < low)).select("node")


def main_text(own: str, html: str | None, low: Container[int]) -> str:
    """The text that is left of a host's page without low branches, a line for each block.

    Where a page has no article or main element, blocks that are mostly links are no text of it."""
    blocks, _ = parse(html or "", own)
    article = any(b.main and b.prior for b in blocks)
    kept = [b.text for b in blocks if b.prior * (b.flow or b.node not in low) and (b.main or not article and not b.links)]
    return "\n".join(kept)


def _own_nodes(base: DataFrame, low: DataFrame) -> DataFrame:
    """base with nodes, the low nodes that each page has itself: for tables of low nodes that are too long to broadcast."""
    shared = base.sparkSession.sparkContext.broadcast(bitmap(low, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nodes = [], []
            for row, own, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mine = np.fromiter({b.node for b in parse(html or "", own)[0]}, np.int64)
                mine = mine[in_bitmap(shared.value, mine)]
                rows += [row] * len(mine)
                nodes += mine.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(nodes, pa.int64())], ["row", "node"])

    keyed = base.withColumn("row", F.xxhash64("host", "html"))
    pairs = keyed.select("row", "host", "html").mapInArrow(run, "row long, node long").distinct()
    return keyed.join(pairs.join(low, "node").groupBy("row").agg(F.collect_list("node").alias("nodes")), "row", "left")


def extract(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    text is empty where nothing is left; a null html is an empty page; pages without a host (or with a null url) form one
    site. Repeated rows stay, and so do null page_ids; an empty table gives no rows. The table of low nodes is broadcast
    up to broadcast_nodes; of a longer one each page gets the nodes that it has itself. Pages are parsed once for the tree
    and once for their text, which costs less than keeping their blocks.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    low = written(low_nodes(pages), "low")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
    few = low.count() <= broadcast_nodes
    nodes = spark.sparkContext.broadcast(frozenset(r.node for r in low.collect()) if few else frozenset())
    source = base.select("page_id", "url", "html", "host") if few else _own_nodes(base, low).select("page_id", "url", "html", "host", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [nodes.value] * batch.num_rows if few else [frozenset(x or ()) for x in batch.column(4).to_pylist()]
            out = [main_text(h, html, some) for html, h, some in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(np.fromiter(map(len, out), np.int64, len(out)))], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
