"""Main text of web pages by consensus paths of their hosts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import text_of, written

# HTML element names by their role, and words of class, id and role attributes.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form head menu dialog label datalist".split())
CONTAINERS = frozenset("html body div section article main td tr table tbody center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption header footer nav aside form address hr fieldset details summary caption thead tfoot th menu dialog hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup sidebar sidenav side rail widget widgets menu nav navbar navigation topnav breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments commentlist disqus discussion replies reply respond "
    "share sharing social related recommended recommendations login search searchbox pagination pager skip toc hidden complementary contentinfo".split()
)
#: Words that say nothing beside a boilerplate one, as in site-footer or widget-area.
PLAIN = frozenset("site page wrapper wrap area box container list block section bar inner outer global primary secondary left right top bottom".split())
ARTICLE = frozenset("article articlebody main".split())

# nothing is tried twice: a quote that doesn't end soon doesn't count as one
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+'){0,256}+|[^>]*+)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?<![\w=-])hidden(?![\w-])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Node:
    tag: str
    up: int
    path: bytes  # a digest of the steps to it
    dropped: bool
    main: bool
    named: bool = False  # boilerplate by its names alone
    good: int = 0


@dataclass
class Page:
    """Containers of a page, and its blocks (container, text, whether it is in a link for the most part)."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, bool]] = field(default_factory=list)


def _boilerplate(token: str) -> bool:
    """Whether one class, id or role is a boilerplate word, or made of such and plain ones."""
    parts = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))]
    if "".join(parts) in BOILERPLATE:
        return True
    return bool(parts) and parts[0] != "has" and all(w in BOILERPLATE or w in PLAIN for w in parts) and any(w in BOILERPLATE for w in parts)


def _described(tag: str, attributes: str) -> tuple[str, frozenset, bool, bool]:
    """The generalised step of a path (tag and classes, digits as 0), the words of its names, whether one of them is
    boilerplate as a whole, and whether it is hidden. A heading's id is a place to link to."""
    words, classes, boilerplate = set(), "", False
    if attributes:
        for m in _NAMES.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
            words.update(w.lower() for w in _WORD.findall(spaced))
            words.add(re.sub(r"[^a-z]", "", value.lower()))
            if not (tag in HEADINGS and m[1].lower() == "id"):
                boilerplate = boilerplate or any(_boilerplate(t) for t in value.split())
            if m[1].lower() == "class":
                classes = ".".join(sorted(re.sub(r"\d+", "0", value).split()))
    hidden = bool(attributes and (_UNSEEN.search(attributes) or _HIDDEN.search(_QUOTED.sub("", attributes))))
    return f"{tag}.{classes}" if classes else tag, frozenset(words), boilerplate, hidden


def parsed(html: str, share: float = 0.8) -> Page:
    """An element with boilerplate names alone is dropped unless it has `share` of the page's unlinked text."""
    page = Page([Node("", -1, b"", False, False)])
    stack: list[tuple[str, int]] = [("", 0)]  # open elements with their container
    text: list[str] = []
    linked = total = links = 0
    skip_until = -1
    endless: set[str] = set()  # raw elements that have no end from here on

    def close_block() -> None:
        nonlocal linked, total
        if text:
            block = " ".join(unescape("".join(text)).split())
            node = stack[-1][1]
            if block and not page.nodes[node].dropped:  # what is dropped by name is settled below
                page.blocks.append((node, block, 2 * linked > total))
            text.clear()
            linked = total = 0

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() < skip_until:
            continue
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            total += len(piece)
            linked += len(piece) if links else 0
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                close_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
                if tag not in BLOCKS and stack[k][0] in CONTAINERS:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if tag not in endless else None
                if end is None:
                    endless.add(tag)
                at = skip_until = end.end() if end else (len(html) if tag in ("script", "style") else at)
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            close_block()
            if tag == "p" or tag in BLOCKS:  # an open paragraph ends where a block begins, a list item where the next does
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or (tag == stack[k][0] and tag in ("li", "dt", "dd", "td", "th", "tr")):
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag == "a":
            links += 1
        up = stack[-1][1]
        if tag in BLOCKS:
            step, words, boilerplate, hidden = _described(tag, m[3])
            parent = page.nodes[up]
            whole = tag in ("html", "body")
            # a header inside the article has the article's title
            header = (tag == "header" or "header" in words) and not parent.main and tag not in HEADINGS
            dropped = parent.dropped or tag in DROPPED or (not whole and (hidden or header))
            named = boilerplate and not dropped and not whole and tag not in ("article", "main")
            if tag in CONTAINERS or dropped != parent.dropped or named:
                main = parent.main or tag in ("article", "main") or bool(words & {"articlebody", "main", "article"})
                page.nodes.append(Node(tag, up, blake2b(parent.path + step.encode(), digest_size=12).digest(), dropped, main, named))
                up = len(page.nodes) - 1
        stack.append((tag, up))
    if at < len(html):
        tail = html[at:]
        text.append(tail[: tail.index("<")] if "<" in tail and re.match(r"<[a-zA-Z/!]", tail[tail.index("<") :]) else tail)
    close_block()
    _count(page)
    if any(n.named for n in page.nodes):
        whole = page.nodes[0].good
        for n in page.nodes:
            n.dropped = n.dropped or (n.up >= 0 and page.nodes[n.up].dropped) or (n.named and n.good < share * whole)
        page.blocks = [b for b in page.blocks if not page.nodes[b[0]].dropped]
        _count(page)
    return page


def _count(page: Page) -> None:
    """The characters of unlinked blocks in each container."""
    for n in page.nodes:
        n.good = 0
    for node, block, link in page.blocks:
        if not link:
            while node >= 0:
                page.nodes[node].good += len(block)
                node = page.nodes[node].up


def best(page: Page, share: float = 0.8) -> int:
    """The container that scores best: the smallest one with `share` of the page's text outside links and boilerplate."""
    whole, at = page.nodes[0].good, 0
    for i, n in enumerate(page.nodes):  # children come after their parents
        if not n.dropped and n.good >= share * whole and n.up == at:
            at = i
    return at


def text_in(page: Page, *containers: int) -> str:
    """The containers' blocks in page order."""
    inside = [False] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        inside[i] = i in containers or (n.up >= 0 and inside[n.up])
    return "\n".join(block for node, block, _ in page.blocks if inside[node])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, scores = [], []
        for html in batch.column(1).to_pylist():
            page = parsed(html)
            i = best(page)
            paths.append(page.nodes[i].path)
            scores.append(page.nodes[i].good)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), pa.array(scores, pa.int64())], ["host", "path", "score"])


def _extracts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = parsed(html)
            same = [i for i, n in enumerate(page.nodes) if path and n.path == path and not n.dropped and n.good]
            texts.append(text_in(page, *(same or [best(page)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:\w+:)?//([^/?#]*)", 1))


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_share: float = 0.5, broadcast_hosts: int = 200_000, salts: int = 64
) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Each page votes for the generalised tag-class path of its best container; votes are counted by host with map-side
    partials. The path with most votes, if it has least_share of its host's, is the host's: its pages are extracted again
    by it where they have it (all containers of that path, in page order), and otherwise by their own best container. The
    winning paths have a row of some 100 bytes for each host. Up to broadcast_hosts of them are sent to all tasks, so
    that pages stay where they are; more are joined by host and one of `salts` parts, so that no host is in one task.

    Defined results: null html counts as empty, with text ''; a null url or one without a host belongs to the host '';
    of paths with equal votes the one with more text wins; repeated rows have a result each; no rows give no rows; other
    columns are not read; pages of any length are read whole, in time that grows with their length.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    votes = src.select("host", "html").mapInArrow(_votes, "host string, path binary, score long").where("score > 0")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    won = counted.groupBy("host").agg(F.max_by(F.struct("path", "n"), F.struct("n", "score", "path")).alias("top"), F.sum("n").alias("n_host"))
    won = written(won.where(F.col("top.n") >= least_share * F.col("n_host")).select("host", F.col("top.path").alias("path")))
    if won.count() <= broadcast_hosts:
        joined = src.join(F.broadcast(won), "host", "left")
    else:
        parts = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(parts, ["host", "salt"], "left")
    again = joined.select("page_id", "url", "html", "path").mapInArrow(_extracts, "page_id long, url string, text string")
    return again.withColumn("n_chars", F.length("text").cast("long"))
