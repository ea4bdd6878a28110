"""Main text of web pages by consensus paths of each host.

Every page's containers (sections of the layout: div, section, article, main, body and the like; paragraphs, lists and
tables belong to the container around them) are scored by the text they hold themselves, links counting against them,
names that suggest furniture weighing less and articles more. A page casts one vote, shared among the generalised
paths of its containers (tags, classes and ids, with numbers and identifiers generalised) by score. Spark adds up the
votes of each host's distinct pages and keeps, for every path on ``SEEN`` pages or more, whether it won (``WINS`` or
more of the best path's votes) or lost, and whether its text repeats from page to page while the winner's doesn't.

Then every page is extracted again by its host's paths. Kept are the text under a winning container, and what stands
loose around it in the containers that enclose it (titles, intros), but lists of links. A losing container beside the
winners goes, and so does one inside them that repeats, or whose name suggests furniture: the host decides, as a name
alone excludes nothing that won. An ``article`` around a winner is kept whole in this sense. On paths that the host
has seen on fewer than ``SEEN`` pages the page itself decides in the same way, by its own scores; that holds also for
a page that holds none of the winning paths, and for pages without a host.

Elements whose role is furniture (nav, aside, footer, form, a header outside articles, ARIA roles, hidden parts),
scripts and styles never count as text. White space in a block becomes one space, blocks are joined by a line end, and
nothing else is dropped or cut. Unclosed tags, stray ends, unclosed quotes and cut-off pages are read leniently.

Null html and pages without text give an empty text; an empty table gives no rows. Pages with equal html vote once a
host. Repeated rows get a row each; extra columns are ignored, whatever their names. Paths with equal votes win or
lose together. Very long pages are read in one pass and kept whole; no number of paths or blocks is capped, the
lists of a host are bounded as each of their paths stands for a share of its pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join

#: Share of the best path's votes a winner needs.
WINS = 0.25
#: Distinct pages of a host, and share of them, a path must be on for the host to judge it.
SEEN, SEEN_SHARE = 3, 0.02
#: Share of links above which what stands loose around the winning containers is a menu.
MENU_SHARE = 2 / 3
#: Weight of text in containers whose names suggest furniture, and of text in articles.
NAMED, ARTICLE = 0.1, 3.0
#: Characters of a path that are written out.
LONG_PATH = 400
#: Bytes of all hosts' lists up to which they are broadcast.
BROADCAST_BYTES = 32_000_000

_TOKEN = re.compile(r"<(?:!--(?:.*?--!?>|.*)|!\[CDATA\[|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
# Names of HTML elements by their role in the layout.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math noframes xmp object select".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_LEFT_OUT = frozenset("head nav footer aside form button input label menu dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Parts of class and id names that mark a page's furniture.
_FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond reply related recommended recommendations widget pagination pager search skip".split())
_CONTENT = frozenset("article content entry post story main body text".split())
_STRONG = frozenset("ad ads comment comments sidebar related nav menu footer cookie".split())
# Blocks that belong to the container around them.
_TEXTUAL = frozenset("p li pre blockquote h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot table caption dd dt dl ul ol dir address figure figcaption hgroup header hr legend summary details option".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_IDENTIFIER = re.compile(r"(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![0-9a-z])|[0-9]+")


def _generalised(name: str) -> str:
    """A class or id without what differs from page to page: numbers and hexadecimal identifiers."""
    return _IDENTIFIER.sub("#", name.lower())


def _suggests_furniture(name: str) -> bool:
    parts = {p.lower() for p in _PARTS.findall(name)}
    return bool(parts & _FURNITURE) and not (parts & _CONTENT and not parts & _STRONG)


def _below(path: str, part: str) -> str:
    """The path of a container in that of ``path``. Long ones start with a hash of what is above, so that a deep page's paths
    take no more room than its elements."""
    return f"{path if len(path) <= LONG_PATH else f'{xxhash.xxh64_intdigest(path):016x}'}>{part}"


@dataclass
class _Open:
    tag: str
    out: bool  # left out
    node: int


class Page:
    """A page as blocks ``(text, link characters, node)`` over a tree of block elements, a parent's number below its children's."""

    def __init__(self, html: str):
        self.tags, self.parents, self.paths, self.named = [""], [0], [""], [False]
        #: The container a node's text belongs to.
        self.holders = [0]
        self.in_article = [False]
        self.blocks: list[tuple[str, int, int]] = []
        self._stack = [_Open("", False, 0)]
        #: The places of each tag's open elements, so that none is searched for.
        self._places: defaultdict[str, list[int]] = defaultdict(list)
        self._text: list[str] = []
        self._linked, self._in_link = 0, 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            raw = "".join(self._text)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((text, self._linked, self._stack[-1].node))
            self._text = []
        self._linked = 0

    def _close(self, to: int) -> None:
        """Close all open elements from place ``to`` on."""
        if any(o.tag in _BLOCK for o in self._stack[to:]):
            self._flush()
        self._in_link = 0 if any(o.tag == "a" for o in self._stack[to:]) else self._in_link
        for o in self._stack[to:]:
            self._places[o.tag].pop()
        del self._stack[to:]

    def _last(self, tags: Iterable[str]) -> int:
        return max((at[-1] for t in tags if (at := self._places.get(t))), default=0)

    def _find(self, tags: Iterable[str], stop: Iterable[str]) -> int:
        """The place of the innermost open element of ``tags``, 0 if there is none within the innermost of ``stop``."""
        at = self._last(tags)
        return at if at >= self._last(stop) else 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P and (at := self._find({"p"}, {"td", "th", "table", "button"})):
            self._close(at)
        if tag in _SIBLINGS and (at := self._find(*_SIBLINGS[tag])):
            self._close(at)
        block = tag in _BLOCK
        if block:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        if tag in _VOID:
            return
        top, names, out, named = self._stack[-1], [], tag in _LEFT_OUT, False
        if attributes and (block or "hidden" in attributes or "style" in attributes or "role" in attributes):
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    named = named or _suggests_furniture(value)
                    names += [("." if name == "class" else "#") + _generalised(c) for c in value.split()]
                elif name == "role":
                    out = out or value.lower() in _ROLES
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    out = True
                elif name == "style":
                    out = out or "display:none" in value.replace(" ", "").lower()
        if tag == "header":  # a site's header, not the head of an article
            out = out or not self._last(("article", "main"))
        node = top.node
        if block:
            node = len(self.tags)
            # a name on a list or a paragraph makes it a container of its own
            holds = tag not in _TEXTUAL or named
            self.tags.append(tag)
            self.parents.append(top.node)
            self.named.append(named and tag not in ("html", "body", "article", "main"))
            self.holders.append(node if holds else self.holders[top.node])
            self.paths.append(_below(self.paths[top.node], tag + "".join(sorted(set(names)))) if holds else self.paths[top.node])
            self.in_article.append(tag == "article" or self.in_article[top.node])
        self._in_link += tag == "a"
        self._places[tag].append(len(self._stack))
        self._stack.append(_Open(tag, out or top.out, node))

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            end = m.start() if m else size
            if end > at and not self._stack[-1].out:
                self._text.append(html[at:end])
                self._linked += (end - at) * bool(self._in_link)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in _BLOCK and tag not in ("body", "html"):
                    self._flush()
                if (found := self._find({tag}, {"table"} if tag not in _BLOCK and tag != "a" else set())) and tag not in ("body", "html"):
                    self._close(found)
            elif tag in _RAW:
                done = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at) if not m[3].endswith("/") or tag not in ("svg", "math") else m
                at = max(at, done.end()) if done else size
            else:
                self._start(tag, m[3])
        self._flush()

    def shares(self) -> dict[str, float]:
        """Path -> its containers' share of the page's vote."""
        total: Counter = Counter()
        furniture = [False] * len(self.tags)
        for node in range(1, len(self.tags)):
            furniture[node] = self.named[node] or furniture[self.parents[node]]
        for text, linked, node in self.blocks:
            weight = (NAMED if furniture[node] else ARTICLE if self.in_article[node] else 1.0) * max(0, len(text) - 2 * linked)
            if weight:
                total[self.paths[node]] += weight
        everything = sum(total.values())
        return {p: v / everything for p, v in total.items()}

    def texts(self) -> dict[str, int]:
        """Path -> a hash of the text its containers hold."""
        out: dict[str, list[str]] = defaultdict(list)
        for text, _, node in self.blocks:
            out[self.paths[node]].append(text)
        return {p: xxhash.xxh64_intdigest("\n".join(t)) - (1 << 63) for p, t in out.items()}

    def text(self, won: Set[str] = frozenset(), lost: Set[str] = frozenset(), repeated: Set[str] = frozenset()) -> str:
        """The main text by a host's ``won``, ``lost`` and ``repeated`` paths; the page judges those in none of them."""
        shares = self.shares()
        held = {self.paths[node] for _, _, node in self.blocks}
        best = max(shares.values(), default=0.0)
        unknown = {p for p, v in shares.items() if v >= WINS * best and p not in won and p not in lost and p not in repeated}
        winners = (won & held) | unknown or {p for p, v in shares.items() if v >= WINS * best}
        n = len(self.tags)
        sure, around, gone = [False] * n, [False] * n, [False] * n
        for node in range(1, n):
            parent, path, own = self.parents[node], self.paths[node], self.holders[node] == node
            sure[node] = sure[parent] or own and path in winners
            gone[node] = gone[parent] or own and sure[parent] and path not in winners and (self.named[node] or path in repeated)
        size, linked, holds = [0] * n, [0] * n, [False] * n
        for text, links, node in self.blocks:
            size[node] += len(text)
            linked[node] += links
            holds[node] = holds[node] or sure[node] and not gone[node]
        for node in range(n - 1, 0, -1):
            parent = self.parents[node]
            size[parent] += size[node]
            linked[parent] += linked[node]
            holds[parent] = holds[parent] or holds[node]
        for node in range(1, n):
            parent = self.parents[node]
            around[node] = holds[node]
            # an article around a winner is kept whole
            if not sure[node] and (self.tags[node] == "article" and holds[node] or sure[parent]):
                sure[node] = True
            if sure[node] and not sure[parent]:
                continue
            own = self.holders[node] == node
            gone[node] = gone[node] or gone[parent] or own and not holds[node] and self.paths[node] not in winners and (self.named[node] or self.paths[node] in repeated)
        around[0] = True
        # whether a node or a list around it, within its container, is mostly links
        menu = [False] * n
        for node in range(1, n):
            menu[node] = self.holders[node] != node and (menu[self.parents[node]] or linked[node] > MENU_SHARE * size[node])
        kept = []
        for text, links, node in self.blocks:
            if sure[node]:
                keep = not gone[node]
            else:
                keep = around[self.holders[node]] and not gone[node] and not menu[node] and links <= MENU_SHARE * len(text)
            if keep:
                kept.append(text)
        return "\n".join(kept)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, page, path, share, text = [], [], [], [], []
        for h, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if h and (source := html.as_py()):
                read, name = Page(source), xxhash.xxh64_intdigest(source) - (1 << 63)
                texts = read.texts()
                shares = read.shares()
                for p, t in texts.items():
                    host.append(h)
                    page.append(name)
                    path.append(p)
                    share.append(shares.get(p, 0.0))
                    text.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(path, pa.string()), pa.array(share, pa.float64()), pa.array(text, pa.int64())], ["host", "page", "path", "share", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, won, lost, repeated``: what each host's distinct pages say of the paths seen often enough. ``pages``: host, html.

    Copies of a page are merged before they vote. A host's pages are never gathered: sums by path are partial before
    their shuffle, and only paths on ``SEEN_SHARE`` of the pages are listed, at most a page's average number of paths
    divided by that share.
    """
    votes = pages.select("host", "html").mapInArrow(_voted, "host string, page long, path string, share double, text long")
    once = votes.groupBy("host", "page", "path").agg(F.max("share").alias("share"), F.min("text").alias("text"))
    by_text = once.groupBy("host", "path", "text").agg(F.sum("share").alias("share"), F.count("*").alias("n"))
    by_path = materialize(by_text.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"), F.sum("n").alias("n"), F.count("*").alias("texts")))
    # the votes of a host add up to its pages
    best = by_path.groupBy("host").agg(F.max("votes").alias("best"), F.sum("votes").alias("pages"), F.max(F.struct("votes", (F.col("texts") / F.col("n")).alias("fresh"))).alias("top"))
    judged = by_path.where(F.col("n") >= SEEN).join(best.select("host", "best", "pages", F.col("top.fresh").alias("fresh")), "host").where(F.col("n") >= SEEN_SHARE * F.col("pages"))
    win = F.col("votes") >= WINS * F.col("best")
    again = ~win & (2 * F.col("texts") < F.col("n") * F.col("fresh"))
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("path"))))
    return judged.groupBy("host").agg(listed(win).alias("won"), listed(~win).alias("lost"), listed(again).alias("repeated"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
        texts = [Page(h.as_py() or "").text(*(frozenset(x or ()) for x in of)) for h, of in zip(b.column(2), lists, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``, one row for each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    paths = materialize(host_paths(rows))
    # the lists' length depends on the pages' layouts, so bytes are counted, not hosts
    width = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p) + 16)
    size = paths.agg(F.sum(F.octet_length("host") + 64 + width("won") + width("lost") + width("repeated"))).first()[0] or 0
    joined = sized_join(rows, paths, "host", "left", limit=BROADCAST_BYTES, rows=size)
    return joined.select("page_id", "url", "html", "won", "lost", "repeated").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
