"""Operator 3: main text of web pages through a site style tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Weight of a node's content against the presentation around it; pages of all hosts that a host's own are blended with.
GAMMA, SUPPORT = 0.9, 64.0
#: How far what an element says of itself moves its importance towards 0 (menus, adverts ...) or 1 (articles).
NOISE_WEIGHT, ARTICLE_WEIGHT = 0.5, 0.3
#: Bins of importance that the threshold is learnt from; how far the means of both sides must be apart; the threshold where they aren't.
BINS, APART, ELSE = 200, 0.1, 0.5
#: Lists of low-importance nodes up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16_000_000

#: Fixed values of HTML: elements without content, with raw text, and that start and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Fixed values of HTML: what an element that starts ends before it, where its end tag was left out.
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Elements that are seldom main text, and words that end class and id names and say so, those that may begin them, and those that deny it.
NOISE = frozenset("nav aside header footer form button select dialog menu head svg canvas object audio video".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " cookie cookies consent notice notices popup modal overlay comment comments disqus respond share sharing social related newsletter subscribe signup login footer header masthead".split()
)
NOISE_FIRST = frozenset("ad ads advert nav menu breadcrumb sidebar cookie comment comments share social newsletter footer".split())
DENIED = frozenset("no not non without has with hide".split())
#: In an article these are its own.
ARTICLE_OWN = frozenset("header footer".split())
#: What an element says of itself and of all in it.
PLAIN, NOISY, ARTICLE = 0, 1, 2

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r""">|=\s*(["'])""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element that counts in the site's tree: a block, or one with a class, an id or a name that says something.

    `path` is a hash of its style and those around it; `said` what it or an element around it says of itself; `inner`
    the styles of the elements in it, repeats as one; `texts` the numbers of its texts among the page's.
    """

    __slots__ = ("style", "path", "said", "up", "inner", "texts")

    def __init__(self, style: str, up: Node | None, said: int):
        self.style, self.up, self.said = style, up, said
        self.path = xxhash.xxh3_64_intdigest(style if up is None else f"{up.path} {style}") >> 1
        self.inner: list[str] = []
        self.texts: list[int] = []
        if up is not None and (not up.inner or up.inner[-1] != style):
            up.inner.append(style)


def says(name: str, names: list[str], around: int) -> int:
    """What an element says of itself, given what those around it say."""
    if around == NOISY:
        return NOISY
    inside = around == ARTICLE
    if name in NOISE and not (inside and name in ARTICLE_OWN):
        return NOISY
    if name not in ("html", "body", "main", "article", "b", "i", "em", "strong"):
        for n in names:
            words = [w for w in _SPLIT.split(n) if w]
            if words and not DENIED & set(words) and (words[-1] in NOISE_NAMES or words[0] in NOISE_FIRST) and not (inside and words[-1] in ARTICLE_OWN):
                return NOISY
    return ARTICLE if inside or name in ("article", "main") else PLAIN


class Page:
    """The nodes of a page and its texts in order, in time and memory that grow with its length.

    Raw-text elements and comments are left out; a block ends an open paragraph; list items, cells and rows end the
    one before them; end tags of what isn't open are ignored; what is open at the end is closed. Elements that count
    for nothing (b, a, span ...) belong to the node around them.
    """

    def __init__(self, page: str | None):
        root = Node("root", None, PLAIN)
        self.nodes, self.texts = [root], []  # texts: (node, text), or None where a block starts or ends
        self._stack: list[tuple[str, Node]] = []  # open elements, and the node that texts in them belong to
        self._open: dict[str, int] = {}
        self._blocks: list[int] = []  # where blocks are in the stack
        self._read(page or "")

    def _text(self, text: str) -> None:
        node = self._stack[-1][1] if self._stack else self.nodes[0]
        node.texts.append(len(self.texts))
        self.texts.append((node, text))

    def _close(self, depth: int) -> None:
        """Close what is open beyond a depth of the stack."""
        while len(self._stack) > depth:
            name, _ = self._stack.pop()
            self._open[name] -= 1
            if name in BLOCK:
                self._blocks.pop()
                self.texts.append(None)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            ends = ENDS.get(name, ())
            depth = None
            for at in reversed(self._blocks):
                here = self._stack[at][0]
                if here == "p" or here in ends:
                    depth = at
                    if here == name or here == "p" and not ends:
                        break
                elif not (ends and here in ("td", "th")):
                    break
            if depth is not None:
                self._close(depth)
            self.texts.append(None)
        around = self._stack[-1][1] if self._stack else self.nodes[0]
        found = _NAMED.findall(attributes) if attributes else ()
        names = [n for _, a, b, c in found for n in (a or b or c).lower().split()]
        said = says(name, names, around.said)
        node = around
        if name in BLOCK or names or said != around.said:
            words = sorted({w for n in names for w in _SPLIT.split(n) if w and not w.isdigit()})
            node = Node(f"{name}.{'.'.join(words)}" if words else name, around, said)
            self.nodes.append(node)
        if name == "br":
            self._text(" ")
        if name in VOID or attributes.rstrip().endswith("/"):
            if name in BLOCK:
                self.texts.append(None)
            return
        if name in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append((name, node))
        self._open[name] = self._open.get(name, 0) + 1

    def _end(self, name: str) -> None:
        if self._open.get(name):
            depth = len(self._stack) - 1
            while self._stack[depth][0] != name:
                depth -= 1
            self._close(depth)
        elif name == "p":
            self.texts.append(None)

    def _read(self, page: str) -> None:
        at, quoted = 0, True
        lower = ""
        while True:
            i = page.find("<", at)
            if i < 0 or page.find(">", i) < 0 and not page.startswith("<!--", i):
                break
            if i > at:
                self._text(page[at:i])
            at = i
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                at = len(page) if j < 0 else j + 3
                continue
            m = _NAME.match(page, i + 1)
            if not m:
                if page[i + 1 : i + 2] in ("!", "?", "/"):
                    at = page.find(">", i) + 1
                else:
                    self._text("<")
                    at = i + 1
                continue
            name, stop = m[0].lower(), m.end()
            while quoted:  # quotes after an equals sign may hold a >
                s = _STOP.search(page, stop)
                j = page.find(s[1], s.end()) if s and s[1] else -1
                if not s or s[1] and j < 0:
                    quoted = False  # a quote that nothing ends: from here on the next > ends a tag
                elif s[1]:
                    stop = j + 1
                else:
                    stop = s.start()
                    break
            if not quoted:
                stop = page.find(">", m.end())
            attributes, at = page[m.end() : stop], stop + 1
            if name[0] == "/":
                self._end(name[1:])
            elif name in RAW:
                lower = lower or page.lower()
                if len(lower) != len(page):  # some letters have longer lower forms
                    lower = "".join(c.lower() if c.isascii() else c for c in page)
                j = lower.find(f"</{name}", at)
                at = len(page) if j < 0 else page.find(">", j) + 1 or len(page)
            else:
                self._start(name, attributes)
        if at < len(page):
            self._text(page[at:])
        self._close(0)

    def blocks(self, low: frozenset[int] = frozenset()) -> list[str]:
        """The blocks of text, without those of nodes whose paths are low."""
        out: list[str] = []
        open_: list[str] = []
        for t in [*self.texts, None]:
            if t is not None:
                if t[0].path not in low:
                    open_.append(t[1])
            elif open_:
                block = _SPACE.sub(" ", html.unescape("".join(open_))).strip()
                if block:
                    out.append(block)
                open_ = []
        return out

    def observations(self, host: str = "") -> tuple[int, set[tuple[int, int, int, int]]]:
        """What the page adds to its site's tree: its signature, that of its longest text; and (path, said, kind, feature), each once, of the nodes that hold text.

        Kind 0: the node is there. Kind 1, presentation: the styles of the elements in the node around it. Kind 2,
        content: the text that lies in it directly, with the host's name left out, so that sites' frames are alike.
        """
        out, longest = set(), ""
        for n in self.nodes:
            text = _SPACE.sub(" ", "".join(self.texts[i][1] for i in n.texts)).strip() if n.texts else ""
            if text:
                longest = max(longest, text, key=lambda t: (len(t), t))
                text = text.replace(host, "") if host else text
                around = " ".join(n.up.inner) if n.up is not None else ""
                out.add((n.path, n.said, 0, 0))
                out.add((n.path, n.said, 1, xxhash.xxh3_64_intdigest(around.encode("utf-8", "surrogatepass")) >> 1))
                out.add((n.path, n.said, 2, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1))
        return xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass")) >> 1, out


def extract(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The text of a page without the nodes of low importance."""
    return "\n".join(Page(page).blocks(low))


def host_of(url: str | None) -> str:
    """The host of a page's address, empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def threshold(weights: np.ndarray) -> float:
    """Where importance falls into two classes: the split of the bins that leaves least variance in both, in the middle of the empty bins around it."""
    x, w = (np.arange(len(weights)) + 0.5) / len(weights), weights.astype(float)
    below, above = np.cumsum(w)[:-1], np.cumsum(w[::-1])[::-1][1:]
    fits = (below > 0) & (above > 0)
    if not fits.any():
        return ELSE
    mean_below = np.cumsum(w * x)[:-1] / np.maximum(below, 1e-12)
    mean_above = np.cumsum((w * x)[::-1])[::-1][1:] / np.maximum(above, 1e-12)
    between = np.where(fits, below * above * (mean_above - mean_below) ** 2, -1.0)
    best = np.flatnonzero(between >= between.max() * (1 - 1e-9))
    k = int(best[len(best) // 2])
    return float((best[0] + best[-1] + 2) / 2 / len(weights)) if mean_above[k] - mean_below[k] >= APART else ELSE


def importances(pages: DataFrame, names: bool = True) -> DataFrame:
    """(host, path, pages, importance) of each node that holds text, in the trees of all hosts.

    Pages of a host that share their longest text are copies and count once. Of m pages that have a node, a feature
    on n of them has the entropy log n / log m: 1 if all have it, 0 if it is one page's own. Content importance is 1
    less the mean entropy of the node's texts; presentation importance is the entropy of what surrounds it over the
    pages. Both are blended with those of the same path over all hosts as if SUPPORT pages had them, so few pages say
    little and none says nothing. What elements say of themselves (`names`) moves the importance by fixed weights,
    which a tree that is sure can outweigh in articles. Counts are summed before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for url, page in zip(b["url"], b["html"]):
                host = host_of(url)
                signature, found = Page(page).observations(host)
                rows.update((host, *f, signature) for f in found)
            yield pd.DataFrame(list(rows), columns=["host", "path", "said", "kind", "feature", "signature"])

    seen = pages.select("url", "html").mapInPandas(run, "host string, path long, said int, kind int, feature long, signature long").distinct()
    by_host = cut(seen.groupBy("host", "path", "said", "kind", "feature").agg(F.count(F.lit(1)).alias("n")))

    def entropies(counted: DataFrame, *key: str) -> DataFrame:
        n = F.col("n").cast("double")
        logs = counted.groupBy(*key, "path", "said").agg(
            F.sum(F.when(F.col("kind") == 0, n)).alias("pages"), F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias("style_log"),
            F.sum(F.when(F.col("kind") == 2, n)).alias("texts"), F.sum(F.when(F.col("kind") == 2, n * F.log(n))).alias("text_log"),
        )
        alone = F.col("pages") < 2
        presentation = F.when(alone, 1.0).otherwise(1 - F.col("style_log") / F.col("pages") / F.log("pages"))
        content = F.when(alone, 1.0).otherwise(1 - F.col("text_log") / F.col("texts") / F.log("pages"))
        return logs.select(*key, "path", "said", "pages", (GAMMA * content + (1 - GAMMA) * presentation).alias("own"))

    together = entropies(by_host.groupBy("path", "said", "kind", "feature").agg(F.sum("n").alias("n"))).select("path", "said", F.col("own").alias("common"), F.least(F.lit(SUPPORT), F.col("pages") - 1).alias("support"))
    blended = entropies(by_host, "host").join(together, ["path", "said"]).withColumn("weight", F.col("pages") - 1)
    tree = F.when(F.col("weight") + F.col("support") > 0, (F.col("weight") * F.col("own") + F.col("support") * F.col("common")) / (F.col("weight") + F.col("support"))).otherwise(1.0)
    told = F.when(F.col("said") == NOISY, (1 - NOISE_WEIGHT) * tree).when(F.col("said") == ARTICLE, (1 - ARTICLE_WEIGHT) * tree + ARTICLE_WEIGHT).otherwise(tree) if names else tree
    return blended.select("host", "path", "pages", told.alias("importance"))


def style_trees(pages: DataFrame, names: bool = True) -> DataFrame:
    """(host, low): the paths of each host's nodes of low importance. What is low is learnt from the importances of all hosts' nodes, which fall into two classes."""
    found = cut(importances(pages, names))
    bins = found.groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("importance") * BINS)).cast("int").alias("bin")).agg(F.sum("pages").alias("n")).collect()  # BINS rows at most
    weights = np.zeros(BINS)
    for r in bins:
        weights[max(0, r["bin"])] = r["n"]
    return found.where(F.col("importance") < threshold(weights)).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def main_text(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Texts go whose nodes have low importance in the style tree of the page's host, see importances() and
    style_trees(). A null or empty page has the empty text; pages without a readable address form a host of their
    own. Pages without tags are one block. Repeated rows stay; other columns go.
    """
    trees = cut(style_trees(pages, names))
    size = trees.agg(F.coalesce(F.sum(F.size("low") * 8 + 64), F.lit(0)).alias("b")).first()["b"]
    own = trees.select(F.col("host").alias("h"), "low")

    @F.pandas_udf("string")
    def hosts(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    @F.pandas_udf("string")
    def text(htmls: pd.Series, lows: pd.Series) -> pd.Series:
        kept: dict[bytes, frozenset[int]] = {}
        out = []
        for page, low in zip(htmls, lows):
            key = b"" if low is None else np.asarray(low, dtype=np.int64).tobytes()
            if key not in kept:
                kept[key] = frozenset(np.frombuffer(key, dtype=np.int64).tolist())
            out.append(extract(page, kept[key]))
        return pd.Series(out, index=htmls.index, dtype="str")

    named = pages.select("page_id", "url", "html", hosts("url").alias("h"))
    joined = named.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "h", "left")
    return joined.select("page_id", "url", text("html", "low").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
