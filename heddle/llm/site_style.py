"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A node stands for the elements with the same path of block
elements (tag, class and id, digits left out) and knows in how many pages it occurs, which sequences of children its
elements have, and which contents. Two importances follow, both between 0 and 1:

* *presentation*: the entropy of the children sequences over the pages, to base the number of pages; a node that
  always looks alike, as a menu does, is near 0;
* *content*, of nodes with text: one less the mean entropy of each text over the pages that show it; text
  repeated on all pages counts 0, text of one page 1.

A branch's importance composes its own and its children's, these by the pages that show them, weighted by ``gamma`` to the
number of sequences. A branch in which no node reaches ``least`` is removed from every page of the host, and so is a text that by itself
is below it among the pages with its node, inside of articles as well as outside. On a page that would lose over half
of its text to that, which is a copy of other pages rather than a frame around a story, nothing is removed. With one page a node's importance is 1.

Names are a prior: elements that are by tag or role a menu, header, footer, sidebar, advert, form, script or style never
count, but for an article's own header; class and id names of that kind, or of notices and reader comments, count for blocks, but not for what encloses the
page's article, not for words inside a paragraph, and not if nothing else were left. A name that only begins like one of that kind
(``social-policy``) counts only where at least as much text is left without it. If a page has an article or main
element, what is outside of it is left out, unless it is over three times as long.

What a host's tree holds grows with its different paths, not with its pages: texts and sequences are counted by
Spark before a host's tree is put together, in one task a host.

Defined results: a null or empty page, or one without a body text, gives an empty string; a page without a host
is merged with others of that kind; pages cut off in the middle of a tag or element are read up to there; a page of any length
is read whole; repeated rows count as pages of the host; an empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import durable, small_or_shuffled

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>|<(?=/?[a-zA-Z])[^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names by kind (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("head nav header footer aside form script style noscript template button select option textarea iframe object svg canvas dialog menu search title fieldset label input datalist audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id names that tell menus, notices, adverts and the like (fixed values).
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer footnav form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination paywall popup promo promos promotion recommended related reply replies respond share sharing sidebar sidebars signup skip skyscraper social sponsor "
    "sponsored sponsors subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Elements whose inline elements are words of a text (fixed values).
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote figcaption pre".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: How much a name tells that an element is noise.
WEAK, STRONG = 1, 2


@dataclass(frozen=True)
class Style:
    gamma: float = 0.9
    least: float = 0.2
    broadcast_bytes: int = 8_000_000


@lru_cache(maxsize=20_000)
def _kind(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """An element's name in paths, whether it is noise by tag or role, how much so by its names, and whether it is main content."""
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    names = f"{got.get('class', '')} {got.get('id', '')}".strip()
    role = got.get("role", "").lower()
    label = tag + ("." + re.sub(r"\d+", "", " ".join(sorted(names.split()))) if names else "")
    parts = {x.lower() for x in NAME_PART.findall(names)}
    noise = tag in NOISE_TAGS or role in NOISE_ROLES
    # A name tells by its last part, or by all: a site-header is a header, a header-story a story.
    tokens = [[x.lower() for x in NAME_PART.findall(t)] for t in names.split()]
    named: int = STRONG if any(t and t[-1] in NOISE_NAMES for t in tokens) else WEAK if not NOISE_NAMES.isdisjoint(parts) else 0
    if tag in ("body", "html", "article", "main"):
        # A page may carry its layout's name ("has-sidebar"); comments are often articles.
        noise, named = role in NOISE_ROLES, STRONG if tag == "article" and not parts.isdisjoint(("comment", "comments", "reply", "replies")) else 0
    return label, noise, named, (tag in ("article", "main") or role in ("main", "article")) and not noise and not named


@dataclass
class Page:
    """``blocks``: path, text, whether noise by tag, how much by name, whether in an article. ``nodes``: path and its children's labels."""

    blocks: list[tuple[str, str, bool, int, bool]]
    nodes: list[tuple[str, tuple[str, ...]]]
    has_main: bool


def read(page: str | None) -> Page:
    """The blocks and nodes of a page, in page order."""
    blocks: list[tuple[str, str, bool, int, bool]] = []
    nodes: list[tuple[str, tuple[str, ...]]] = []
    has_main = False
    # Open elements: tag, path, noise by tag, by name, main, children.
    stack: list[tuple[str, str, bool, int, bool, list[str]]] = [("", "", False, 0, False, [])]
    text: list[str] = []
    page = page or ""

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            words = (references.unescape(joined) if "&" in joined else joined).split()
            if words:
                top = stack[-1]
                blocks.append((top[1], " ".join(words), top[2], top[3], top[4]))

    def close(down_to: int) -> None:
        flush()
        while len(stack) > down_to:
            tag, path, _, _, _, children = stack.pop()
            nodes.append((path, tuple(children)))

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in NOISE_TAGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    if tag in BLOCKS:
                        flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCKS and tag not in NOISE_TAGS:
            if tag in VOID:
                continue
            if "=" not in m[3] or tag in RAW:
                if tag in RAW:
                    at = _after_raw(page, at, tag)
                continue
            # An inline element with a telling name counts as a block of its own, unless it is among the words of a paragraph.
            if not any(_kind(tag, m[3])[1:3]) or any(x[0] in RUNNING for x in stack):
                continue
        flush()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "table", "button", "caption", "object"):
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
            if stack[i][0] in SIBLINGS[tag]:
                close(i)
            elif stack[i][0] in SCOPES[tag]:
                break
        label, noise, named, main = _kind(tag, m[3])
        above = stack[-1]
        above[5].append(label)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        has_main = has_main or main and not above[2]
        if tag in RAW:
            at = _after_raw(page, at, tag)
            continue
        path = f"{above[1]}/{label}"
        if tag == "body" and len(stack) > 1:
            # An unclosed head ends where the body begins.
            for i in range(1, len(stack)):
                if stack[i][0] == "head":
                    close(i)
                    break
            path = f"{stack[-1][1]}/{label}"
            above = stack[-1]
        main = main and not above[2]
        if tag == "header" and above[4]:
            # The header of an article is its headline and lead.
            noise = False
        stack.append((tag, path, above[2] or noise, 0 if main else max(above[3], named), (above[4] or main) and not noise and named < STRONG, []))
        if tag not in BLOCKS and tag not in NOISE_TAGS:
            # Inline noise ends with its own closing tag.
            close(len(stack) - 1)
            at = _after_inline(page, at, tag)
    close(1)
    return Page(blocks, nodes, has_main)


def _after_inline(page: str, at: int, tag: str) -> int:
    """Behind the closing tag of an element that begins before ``at``; ``at`` itself if it is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def _after_raw(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _hash(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, dtype=object), categorize=False).view(np.int64) if values else np.empty(0, np.int64)


COUNTS = "host string, path string, parent string, kind string, feature long, n long"


def _tree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page, each node once a kind: ``page`` (it occurs), ``shape`` (of its children), ``text`` (each, with count)."""
    for whole in batches:
        for at in range(0, len(whole), 500):
            pdf = whole.iloc[at : at + 500]
            rows: list[tuple[str, str, str, str, str]] = []
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                got = read(page)
                paths = set()
                shapes: dict[str, list[str]] = {}
                for path, children in got.nodes:
                    paths.add(path)
                    shapes.setdefault(path, []).append("\x01".join(children))
                for path in paths:
                    up = path.rpartition("/")[0]
                    rows.append((host, path, up, "page", ""))
                    rows.append((host, path, up, "shape", "\x02".join(shapes[path])))
                for path, text in {(b[0], b[1]) for b in got.blocks}:
                    rows.append((host, path, path.rpartition("/")[0], "text", text))
            if rows:
                out = pd.DataFrame(rows, columns=["host", "path", "parent", "kind", "feature"])
                out["feature"] = _hash(out["feature"].tolist())
                yield out.groupby(["host", "path", "parent", "kind", "feature"], as_index=False).size().rename(columns={"size": "n"})


def importances(tree: pd.DataFrame, how: Style = Style()) -> pd.DataFrame:
    """Paths of one host with their importance, and the highest of the branch. ``tree``: ``path, parent, pages, shapes, shape_entropy, texts,
    text_entropy``, where the entropies are in nats and that of texts is summed over the different texts."""
    own, below = {}, {}
    rows = tree.set_index("path")
    for path, r in rows.iterrows():
        base = math.log(r["pages"]) if r["pages"] > 1 else 0.0
        shape = min(1.0, r["shape_entropy"] / base) if base else 1.0
        content = 1.0 - min(1.0, r["text_entropy"] / base / r["texts"]) if base and r["texts"] else 1.0
        own[path] = (shape, content if r["texts"] else None)
        below.setdefault(r["parent"], []).append(path)
    out: dict[str, float] = {}
    best: dict[str, float] = {}
    for path in sorted(rows.index, key=lambda p: -p.count("/")):
        shape, content = own[path]
        weight = how.gamma ** max(1.0, rows.at[path, "shapes"])
        inner = [(out[c], rows.at[c, "pages"]) for c in below.get(path, ()) if c in out]
        if content is not None:
            inner.append((content, rows.at[path, "pages"]))
        out[path] = (1 - weight) * shape + weight * sum(x * n for x, n in inner) / sum(n for _, n in inner) if inner else shape
        best[path] = max(out[path] if below.get(path) or content is None else content, *(best[c] for c in below.get(path, ()) if c in best), 0.0)
    return pd.DataFrame({"path": list(out), "importance": list(out.values()), "highest": list(best.values())})


def counts(pages: DataFrame) -> DataFrame:
    """How often each node, sequence of children and text occurs, by host, from the columns ``host`` and ``html``."""
    return pages.mapInPandas(_tree_rows, COUNTS).groupBy("host", "path", "parent", "kind", "feature").agg(F.sum("n").alias("n"))


def style_tree(counted: DataFrame, how: Style = Style()) -> DataFrame:
    """``host, path, importance, highest`` of every node of every host."""
    n = F.col("n").cast("double")
    # For texts each page that shows one counts once: the entropy over those pages is the logarithm of their number.
    sums = counted.groupBy("host", "path", "parent").agg(
        F.sum(F.when(F.col("kind") == "page", F.col("n"))).alias("pages"),
        F.count(F.when(F.col("kind") == "shape", 1)).alias("shapes"),
        F.sum(F.when(F.col("kind") == "shape", n * F.log(n))).alias("shape_sum"),
        F.count(F.when(F.col("kind") == "text", 1)).alias("texts"),
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.log(n))), F.lit(0.0)).alias("text_entropy"),
    )
    nodes = sums.filter(F.col("pages").isNotNull()).withColumn("shape_entropy", F.log("pages") - F.col("shape_sum") / F.col("pages"))

    def one_host(pdf: pd.DataFrame) -> pd.DataFrame:
        got = importances(pdf, how)
        return pd.DataFrame({"host": pdf["host"].iloc[0], "path": got["path"], "importance": got["importance"], "highest": got["highest"]})

    return nodes.groupBy("host").applyInPandas(one_host, "host string, path string, importance double, highest double")


def repeated(counted: DataFrame, how: Style = Style()) -> DataFrame:
    """``host, path`` of the texts below ``least``, the text's hash behind the path: those on nearly all pages with their node."""
    pages = counted.filter("kind = 'page' and n > 1").select("host", "path", F.col("n").alias("pages"))
    low = counted.filter("kind = 'text' and n > 1").join(pages, ["host", "path"]).filter(1 - F.log("n") / F.log("pages") < how.least)
    return low.select("host", F.concat_ws("\x01", "path", F.col("feature").cast("string")).alias("path"))


def main_text(page: Page, removed: set[str], hashes: list[int] | None = None) -> str:
    """The text of the blocks that neither their names nor the host's tree remove. ``hashes``: of the blocks' texts."""
    size = lambda some: sum(len(page.blocks[i][1]) for i in some)
    at_most = lambda named: [i for i, b in enumerate(page.blocks) if not b[2] and b[3] <= named]
    left, weak = at_most(0), at_most(WEAK)
    if len(weak) > len(left) and 2 * size(left) < size(weak):
        left = weak
    left = left or at_most(STRONG)

    def stays(i: int) -> bool:
        path = page.blocks[i][0]
        if hashes is not None and f"{path}\x01{hashes[i]}" in removed:
            return False
        at = len(path)
        while at > 0:
            if path[:at] in removed:
                return False
            at = path.rfind("/", 0, at)
        return True

    def cleaned(some: list[int]) -> list[int]:
        kept = [i for i in some if stays(i)] if removed else some
        return kept if 2 * size(kept) >= size(some) else some

    if page.has_main:
        inside = cleaned([i for i in left if page.blocks[i][4]])
        outside = [i for i in left if not page.blocks[i][4] and (not removed or stays(i))]
        left = inside if 3 * size(inside) >= size(outside) else sorted(inside + outside)
    else:
        left = cleaned(left)
    return " ".join(page.blocks[i][1] for i in left)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), 500):
            pdf = whole.iloc[at : at + 500]
            got = [read(h) for h in pdf["html"]]
            hashes = _hash([b[1] for page in got for b in page.blocks]).tolist()
            text, first = [], 0
            # One set for all pages of a host.
            of_host: dict[str, set[str]] = {}
            for page, host, r in zip(got, pdf["host"], pdf["removed"], strict=True):
                last = first + len(page.blocks)
                if host not in of_host:
                    of_host[host] = set() if r is None else set(r)
                text.append(main_text(page, of_host[host], hashes[first:last]))
                first = last
            yield pd.DataFrame({"_key": pdf["_key"], "_url": pdf["_url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, how: Style = Style(), *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For every row: the key, the url, ``text`` and ``n_chars``."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("host"), F.col(html).alias("html"))
    counted = durable(counts(rows.select("host", "html")))
    tree = style_tree(counted, how).filter(F.col("highest") < how.least).select("host", "path")
    low = durable(tree.unionByName(repeated(counted, how)).groupBy("host").agg(F.collect_list("path").alias("removed")))
    low = small_or_shuffled(low, bytes_of=F.octet_length(F.concat_ws("", "removed")) + 16 * F.size("removed"), most_bytes=how.broadcast_bytes)
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    out = rows.join(low, "host", "left").select("_key", "_url", "host", "html", "removed").mapInPandas(_extract, f"_key {kinds[0]}, _url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"_key": key, "_url": url})
