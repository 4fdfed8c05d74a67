"""Main text of web pages by wrappers inferred from each host's pages.

A page becomes a tree of block elements and text.  Pages of one host are
aligned one after the other into a wrapper, a union-free regular expression
over such trees: children are matched in order by their signature (tag, class,
role); what only some pages have becomes optional, neighbours of one signature
become one repeated group, and texts that differ become text slots, while equal
ones stay constant.  The wrapper decides what is text:

* the region is the smallest element that holds all of the host's running text
  in slots (a page's article or main element goes first, if it holds half of it);
* inside it, block texts that stay constant over the host's pages are template
  text, and groups whose slots are mostly link text are lists of links; neither
  is read.  Copies of one article count once for this, and a group of pages
  whose text does not vary has no constants.

What no alignment can tell from the article, as it varies like it, is known by
its element or by a whole class word: menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.  Class words say nothing about
elements that hold the page's article, nor do words of layout (``has-sidebar``,
``comments-open``).

Hosts use several layouts, so a page's layout is first found from the page
alone (the path to its own running text), and each layout of a host that at
least ``LEAST_PAGES`` of its pages have gets a wrapper of its own, fitted on at
most ``PAGES_A_HOST`` different pages that are chosen by a hash of their html;
other pages are read by a wrapper of their own.  Every page's whole html is
extracted.  Pages of a host are never gathered beyond that, so a host may hold
any share of the rows.

Nulls: null or empty html gives the empty text, a null url is a host of its
own, a null page_id is kept.  Broken markup is read as far as it goes (a tag or
quotation that never ends is dropped).  Very long pages are read whole.  Ties
between regions go to the first one in page order.  Repeated rows are extracted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.durable import checked_join, stored

#: Pages on which a layout of a host is fitted, and pages that a layout needs for a wrapper of its own.
PAGES_A_HOST, LEAST_PAGES = 16, 3
#: Different articles of a layout that must show a block text, and their share, for it to be template text.
LEAST_SHOWN, SHOWN_SHARE = 4, 0.8
#: Share of link text from which a group is a list of links.
LINK_SHARE = 0.8
#: Most hosts whose wrappers may be broadcast.
HOSTS_AT_ONCE = 5_000

#: Elements by role.
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var ruby rt rp label".split()
)
_DROPPED = frozenset("head nav aside footer form button select option optgroup input dialog menu svg canvas object audio video map fieldset".split()) | _RAW
_GROUPS = frozenset("ul ol dl div section table tbody p".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs masthead header footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations comment comments disqus replies respond widget widgets toolbar pagination pager skip".split()
)
#: Words that may stand beside those in a class word without changing its meaning.
_PLACES = frozenset(
    "site page main top bottom left right primary secondary global local list lists box boxes area wrap wrapper container block section inner outer item items bar "
    "link links button buttons btn holder unit slot zone body content posts articles stories form text message messages panel row col column group thread".split()
)
#: Words that make a class word one of layout or state, at its beginning or its end.
_LAYOUT_FIRST = frozenset("has have no not with without is hide hides hidden show shows off on under after before below above near single layout".split())
_LAYOUT_LAST = frozenset("open opened closed enabled disabled on off active allowed layout grid page template none visible hidden ready".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_CONTENT = frozenset("article main".split())
_FORMS = frozenset("form fieldset".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_OPEN_END = re.compile(r"<(?:/?[a-zA-Z][^<]*|[!?][^<]*)\Z", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    __slots__ = ("by_class", "children", "noise", "parent", "sig", "tag")

    def __init__(self, tag: str, sig: str, noise: bool, by_class: bool, parent: "Node | None"):
        self.tag, self.sig, self.noise, self.by_class, self.parent = tag, sig, noise, by_class, parent
        self.children: list = []  # nodes, and (text, length of its link text)


def noise_word(word: str) -> bool:
    """Whether a whole class word names a part beside the article."""
    parts = [x.rstrip("0123456789") for x in _SPLIT.split(_CAMEL.sub("-", word).lower())]
    parts = [x for x in parts if x]
    if not parts or parts[0] in _LAYOUT_FIRST or (len(parts) > 1 and parts[-1] in _LAYOUT_LAST):
        return False
    return not _NOISE.isdisjoint(parts) and all(x in _NOISE or x in _PLACES for x in parts)


def _element(tag: str, rest: str, parent: Node) -> Node:
    noise, by_class, sig = tag in _DROPPED, False, tag
    if rest.strip(" /\n\t"):
        got = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
        own = f"{got.get('class', '')} {got.get('id', '')}".split()
        role = got.get("role", "").lower()
        noise = noise or role in _NOISE_ROLES or "hidden" in got or got.get("aria-hidden", "") == "true"
        by_class = not noise and tag not in ("html", "body", "main") and role != "main" and any(map(noise_word, own))
        names = [x for w in own for x in _SPLIT.split(w.lower()) if x and not x.isdigit()][:4]
        sig = tag + "".join("." + x for x in names) + (f"@{role}" if role else "")
    return Node(tag, sig, noise or by_class, by_class, parent)


def _holds_article(node: Node, top: bool = True) -> bool:
    """Whether an article or main element that is no noise itself, or a page's first heading, is below."""
    for c in node.children:
        if isinstance(c, Node) and (not c.noise or c.by_class):
            if not c.noise and (c.tag in _CONTENT or c.sig.endswith("@main") or (top and c.tag == "h1")):
                return True
            if _holds_article(c, top):
                return True
    return False


def _settle(node: Node) -> None:
    """Elements known as noise by class words alone, and forms, are none if they hold the article."""
    for c in node.children:
        if isinstance(c, Node):
            if c.noise and (c.by_class or c.tag in _FORMS):
                if c.tag in _CONTENT:
                    continue
                c.noise = not _holds_article(c, c.tag in _FORMS)
            if not c.noise:
                _settle(c)


def parse(page: str) -> Node:
    """The tree of block elements and texts of a page."""
    root = Node("#root", "#root", False, False, None)
    at_node, buffer, links, in_link = root, [], 0, 0
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal links
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                at_node.children.append((text, min(links, len(text))))
            buffer.clear()
            links = 0

    def add(text: str) -> None:
        nonlocal links
        buffer.append(text)
        if in_link:
            links += len(text.strip())

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            if _OPEN_END.match(page, lt):  # the page ends inside a tag
                break
            add("<")
            pos = lt + 1
            continue
        pos = m.end()
        close, tag, rest = m.group(2), (m.group(3) or "").lower(), m.group(4) or ""
        if not tag:
            if m.group(1):
                add(m.group(1).replace("&", "&amp;"))
            continue
        if tag in _RAW:
            if not close:
                flush()
                end = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if close else 1
            continue
        flush()
        if tag in _VOID:
            continue
        if close:
            up = at_node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at_node = up.parent
                in_link = 0
            continue
        if tag in _CLOSES_P or tag in _SIBLINGS:
            shut = {"p"} if tag in _CLOSES_P else _SIBLINGS[tag]
            up = at_node
            while up is not root and up.tag not in shut and up.tag in ("p", *_SIBLINGS) and tag not in ("ul", "ol", "dl", "table"):
                up = up.parent
            if up.tag in shut:
                at_node = up.parent
        node = _element(tag, rest, at_node)
        at_node.children.append(node)
        at_node = node
    flush()
    _settle(root)
    return root


class Wrapper:
    """One node of the expression: its signature, how it may occur, and what is in it."""

    __slots__ = ("children", "constant", "links", "met", "noise", "optional", "repeated", "sig", "slot", "tag")

    def __init__(self, node: Node):
        self.tag, self.sig, self.noise = node.tag, node.sig, node.noise
        self.optional = self.repeated = False
        self.constant: str | None = None  # the only text met so far
        self.slot = 0  # characters in slots, over all pages
        self.links = self.met = 0
        self.children: list[Wrapper] = []
        self.take(node, True)

    def take(self, node: Node, first: bool) -> None:
        """Align one page's node: texts into the slot, children in order."""
        text = " ".join(c[0] for c in node.children if isinstance(c, tuple))
        if first:
            self.constant = text
        elif self.constant is not None and self.constant != text:
            self.constant = None  # a mismatch of texts: a slot
        self.met += 1
        self.slot += len(text)
        self.links += sum(c[1] for c in node.children if isinstance(c, tuple))
        own, k = [c for c in node.children if isinstance(c, Node)], 0
        met: set[int] = set()
        for turn, child in enumerate(own):
            at = next((i for i in range(k, len(self.children)) if self.children[i].sig == child.sig), None)
            if at is None and k and self.children[k - 1].sig == child.sig:
                at = k - 1
            if at is not None:
                w = self.children[at]
                if at in met:
                    w.repeated = True
                w.take(child, False)
            else:  # a mismatch of tags: the page's part is optional, unless it repeats its neighbour
                w = Wrapper(child)
                at = k
                w.optional = not first
                self.children.insert(at, w)
                met = {i + (i >= at) for i in met}
            met.add(at)
            k = at if at + 1 < len(self.children) and self.children[at].sig == child.sig and turn + 1 < len(own) and own[turn + 1].sig == child.sig else at + 1
        for i, w in enumerate(self.children):
            if i not in met:
                w.optional = True

    def chars(self) -> tuple[int, int]:
        """Characters below in slots, and those of them in links; noise left out."""
        got = [(self.slot, self.links)] + [c.chars() for c in self.children if not c.noise]
        return sum(g[0] for g in got), sum(g[1] for g in got)

    def lists_links(self) -> bool:
        """Whether this is a group of links: several in a page, and hardly any other text."""
        slot, links = self.chars()
        return self.tag in _GROUPS and links > LINK_SHARE * slot and any(c.repeated for c in self.children)

    def running(self) -> int:
        """Characters of running text in slots below; noise, links and constants left out."""
        if self.noise or self.lists_links():
            return 0
        own = self.slot - self.links if (self.constant is None or self.met == 1) and self.links <= 0.6 * self.slot else 0
        return own + sum(c.running() for c in self.children)

    def expression(self) -> str:
        """The wrapper as a regular expression."""
        inner = ("#text" if self.constant is None else self.constant[:40]) if self.slot else ""
        body = f"<{self.sig}>{inner}{''.join(c.expression() for c in self.children)}</>"
        return f"({body})" + ("*" if self.repeated and self.optional else "+" if self.repeated else "?") if self.optional or self.repeated else body


def induce(pages: list[str]) -> Wrapper | None:
    """The wrapper of some pages of one host."""
    wrapper = None
    for page in pages:
        tree = parse(page)
        if not tree.children:
            continue
        if wrapper is None:
            wrapper = Wrapper(tree)
        else:
            wrapper.take(tree, False)
    return wrapper


def main_region(wrapper: Wrapper) -> list[str]:
    """Signatures from the root to the region of the running text."""
    named = []

    def look(w: Wrapper, path: list[str]) -> None:
        for c in w.children:
            if not c.noise:
                if c.tag in _CONTENT or c.sig.endswith("@main"):
                    named.append((c.tag == "article", c.running(), [*path, c.sig]))
                look(c, [*path, c.sig])

    look(wrapper, [])
    whole = wrapper.running()
    held = [x for x in named if x[1] >= 0.5 * max(n for _, n, _ in named) and x[1] >= 0.5 * whole]
    if held:
        # the outermost article (or else main element) that holds most of the running text
        return min((p for _, _, p in held), key=lambda p: (not p[-1].startswith("article"), len(p)))
    path: list[str] = []
    w = wrapper
    while True:
        best = max(w.children, key=lambda c: c.running(), default=None)
        if best is None or best.tag in ("p", "li", "td", *_HEADINGS) or not best.running() or best.running() < w.running():
            return path
        w, path = best, [*path, best.sig]


def link_groups(wrapper: Wrapper, region: list[str]) -> list[list[str]]:
    """Paths of the lists of links inside the region."""
    out: list[list[str]] = []

    def look(w: Wrapper, path: list[str]) -> None:
        for c in w.children:
            own = [*path, c.sig]
            if not c.noise and own == region[: len(own)]:
                look(c, own)
            elif not c.noise and own[: len(region)] == region:
                if c.lists_links() and c.met > 1:
                    out.append(own)
                else:
                    look(c, own)

    look(wrapper, [])
    return out


def template_texts(pages: list[list[str]]) -> list[str]:
    """Block texts that pages of different articles share; ``pages``: the block texts of each page.

    Pages most of whose text is equal are one article.
    """
    articles: list[list[set[str]]] = []
    for blocks in map(set, pages):
        size = sum(map(len, blocks))
        for own in articles:
            common = sum(map(len, blocks & own[0]))
            if 2 * common > min(size, sum(map(len, own[0]))):
                own.append(blocks)
                break
        else:
            articles.append([blocks])
    if len(articles) < LEAST_SHOWN:
        return []
    shown = Counter(t for own in articles for t in set.union(*own))
    return sorted(t for t, n in shown.items() if n >= max(LEAST_SHOWN, SHOWN_SHARE * len(articles)))


def blocks_of(tree: Node, region: list[str], groups: Iterable[list[str]] = ()) -> list[tuple[str, bool]]:
    """Block texts of a page's region in page order, and whether they are headings."""
    at = [tree]
    for sig in region:
        at = [c for node in at for c in node.children if isinstance(c, Node) and c.sig == sig]
    out: list[tuple[str, bool]] = []
    closed = {tuple(g) for g in groups}

    def walk(node: Node, path: tuple[str, ...], heads: bool, heading: bool) -> None:
        """``heads``: only headings are read (inside a header)."""
        for c in node.children:
            if isinstance(c, tuple):
                if heading or (not heads and (inside or c[1] < LINK_SHARE * len(c[0]))):
                    out.append((c[0], heading))
            elif c.tag == "header" or (c.by_class and ".header" in c.sig):
                if inside:
                    walk(c, (*path, c.sig), True, False)
            elif not c.noise and (*path, c.sig) not in closed:
                walk(c, (*path, c.sig), heads, heading or c.tag in _HEADINGS)

    for node in at:
        inside = bool(region) and not region[-1].startswith(("html", "body"))
        walk(node, tuple(region), False, node.tag in _HEADINGS)
    return out


def rules(pages: list[str]) -> tuple[dict, str] | None:
    """What the wrapper of some pages says about reading them, and its expression."""
    wrapper = induce(pages)
    if wrapper is None:
        return None
    region = main_region(wrapper)
    groups = link_groups(wrapper, region)
    texts = [[t for t, heading in blocks_of(parse(p), region, groups) if not heading] for p in pages]
    return {"region": region, "groups": groups, "texts": template_texts(texts)}, wrapper.expression()


def layout_of(tree: Node) -> str:
    """A page's layout: the path to its own running text."""
    return json.dumps(main_region(Wrapper(tree)))


def read(tree: Node, rule: dict | None) -> str:
    """The text of a page by its wrapper's rules, or by those of a wrapper of its own."""
    if rule is None:
        wrapper = Wrapper(tree)
        region = main_region(wrapper)
        return " ".join(t for t, _ in blocks_of(tree, region))
    template = set(rule["texts"])
    return " ".join(t for t, heading in blocks_of(tree, rule["region"], rule["groups"]) if heading or t not in template)


def extract(page: str | None, wrappers: dict[str, dict]) -> str:
    if not page:
        return ""
    tree = parse(page)
    return read(tree, wrappers.get(layout_of(tree)) if wrappers else None)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def layouts(pages: DataFrame, most: int) -> DataFrame:
    """(host, layout, key, n): of each layout of a host the pages of the ``most`` least keys that a task has met, and how many rows they stand for.

    ``pages``: host, key (a hash of the html), html.  A task gives no more rows of a
    layout than that, so no host is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, str], tuple[list[int], set[int], list[int]]] = {}

        def rows() -> pa.RecordBatch:
            out = [(host, layout, -k, count[0] if i == 0 else 0) for (host, layout), (heap, _, count) in met.items() for i, k in enumerate(heap)]
            met.clear()
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "layout", "key", "n"])

        for batch in batches:
            for host, key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                heap, own, count = met.setdefault((host, layout_of(parse(page.as_py()))), ([], set(), [0]))
                count[0] += 1
                if key in own or (len(heap) == most and -key <= heap[0]):
                    continue
                own.add(key)
                if len(heap) < most:
                    heapq.heappush(heap, -key)
                else:
                    own.discard(-heapq.heapreplace(heap, -key))
            if len(met) > HOSTS_AT_ONCE:
                yield rows()
        yield rows()

    return pages.select("host", "key", "html").mapInArrow(run, "host string, layout string, key long, n long")


def wrappers_of(pages: DataFrame, pages_a_host: int = PAGES_A_HOST) -> DataFrame:
    """(host, layout, rules, wrapper) of each layout of a host; ``pages``: host, key (hash of the html), html.

    A wrapper is fitted on the different pages of the least keys, all of them where a layout has no more.
    """
    known = pages.where("html <> ''")
    chosen = stored(layouts(known, pages_a_host), "layout-pages")
    several = chosen.groupBy("host", "layout").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "layout")
    least = Window.partitionBy("host", "layout").orderBy("key")  # of pages_a_host rows from each task at most
    chosen = chosen.join(several, ["host", "layout"], "left_semi").select("host", "key", "layout").distinct()
    chosen = stored(chosen.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= pages_a_host).drop("_n"), "wrapper-pages")
    sample = checked_join(known, chosen, ["host", "key"]).groupBy("host", "layout", "key").agg(F.min("html").alias("html"))

    def wrap(group: pd.DataFrame) -> pd.DataFrame:
        got = rules(group.sort_values("key")["html"].tolist())
        rule, expression = (json.dumps(got[0]), got[1]) if got else (None, None)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "layout": [group["layout"].iloc[0]], "rules": [rule], "wrapper": [expression]})

    return stored(sample.groupBy("host", "layout").applyInPandas(wrap, "host string, layout string, rules string, wrapper string"), "wrappers")


def main_text(pages: DataFrame, pages_a_host: int = PAGES_A_HOST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("key"))
    wrappers = wrappers_of(pages, pages_a_host).where("rules IS NOT NULL")
    by_host = stored(wrappers.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layout", "rules")))).alias("rules")), "host-wrappers")
    joined = checked_join(pages, by_host, "host", "left", HOSTS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str | None, dict] = {None: {}}
        for batch in batches:
            texts = []
            for page, own in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if own not in met:
                    if len(met) > HOSTS_AT_ONCE:
                        met = {None: {}}
                    met[own] = {k: json.loads(v) for k, v in json.loads(own).items()}
                texts.append(extract(page.as_py(), met[own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "rules").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
