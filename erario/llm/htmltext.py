"""Main text of web pages by a site style tree.

The DOMs of a host are merged: elements with the same chain of tags and classes
from the root are one style node. Over the host's pages a node's presentation
importance is the entropy of the tag sequences below it, its content importance
the entropy of the texts it holds, both in proportion to the host's greatest, so
between 0 (the same on every page) and 1 on hosts of any size. What a page shows
is weighed along the path: two thirds of a text's importance are the greatest
presentation importance on the way from the root to it, one third its node's
content. Menus, notices and footers are laid out alike on all pages, whatever
they say; an article's blocks differ in kind and number. Branches whose texts
all stay at or below the threshold are removed.

Where a host lays out all its pages alike (in less than ``KINDS`` ways),
presentation tells nothing: it counts fully for every node, and what the content
leaves goes by the names of tags, roles and classes. Hosts with too few pages for
a tree go by these names alone.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Occurrences from which a style node's entropies count.
MIN_PAGES = 10
#: Texts up to this importance are furniture; the share of presentation in it.
LOW, LAYOUT = 0.7, 2 / 3
#: Ways of laying out some node (as the exponential of the entropy) that make layouts tell.
KINDS = 4

# Elements of HTML by their role on a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math xmp noembed".split())
_DROP = frozenset("head nav footer aside form script style noscript template iframe textarea title svg math select "
                  "button object canvas dialog menu datalist audio video".split())
#: Those that show no text of a page, or none that is read, on any host.
_NEVER = _DROP - frozenset("nav footer aside menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 "
                      "h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select article section div body html".split())
_NOISE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended recommendations comment comments commentlist "
    "respond replies disqus widget pagination pager copyright legal skip toolbar topbar masthead".split())
_NOISE_CLASSES = frozenset("header site-header page-header".split())
#: Whole class names of furniture that may hold articles: noise words, then at most words for a container.
_NOISE_NAME = re.compile(rf"(?:(?:{'|'.join(sorted(_NOISE_WORDS))})(?:[-_]+|(?=$)))+"
                         r"(?:(?:area|list|box|block|section|wrapper|wrap|container|posts|articles|stories|items|links|body)"
                         r"(?:[-_]+|(?=$)))*")
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                         "toolbar form".split())
_MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"""
                    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)"""
                    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*)(?:>|$)"""
                    r"""|(?P<text>[^<]+|<)""", re.S)
_ATTR = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    tag: str
    key: int
    noise: bool
    by_word: bool = False  # furniture by a word of a class or id only
    holds_main: bool = False
    never: bool = False  # shows no text, whatever the host
    parts: list = field(default_factory=list)  # texts and elements in page order


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(s)} if s.strip() else {}


def _is_hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _is_furniture(tag: str, a: dict[str, str], in_main: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether only by a word within its
    classes and id, which says nothing of an article, main or what holds one."""
    if tag in _DROP or tag == "header" and not in_main:
        return True, False
    if tag in ("body", "html") or not a:
        return False, False
    if _is_hidden(a):
        return True, False
    if a.get("role", "").lower() in _NOISE_ROLES:
        return True, False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower()
    if any(n in _NOISE_CLASSES or _NOISE_NAME.fullmatch(n) for n in names.split()):
        return True, False
    by_word = tag not in _MAIN and not _NOISE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", names))
    return by_word, by_word


def _keep_holders(stack: list[Element]) -> None:
    """The open elements around an article or main are not furniture by a mere
    word, up to one that is furniture for other reasons and hides the article."""
    for x in reversed(stack):
        if x.holds_main:
            break
        x.holds_main = True
        if x.noise and not x.by_word:
            break
        x.noise = False


def parse(page: str) -> Element:
    """The page's element tree; unclosed and misplaced tags are mended as browsers do."""
    import xxhash

    root = Element("", 0, False)
    stack, main = [root], 0
    # where in the stack each tag, the blocks and the scopes are open: no scan of a deep stack
    places: dict[str, list[int]] = {"": [0], " block": [0], " scope": [0]}

    def kinds_of(tag: str) -> list[str]:
        return [tag, *([] if tag in _INLINE else [" block"]), *([" scope"] if tag in _SCOPE else [])]

    def close(depth: int) -> None:
        nonlocal main
        while len(stack) > depth:
            tag = stack.pop().tag
            main -= tag in _MAIN
            for kind in kinds_of(tag):
                places[kind].pop()

    keys: dict[tuple[int, str], int] = {}
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] or m["cdata"]:
            stack[-1].parts.append(html.unescape(m["text"]) if m["text"] else m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            # an inline tag's end does not reach over a block
            if places.get(tag) and (tag not in _INLINE or places[tag][-1] > places[" block"][-1]):
                close(places[tag][-1])
        elif m["tag"]:
            tag = m["tag"].lower()
            closed = ("p",) if tag in _CLOSES_P else _SIBLING.get(tag, ())
            open_at = max((places[t][-1] for t in closed if places.get(t)), default=0)
            if open_at > places[" scope"][-1]:
                close(open_at)
            a = _attributes(m["attrs"])
            label = tag + "." + re.sub(r"\d{3,}", "0", a.get("class", "") or a.get("id", ""))
            place = (stack[-1].key, label)
            if place not in keys:
                h = xxhash.xxh3_64_intdigest(f"{place[0]} {label}")
                keys[place] = h - (1 << 64) if h >> 63 else h
            e = Element(tag, keys[place], *_is_furniture(tag, a, main > 0))
            e.never = tag in _NEVER or _is_hidden(a)
            if tag in _MAIN and not e.noise:
                _keep_holders(stack)
            stack[-1].parts.append(e)
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in _VOID and not m["attrs"].endswith("/"):
                for kind in kinds_of(tag):
                    places.setdefault(kind, []).append(len(stack))
                stack.append(e)
                main += tag in _MAIN
    return root


def _walk(e: Element, skip: str = "noise") -> Iterator[Element]:
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += [p for p in x.parts if isinstance(p, Element) and not getattr(p, skip)]


def style_counts(page: str) -> Iterator[tuple[int, str, int]]:
    """``(node, kind, value)`` of the page's elements that show text: hashes of
    the tags below it (P) and of the text it holds itself (T)."""
    import xxhash

    for e in _walk(parse(page), "never"):
        text = _SPACE.sub(" ", " ".join(p for p in e.parts if isinstance(p, str))).strip()
        tags = " ".join(p.tag for p in e.parts if isinstance(p, Element))
        for kind, value in (("P", tags), ("T", text)):
            if value:
                h = xxhash.xxh3_64_intdigest(value)
                yield e.key, kind, h - (1 << 64) if h >> 63 else h


def _flat(e: Element) -> str:
    """Text of a branch without named furniture, blocks and breaks set off by blanks."""
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.noise:
            edge = "" if x.tag in _INLINE else " "
            todo += [edge, *reversed(x.parts), edge]
    return _SPACE.sub(" ", "".join(out)).strip()


def _mains(root: Element) -> list[Element]:
    """Outermost article, else main elements that are not furniture, in page order."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                found.append(x)
            else:
                todo += [p for p in reversed(x.parts) if isinstance(p, Element) and not p.noise]
        if found:
            return found
    return [root]


def named_text(page: str) -> str:
    """The text of a page's articles (else main elements, else its body) without
    what tags, roles and classes name as furniture."""
    return " ".join(t for t in (_flat(e) for e in _mains(parse(page)) if not e.noise) if t)


def tree_text(page: str, tree: dict[int, tuple[float, float]], named: bool = False, low: float = LOW) -> str:
    """The text of a page's important nodes; with ``named`` only of its articles
    and not of named furniture. ``tree``: presentation and content
    importance of style nodes; a node that the tree lacks is rare on the host
    and wholly important, as a node of a single page is. One pass over the page,
    so deep nesting costs no more than its elements."""
    out: list[str] = []
    root = parse(page)
    todo: list = [(x, 0.0) for e in reversed(_mains(root) if named else [root]) for x in (" ", e)]
    while todo:
        x, path = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.never or named and x.noise:
            continue
        layout, content = tree.get(x.key, (1.0, 1.0))
        path = max(path, layout)
        keep = LAYOUT * path + (1 - LAYOUT) * content > low
        edge = "" if x.tag in _INLINE else " "
        todo.append((edge, path))
        todo += [(p, path) for p in reversed(x.parts) if keep or isinstance(p, Element)]
        todo.append((edge, path))
    return _SPACE.sub(" ", "".join(out)).strip()


def main_text(page: str, tree: dict[int, tuple[float, float]] | None = None, alike: bool = False, low: float = LOW) -> str:
    """A page's main text: by its host's style tree (``alike``: and by names), or
    by names without a tree."""
    return tree_text(page, tree, alike, low) if tree else named_text(page)


def host_of(url: str | None) -> str:
    return re.split(r"[/?#]", (url or "").partition("://")[2], maxsplit=1)[0].lower()


def style_trees(pages: DataFrame, min_pages: int = MIN_PAGES, kinds: float = KINDS) -> DataFrame:
    """``host, alike, nodes`` (array of node, layout, content): the style nodes of each
    host that occur at least ``min_pages`` times on its distinct pages, with the
    entropy of their tag sequences, and that of their texts to the base of the
    occurrences, in proportion to the host's greatest. ``alike``: no node has
    ``kinds`` layouts, all count 1.

    Pages of a host with the same nodes and values are copies and count once: a
    page's own text does not become furniture by being copied. Values are
    counted per (host, node, value), so a host with a third of all pages is
    spread over its pages, nodes and values. A tree has as many nodes as the
    host's templates, not as its pages.
    """
    import xxhash

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple[str, int], tuple] = {}
            for url, page in zip(pdf["url"], pdf["html"]):
                found = tuple(style_counts(page))
                h = xxhash.xxh3_64_intdigest(repr(found))
                if found:
                    seen.setdefault((host_of(url), h - (1 << 64) if h >> 63 else h), found)
            yield pd.DataFrame([(*k, *map(list, zip(*found))) for k, found in seen.items()],
                               columns=["host", "page", "node", "kind", "value"])

    counted = (pages.where("html is not null").select("url", "html")
               .mapInPandas(distinct, "host string, page long, node array<long>, kind array<string>, value array<long>")
               .dropDuplicates(["host", "page"])
               .select("host", F.inline(F.arrays_zip("node", "kind", "value")))
               .groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n")))
    entropy = (counted.groupBy("host", "node", "kind")
               .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
               .where(F.col("m") >= min_pages)
               .withColumn("h", F.log("m") - F.col("s") / F.col("m")))
    of = lambda kind, h: F.max(F.when(F.col("kind") == kind, h))
    nodes = (entropy.groupBy("host", "node").agg(of("P", F.col("h")).alias("layout"), of("T", F.col("h") / F.log("m")).alias("content")))
    most = Window.partitionBy("host")  # as many rows as the host's templates have nodes
    nodes = nodes.withColumns({"wide": F.max("layout").over(most), "rich": F.max("content").over(most)})
    share = lambda c, top: F.coalesce(F.when(F.col(top) > 0, F.col(c) / F.col(top)), F.lit(0.0)).alias(c)
    alike = F.coalesce(F.col("wide") < math.log(kinds), F.lit(True))
    layout = F.when(alike, 1.0).otherwise(share("layout", "wide")).alias("layout")
    return (nodes.groupBy("host", alike.alias("alike"))
            .agg(F.collect_list(F.struct("node", layout, share("content", "rich"))).alias("nodes")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """Return ``page_id, url, text, n_chars`` for every row of ``pages``
    (``page_id, url, html``; other columns are ignored).

    The text is what the host's style tree finds important; of a host without a
    tree, or with one layout, that of the page's articles (else of its main
    elements, else of its body) without named furniture. NULL or empty html gives an empty text.
    Character references are decoded, white space in a block becomes one space
    and blocks are joined by one. A NULL URL is the host ''. Repeated rows are
    extracted each. ``min_pages`` and ``low`` are the method's two parameters.
    """
    nodes = saved(style_trees(pages, min_pages), "style-trees").withColumnRenamed("host", "_host")
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = (pages.select(F.col("page_id").cast("string"), "url", "html").withColumn("_host", host)
            .join(nodes, "_host", "left").select("page_id", "url", "html", "alike", "nodes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for page, alike, nodes in zip(pdf["html"], pdf["alike"], pdf["nodes"]):
                tree = None if nodes is None else {n["node"]: (n["layout"], n["content"]) for n in nodes}
                texts.append(main_text(page or "", tree, bool(alike), low))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return (rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
            .withColumn("page_id", F.col("page_id").cast(kind)))
