"""Main text of web pages by site template removal.

Every page is parsed into element subtrees. The hash of a subtree covers its
tag, its text and its children; subtrees are counted per host in Spark, and
those that recur on many of its pages are deleted: anywhere outside the article,
and in it if they are plain boxes (``div``, ``section`` and the like; not
paragraphs, headings, lists or tables) of a large share of the host's pages.
A page has a vote if a good part of its text is its own: contents are counted,
not urls, so copies vote once, and near copies, which share most of their text
with other pages, do not vote at all. So what copies share is not taken for
template, however many there are.

What a page marks itself as furniture (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) goes by tag, role,
class or id; in an article, where ids are anchors and classes may be subjects
(``related-work``), only by names that mean nothing else. If the page has an
article or main element, the rest of the page goes too.

Text is cut into blocks at block elements; character references are decoded,
white space inside a block becomes one space, blocks are joined by a line feed.

Null html counts as empty and gives empty text. Pages with a null or odd url
belong to the host that is the empty string. Malformed, unclosed and cut-off
html is read as far as it goes. Repeated rows repeat (and count once for the
template); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, need
from .urls import host_of

#: Element kinds by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form button select input label fieldset legend dialog menu head datalist option".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption figure ul ol dl table thead tbody tfoot caption "
                  "article main body html".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                   "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|"
    r"cookies|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo|promotion|"
    r"related|replies|respond|share|sharing|sidebar|sidebars|signup|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|"
    r"site-header|page-header)(?:$|[\s_-])", re.I)
#: Furniture by class or id in an article, alone or with words of place and kind, and ids that are subjects too.
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
                   "footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related "
                   "replies respond share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar topbar widget".split())
_PLAIN = frozenset("area article articles bar block bottom box btn button buttons col container content form group header icon icons inner item items "
                   "left link links list main media module outer page pages panel post posts reader readers right row section site slot stories "
                   "story text top unit user users wrap wrapper".split())
_SUBJECTS = frozenset("banner comment comments menu navigation notice notices promotion related replies share sharing social".split())
_TOKEN = re.compile(
    r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*>|[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _names_furniture(name: str, value: str) -> bool:
    """Whether a class or id of an element in an article names furniture and nothing else."""
    for token in value.lower().split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        if any(w in _NAMES for w in words) and all(w in _NAMES or w in _PLAIN or w.isdigit() for w in words):
            if name == "class" or len(words) > 1 or words[0] not in _SUBJECTS:
                return True
    return False


def _is_furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            if _names_furniture(name, value) if in_article else _MARK.search(value):
                return True
        if name in ("class", "id") and tag == "article" and re.search(r"(?:^|[\s_-])(?:comment|reply|teaser|promo|ad)(?:$|[\s_-])", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Page:
    """One parsed page: subtree hashes, and blocks of text with the subtree they lie in."""

    def __init__(self, source: str):
        self.hashes: list[int] = []  # of subtrees that may be template; outer ones first
        self.outer: list[int] = []  # the next such subtree around each (-1: none)
        self.inside: list[bool] = []  # whether it lies in an article
        self.blocks: list[tuple[str, int, bool]] = []  # text, innermost such subtree, in an article
        self.has_article = False
        self._stack: list[list] = []  # [tag, own furniture, number or -1, content for the hash, in an article, number around it]
        self._open_tags: Counter = Counter()
        self._buffer: list[str] = []
        self._read(source)

    # A subtree's content is gathered while it is open, children as their hashes.
    def _text(self, raw: str) -> None:
        if not (self._stack and self._stack[-1][1]) and raw:
            self._buffer.append(_html.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        if not self._buffer:
            return
        text = " ".join("".join(self._buffer).split())
        self._buffer = []
        if text:
            if self._stack:
                self._stack[-1][3].append(text)
            top = self._stack[-1] if self._stack else None
            self.blocks.append((text, self._number(top), bool(top and top[4])))

    @staticmethod
    def _number(entry: list | None) -> int:
        """The innermost numbered subtree at an open element."""
        return -1 if entry is None else entry[2] if entry[2] >= 0 else entry[5]

    def _open(self, tag: str, attrs: str) -> None:
        above = self._stack[-1] if self._stack else None
        in_article = bool(above and above[4])
        gone = bool(above and above[1]) or _is_furniture(tag, attrs, in_article)
        if not gone and (tag in ("article", "main") or 'role="main"' in attrs):
            in_article = self.has_article = True
        number = -1
        if not gone and not (in_article and tag in PROSE) and tag not in ("html", "body"):
            number = len(self.hashes)
            self.hashes.append(0)
            self.outer.append(self._number(above))
            self.inside.append(in_article)
        self._stack.append([tag, gone, number, [], in_article, self._number(above)])
        self._open_tags[tag] += 1

    def _close(self) -> None:
        import xxhash

        tag, gone, number, content, _, _ = self._stack.pop()
        self._open_tags[tag] -= 1
        if gone or not content:
            return
        h = xxhash.xxh64_intdigest("\x1f".join([tag, *content]))
        if number >= 0:
            self.hashes[number] = _signed(h)
        if self._stack:
            self._stack[-1][3].append(f"{h:x}")

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._flush()
            self._close()

    def _find(self, tags, stop) -> int:
        if not any(self._open_tags[t] for t in tags):
            return -1
        for at in range(len(self._stack) - 1, -1, -1):
            if self._stack[at][0] in tags:
                return at
            if self._stack[at][0] in stop:
                return -1
        return -1

    def _read(self, source: str) -> None:
        at = 0
        match = _TOKEN.search(source, at)
        while match:
            self._text(source[at:match.start()])
            at = match.end()
            if match[1]:
                tag = match[1].lower()
                if tag not in INLINE:
                    self._flush()
                    found = self._find((tag,), ())
                    if found >= 0:
                        self._close_to(found)
            elif match[2]:
                tag, attrs = match[2].lower(), match[3]
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(source, at)
                    if not attrs.rstrip(">").endswith("/") or tag not in ("svg", "math"):
                        at = end.end() if end else len(source)
                elif tag == "br":
                    self._buffer.append(" ")
                elif tag in INLINE:
                    # Inline elements are no subtrees of their own; a marked one hides nothing but is rare in templates.
                    pass
                else:
                    self._flush()
                    if tag in ENDS_P and (p := self._find(("p",), SCOPE)) >= 0:
                        self._close_to(p)
                    if tag in SAME_LEVEL and (p := self._find(SAME_LEVEL[tag], ("ul", "ol", "dl", "table"))) >= 0:
                        self._close_to(p)
                    if tag not in VOID:
                        self._open(tag, attrs.rstrip("/>"))
            match = _TOKEN.search(source, at)
        self._text(source[at:])
        self._close_to(0)
        self._flush()

    def kept(self) -> list[str]:
        """Blocks that the page may keep."""
        return [t for t, _, article in self.blocks if article or not self.has_article]

    def text(self, recurring) -> str:
        """The main text without the subtrees whose hashes recur (in an article, and outside, by :func:`_own`)."""
        gone = [False] * len(self.hashes)
        for n, (h, outer) in enumerate(zip(self.hashes, self.outer)):
            gone[n] = _own(h, self.inside[n]) in recurring or outer >= 0 and gone[outer]
        return "\n".join(t for t, n, article in self.blocks if (article or not self.has_article) and not (n >= 0 and gone[n]))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _own(h: int, inside: bool) -> int:
    """Subtrees in articles are counted apart: their hashes are made even, others odd."""
    return h & ~1 if inside else h | 1


def page_hashes(pages: DataFrame) -> DataFrame:
    """``(host, key, html)`` -> ``(host, key, content, hs, blocks)``: each distinct page's subtree hashes, and its blocks' hashes and lengths."""

    @F.pandas_udf("content long, hs array<long>, blocks array<struct<b:long,size:long>>")
    def hashes(col: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for source in col:
            page = Page(source or "")
            kept = page.kept()
            sizes: Counter = Counter()
            for t in kept:
                sizes[_signed(xxhash.xxh64_intdigest(t))] += len(t)
            rows.append((_signed(xxhash.xxh64_intdigest("\x1f".join(kept))), sorted({_own(h, i) for h, i in zip(page.hashes, page.inside) if h}),
                         [{"b": b, "size": n} for b, n in sizes.items()]))
        return pd.DataFrame(rows, columns=["content", "hs", "blocks"])

    found = pages.select("host", "key", hashes("html").alias("p")).dropDuplicates(["host", "key"])
    return found.select("host", "key", "p.*")


def voters(found: DataFrame, min_pages: int, min_own: float) -> DataFrame:
    """``(host, content, h)``: subtrees of the contents of which at least ``min_own`` is text that fewer than ``min_pages`` contents of the host hold."""
    contents = found.groupBy("host", "content").agg(F.first("hs").alias("hs"), F.first("blocks").alias("blocks"))
    contents = materialize(contents, "template-contents")
    blocks = contents.select("host", "content", F.inline("blocks"))
    often = blocks.groupBy("host", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "b", F.lit(1).alias("common"))
    own = blocks.join(often, ["host", "b"], "left").groupBy("host", "content").agg(
        F.sum("size").alias("size"), F.sum(F.when(F.col("common").isNull(), F.col("size")).otherwise(0)).alias("own"))
    able = own.where((F.col("own") >= F.col("size") * min_own) & (F.col("own") > 0)).select("host", "content")
    return contents.select("host", "content", "hs").join(able, ["host", "content"]).select("host", "content", F.explode_outer("hs").alias("h"))


def recurring(votes: DataFrame, min_pages: int, min_share: float, article_share: float) -> DataFrame:
    """``(host, h)`` of at least ``min_pages`` voting contents and their share of the host's (a larger one in articles)."""
    counts = votes.where(F.col("h").isNotNull()).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = votes.groupBy("host").agg(F.count_distinct("content").alias("pages"))
    share = F.when(F.col("h") % 2 == 0, article_share).otherwise(min_share)
    return counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * share).select("host", "h")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4,
            min_share: float = 0.02, article_share: float = 0.2, min_own: float = 0.15) -> DataFrame:
    """``(id, url, text, n_chars)`` for every row.

    A subtree is template if it stands on ``min_pages`` voting contents of its
    host and on ``min_share`` of them (``article_share`` in articles). Contents
    vote of which ``min_own`` is on fewer than ``min_pages`` contents of the
    host: pages that share more than 85% of their text are near copies.
    """
    need(pages, (id_col, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("key", F.xxhash64(host_of(F.col("url")), "html"))
    found = materialize(page_hashes(rows.select(host_of(F.col("url")).alias("host"), "key", "html")), "template-pages")
    template = materialize(recurring(voters(found, min_pages, min_own), min_pages, min_share, article_share), "template-recurring")
    trees = found.select("host", "key", F.explode("hs").alias("h"))
    drops = trees.join(template, ["host", "h"]).groupBy("key").agg(F.collect_set("h").alias("drops"))

    @F.pandas_udf("string")
    def main_text(source: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([Page(s or "").text(frozenset(() if d is None else d)) for s, d in zip(source, drop)])

    out = rows.join(drops, "key", "left").select("id", "url", main_text("html", "drops").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
