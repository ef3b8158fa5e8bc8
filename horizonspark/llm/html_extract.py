"""Main text of web pages: site templates found by counting element subtrees per host, and page structure.

Every block element's subtree is hashed from its tags and text. Spark counts on how many pages
of its host, and of its section of the host, each hash occurs; subtrees that recur on many pages with different texts
are template and are deleted (copies of one text, whole or edited, are told apart by least hashes, so they do not make their own
paragraphs template). What HTML itself marks as no part of the article (menus, forms, asides, scripts) goes too, which
is all there is to go by on hosts with few pages. Class and id words are only hints: a box so marked goes if it holds little of the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, text_bytes, unused

#: A subtree on this share of the pages of its host or section, and on so many pages at least, is template.
MIN_SHARE, MIN_PAGES = 0.3, 8
#: A box with more than this share of the text outside menus and the like is no side matter, whatever its class.
SIDE_SHARE = 1 / 3
#: Texts are told apart by the least hashes of their runs of so many words, under each of these factors.
RUN, FACTORS = 5, np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Up to so many hashes of templates are broadcast (with their host's name); more are joined by a shuffle.
BROADCAST_HASHES = 500_000
#: Pages of one section that a task of that shuffle gets.
PAGES_A_TASK = 20_000

RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript template iframe head nav footer aside button select input label fieldset dialog menu object embed svg canvas audio video map noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Never template by themselves; nor are, within an article, what only names its parts.
WHOLE = frozenset("html body article main".split())
NAMES = frozenset("h1 h2 h3 h4 h5 h6 th dt td caption figcaption".split())
PROSE = NAMES | frozenset("p li dd pre blockquote".split())
#: Words of classes and ids. Adverts and comments go whatever their size; other boxes only if small.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split())
COMMENTS = frozenset("comment comments disqus replies".split())
MARKS = frozenset("banner promo notice notices popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended widget toolbar pagination pager skip login search".split())
#: A name with one of these says what a page is like, not what the box is (no-comments, has-sidebar, search-results-page).
ABOUT = frozenset("no not non has have with without is page layout results".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog menu menubar toolbar".split())
#: Open elements that stray end tags of inline elements, paragraphs and items do not close.
WALLS = frozenset("article main body td table".split())
CLOSED_BY = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer main form blockquote pre figure hr address details fieldset".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]|=\s*(?:\"[^\"]*\"|'[^']*'|))*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CUT_OFF = re.compile(r"<[a-zA-Z/][^<>]*\Z")
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW}
#: Why an element may go: it does, it does if small, it does unless the page's main element is in it.
GOES, IF_SMALL, UNLESS_MAIN = 1, 2, 3


class Element:
    """size and linked are the characters of text in it and in its links; hash is None for elements that are never template."""

    __slots__ = ("tag", "inside", "parent", "mark", "dropped", "in_article", "size", "linked", "has_main", "hash")

    def __init__(self, tag: str, parent: Element | None, mark: int):
        self.tag, self.parent, self.mark, self.inside = tag, parent, mark, []
        self.in_article = parent is not None and (parent.in_article or tag in ("article", "main"))
        self.size = self.linked = 0
        self.has_main, self.dropped, self.hash = tag == "main", False, None


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    if tag in DROPPED or tag == "header" and not in_article:
        return GOES
    out = IF_SMALL if tag == "form" else 0
    if not attributes or tag in WHOLE:
        return out
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for token in value.split():
                words = _SPLIT.split(token)
                if not ABOUT.isdisjoint(words):
                    continue
                if not ADVERTS.isdisjoint(words):
                    return UNLESS_MAIN
                if in_article and tag in PROSE:
                    continue
                if not COMMENTS.isdisjoint(words):
                    return UNLESS_MAIN
                if not MARKS.isdisjoint(words):
                    out = IF_SMALL
        elif name == "role" and value.strip() in ROLES:
            return UNLESS_MAIN
        elif name == "role" and value.strip() in ("form", "alert"):
            out = IF_SMALL
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return GOES
    return out


class _Open:
    """The open elements: each operation costs as much as what it opens or closes."""

    def __init__(self, root: Element):
        self.stack, self.by_tag, self.blocks, self.walls = [root], {}, [], []

    def push(self, e: Element) -> None:
        n = len(self.stack)
        self.stack.append(e)
        self.by_tag.setdefault(e.tag, []).append(n)
        if e.tag not in INLINE:
            self.blocks.append(n)
        if e.tag in WALLS:
            self.walls.append(n)

    def cut(self, n: int) -> None:
        while len(self.stack) > n:
            e = self.stack.pop()
            self.by_tag[e.tag].pop()
            if e.tag not in INLINE:
                self.blocks.pop()
            if e.tag in WALLS:
                self.walls.pop()

    def close(self, tag: str) -> None:
        at = self.by_tag.get(tag)
        if at and not ((tag in INLINE or tag in ("p", "li")) and self.walls and self.walls[-1] > at[-1]):
            self.cut(at[-1])

    def make_room(self, tag: str) -> None:
        while self.blocks and tag in CLOSED_BY.get(self.stack[self.blocks[-1]].tag, ()):
            self.cut(self.blocks[-1])


def parse(page: str) -> Element:
    """The page's element tree; inside holds text and elements in page order. Unclosed and stray tags are taken as browsers take them, nearly. Time is linear in the page."""
    root = Element("", None, 0)
    every = [root]
    open_ = _Open(root)
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            open_.stack[-1].inside.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            open_.close(tag)
            continue
        open_.make_room(tag)
        parent = open_.stack[-1]
        e = Element(tag, parent, _mark(tag, m[3], parent.in_article))
        parent.inside.append(e)
        every.append(e)
        if tag in RAW:
            at = _RAW_END[tag].search(page, at).end()
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in ("p", "div", "a", "span"):
            open_.push(e)
    if at < len(page):
        open_.stack[-1].inside.append(html.unescape(_CUT_OFF.sub("", page[at:])))
    _settle(every)
    return root


def _settle(every: list[Element]) -> None:
    """Sizes, hashes and what goes; elements come after those that hold them."""
    kept: dict[int, bytes] = {}
    side = 0
    for e in reversed(every):
        parts = [e.tag.encode()]
        for x in e.inside:
            if not isinstance(x, Element):
                if s := " ".join(x.split()):
                    parts.append(s.encode("utf-8", "surrogatepass"))
                    e.size += len(s)
            else:
                parts.append(kept.pop(id(x)))
                e.size += x.size
                e.linked += x.linked
                e.has_main |= x.has_main
        if e.tag == "a":
            e.linked = e.size
        digest = kept[id(e)] = xxhash.xxh64_digest(b"\x00".join(parts))
        if e.size and e.tag and e.tag not in INLINE and e.tag not in WHOLE and not (e.in_article and e.tag in NAMES):
            e.hash = int.from_bytes(digest, "big", signed=True)
    for e in every[1:]:
        if e.mark == GOES:
            if not e.parent.dropped:
                side += e.size
            e.dropped = True
        else:
            e.dropped = e.parent.dropped
    most = (every[0].size - side) * SIDE_SHARE
    for e in every[1:]:
        e.dropped |= e.parent.dropped or e.mark == UNLESS_MAIN and not e.has_main or e.mark == IF_SMALL and not e.has_main and e.size <= most


def elements(root: Element) -> Iterator[Element]:
    """All elements below the root, those that hold others first."""
    todo = [root]
    while todo:
        e = todo.pop()
        for x in e.inside:
            if isinstance(x, Element):
                yield x
                todo.append(x)


def subtree_hashes(root: Element) -> dict[int, bool]:
    """Hash of the tags and text of each block element with text that may be template -> whether it stands where it isn't dropped anyway."""
    out: dict[int, bool] = {}
    for e in elements(root):
        if e.hash is not None:
            out[e.hash] = out.get(e.hash, False) or not e.dropped
    return out


def _tops(root: Element, wanted: str, gone: set[int]) -> list[Element]:
    """The outermost elements of that tag in page order, with the headings (h1) that stand in the main element or beside an article."""
    found: list[Element] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.dropped or e.hash in gone:
            continue
        if e.tag == wanted or wanted == "article" and e.tag == "h1":
            found.append(e)
        else:
            todo += [x for x in reversed(e.inside) if isinstance(x, Element)]
    if wanted == "article":
        beside = {id(e.parent) for e in found if e.tag == "article"}
        found = [e for e in found if e.tag == "article" or e.in_article or id(e.parent) in beside] if beside else []
    return found


def main_text(root: Element, gone: set[int]) -> str:
    """Text of the article elements, else of the main element, else of the whole page, without dropped elements and those whose hash is in gone.

    Article elements with less than a third of the main element's text are only parts of it (cards, teasers).
    """
    mains = _tops(root, "main", gone)
    tops = _tops(root, "article", gone)
    if mains and sum(e.size for e in tops) < SIDE_SHARE * sum(e.size for e in mains):
        tops = mains
    tops = tops or mains or [root]
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    stack: list = list(reversed(tops))
    while stack:
        x = stack.pop()
        if x is None:
            end_block()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.dropped or x.hash in gone or x.tag in ("ul", "ol") and not x.in_article and 0 < x.size == x.linked:  # a list of links is a menu
            if x.tag not in INLINE:
                end_block()
        elif x.tag in INLINE:
            stack += reversed(x.inside)
        else:
            end_block()
            stack.append(None)
            stack += reversed(x.inside)
    end_block()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; empty for null or if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def section_of(url: Column) -> Column:
    """The first folder of the path; empty if the path has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)


def _decode(page: bytes) -> str:
    return page.decode("utf-8", "replace")


def _parts(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield list(zip(*(part.column(i).to_pylist() for i in range(columns)), strict=True))


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, 3):
        rows = [(host, section, h, shown) for host, section, page in part for h, shown in subtree_hashes(parse(_decode(page))).items()]
        yield _batch(rows, "host section subtree shown", [pa.string(), pa.string(), pa.int64(), pa.bool_()])


def text_marks(text: str) -> list[int]:
    """The least hashes of a text's runs of words: mostly the same for edited copies, different for different texts."""
    words = text.split()
    runs = [xxhash.xxh64_intdigest(" ".join(words[i : i + RUN]).encode("utf-8", "replace")) for i in range(max(1, len(words) - RUN + 1))]
    return (np.array(runs, dtype=np.uint64)[:, None] * FACTORS).min(axis=0).view(np.int64).tolist()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of each page's text, for the page (subtree null) and for each of its candidate subtrees."""
    for part in _parts(batches, 4):
        rows: list[tuple] = []
        for host, section, wanted, page in part:
            root = parse(_decode(page))
            held = set(subtree_hashes(root)) & set(wanted)
            marks = text_marks(main_text(root, set()))
            rows += [(host, section, h, k, m) for h in (None, *held) for k, m in enumerate(marks)]
        yield _batch(rows, "host section subtree k mark", [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()])


def _by_level(rows: DataFrame) -> DataFrame:
    """Each row for its whole host (level empty) and for its section."""
    return rows.withColumn("level", F.explode(F.array_distinct(F.array(F.lit(""), F.col("section")))))


def _frequent(counts: DataFrame, sizes: DataFrame, min_share: float, min_pages: int) -> DataFrame:
    return counts.where(F.col("n") >= min_pages).join(sizes, ["host", "level"]).where(F.col("n") >= F.col("n_pages") * min_share)


def _lists(found: DataFrame, sections: DataFrame) -> DataFrame:
    """(host, section, subtrees, n_pages) from (host, level, subtree): what holds for the pages of each section."""
    of_host = found.where("level = ''").join(sections.select("host", "section"), "host")
    both = of_host.select("host", "section", "subtree").union(found.where("level <> ''").select("host", F.col("level").alias("section"), "subtree"))
    return both.groupBy("host", "section").agg(F.collect_set("subtree").alias("subtrees")).join(sections, ["host", "section"])


def _joined(rows: DataFrame, lists: DataFrame, how: str, broadcast_hashes: int, names: tuple[str, str, str]) -> DataFrame:
    """rows with the subtrees of their (host, section): broadcast if few, else by a shuffle in which a large section's pages are dealt to several tasks."""
    host, section, subtrees = names
    few = (lists.agg(F.sum(F.size("subtrees"))).first()[0] or 0) <= broadcast_hashes
    lists = lists.select(F.col("host").alias(host), F.col("section").alias(section), F.col("subtrees").alias(subtrees), F.ceil(F.col("n_pages") / PAGES_A_TASK).cast("int").alias("_tasks"))
    if few:
        return rows.join(F.broadcast(lists.drop("_tasks")), [host, section], how)
    tasks = lists.agg(F.max("_tasks")).first()[0]
    large = lists.where("_tasks > 1").select(host, section, "_tasks")
    dealt = rows.join(F.broadcast(large), [host, section], "left") if tasks > 1 else rows.withColumn("_tasks", F.lit(1))
    dealt = dealt.withColumn("_task", F.pmod(F.monotonically_increasing_id(), F.coalesce("_tasks", F.lit(1))).cast("int")).drop("_tasks")
    copies = lists.withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_tasks")
    return dealt.join(copies, [host, section, "_task"], how).drop("_task")


def site_templates(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(host, section, subtrees, n_pages): hashes of the subtrees on min_share of the pages of the host, or of the section, and on min_pages at least.

    Those that page structure does not drop anyway must recur with as many different texts (of the pages' main text).
    Equal pages and repeated rows count as pages, but as one text. A page holds few subtrees, so a section's list is short: not longer than twice
    the mean number of subtrees a page over min_share. Pages whose URL names no host share no template; null pages have no subtrees.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    rows = pages.select(host_of(F.col(url_col)).alias("host"), section_of(F.col(url_col)).alias("section"), text_bytes(html_col).alias("html")).where("host <> ''")
    sections = scratch.save(rows.groupBy("host", "section").agg(F.count("*").alias("n_pages")))
    sizes = _by_level(sections).groupBy("host", "level").agg(F.sum("n_pages").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    hashed = rows.mapInArrow(_hashes, "host string, section string, subtree bigint, shown boolean").groupBy("host", "section", "subtree").agg(F.count("*").alias("n"), F.max("shown").alias("shown"))
    counts = _by_level(hashed).groupBy("host", "level", "subtree").agg(F.sum("n").alias("n"), F.max("shown").alias("shown"))
    found = scratch.save(_frequent(counts, sizes, min_share, min_pages).select("host", "level", "subtree", "shown"))
    wanted = scratch.save(_lists(found.where("shown"), sections))
    asked = _joined(rows, wanted, "inner", broadcast_hashes, ("host", "section", "subtrees")).select("host", "section", "subtrees", "html")
    marks = asked.mapInArrow(_marks, "host string, section string, subtree bigint, k int, mark bigint").distinct()
    texts = _by_level(marks).select("host", "level", "subtree", "k", "mark").distinct().groupBy("host", "level", "subtree", "k").agg(F.count("*").alias("n"))
    texts = scratch.save(texts.groupBy("host", "level", "subtree").agg(F.max("n").alias("n")))
    all_texts = texts.where("subtree is null").select("host", "level", F.col("n").alias("n_pages"))
    confirmed = _frequent(texts.where("subtree is not null"), all_texts, min_share, min_pages).join(found.where("shown").select("host", "level", "subtree"), ["host", "level", "subtree"], "left_semi")
    both = found.where("not shown").select("host", "level", "subtree").unionByName(confirmed.select("host", "level", "subtree"))
    return _lists(both, sections)


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """All columns of pages plus main_text (replaced if there is one): empty if the page has none.

    Null pages are empty; null or odd URLs belong to no host. Whole pages are read; repeated pages are a row each.
    """
    scratch = Scratch(pages.sparkSession, "html")
    kept = [c for c in pages.columns if c.lower() != "main_text"]
    host, section, subtrees = names = tuple(unused(pages, x) for x in ("_host", "_section", "_subtrees"))
    templates = scratch.save(site_templates(pages, html_col, url_col, min_share, min_pages, broadcast_hashes))
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url_col)).alias(host), section_of(F.col(url_col)).alias(section))
    rows = _joined(rows, templates, "left", broadcast_hashes, names)

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, found in batches:
            out = [main_text(parse(_decode(p)), set() if s is None else set(map(int, s))) for p, s in zip(page, found, strict=True)]
            yield pd.Series([t.encode("utf-8", "replace").decode() for t in out], dtype="object")

    return rows.select(*[F.col(f"`{c}`") for c in kept], text(text_bytes(html_col), F.col(subtrees)).alias("main_text"))
