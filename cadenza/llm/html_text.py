"""Main text of web pages, with what a site repeats on its pages taken out.

A page is read into elements. Menus, forms, adverts and the like are known by
their tags, roles and classes. What is left of a site's frame is known by its
recurring: each element is hashed with all it contains, the hashes of those
outside the article's own paragraphs are counted per host, and per section of it
(host with the first and first two parts of the path), over pages of different
text; subtrees that many of them have are deleted from the pages of that host or
section, wherever they stand. Copies of a page count once, so a group of copies
does not make its text a template; a frame that only a section has is judged by
the section's pages, however large the host.

Pages are parsed twice, once to count and once to extract, so that no page is
shuffled or stored: only hashes are, and what recurs is looked up per section.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.joins import lookup
from cadenza.session import staged

#: A subtree recurs if it is on this many different pages of a host or section and on this share of them.
PAGES = 5
SHARE = 0.2
#: Sections are the first parts of the path, up to so many.
SECTIONS = 2

# Fixed values of HTML: elements without content, of raw text, and that end a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section summary table ul".split()
)
# Elements that end an open one of the named kinds within the nearest of the scopes.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
FRAME_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object canvas audio video xmp noembed noframes title".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "disqus reply replies related recommended share sharing social popup modal overlay pagination toolbar widget".split()
)
CONTENT = frozenset(("html", "body", "article", "main"))
#: Elements of running text: in an article these are the article's own, however often a site repeats them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span blockquote pre code q cite li ul ol dl dt dd sub sup small mark u s figure figcaption table tbody thead tr td th".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


#: What tells a frame: nothing, a class or id (which an article or main inside refutes), or more than that.
NO, BY_WORD, FRAME = range(3)


def _is_frame(tag: str, attributes: str, in_article: bool) -> int:
    if tag in FRAME_TAGS or (tag == "header" and not in_article):
        return FRAME
    if not attributes.strip() or tag in ("html", "body", "main"):
        return NO
    named = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in named or named.get("role", "").lower() in FRAME_ROLES:
        return FRAME
    names = f"{named.get('class', '')} {named.get('id', '')}".lower()
    if tag == "article":  # one inside another may be a comment, by a whole name
        return BY_WORD if in_article and any(w in FRAME_WORDS for w in names.split()) else NO
    return BY_WORD if any(w in FRAME_WORDS for w in _WORDS.findall(names)) else NO


class _Element:
    __slots__ = ("tag", "frame", "worded", "article", "main", "mark", "number")

    def __init__(self, tag: str, frame: bool, worded: int, article: bool, main: bool, mark, number: int):
        self.tag, self.frame, self.worded, self.article, self.main, self.mark, self.number = tag, frame, worded, article, main, mark, number


def page_parts(page: str) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """Text parts with the hashes of the subtrees around each, and all subtree hashes of the page."""
    stack = [_Element("", False, 0, False, False, hashlib.blake2b(digest_size=8), -1)]
    hashes: list[int] = []  # of candidates, by number
    # Text, candidates around it, 2 in an article or 1 in main, and the nearest frame by word around it (0: none).
    parts: list[tuple[str, tuple[int, ...], int, int]] = []
    refuted: list[bool] = [True]  # of frames by word, by number: an article or main was found inside
    within: list[int] = [0]  # of frames by word, by number: the nearest one around

    def close() -> None:
        own = stack.pop()
        digest = own.mark.digest()
        stack[-1].mark.update(digest)
        if own.number >= 0:
            hashes[own.number] = int.from_bytes(digest, "big", signed=True)

    def put(text: str) -> None:
        top = stack[-1]
        top.mark.update(" ".join(text.split()).encode("utf-8", "replace"))
        if not top.frame:
            around = tuple(e.number for e in stack if e.number >= 0)
            parts.append((text, around, 2 if top.article else 1 if top.main else 0, top.worded))

    def end(tags: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in scopes:
                return

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            put(html.unescape(page[at:]))
            break
        if m.start() > at:
            put(html.unescape(page[at : m.start()]))
        at = m.end()
        if opened := m[1] or m[3]:
            tag, attributes = opened.lower(), (m[2] if m[1] else m[4]) or ""
            if tag in CLOSES_P:
                end(("p",), ("article", "main", "body", "div", "section", "td", "th", "li", "table", "button"))
            if tag in ENDS:
                end(*ENDS[tag])
            if tag in BLOCK:
                put("\n")
            if tag in VOID:
                continue
            top = stack[-1]
            kind = FRAME if top.frame else _is_frame(tag, attributes, top.article)
            frame, worded = kind == FRAME, top.worded
            if kind == BY_WORD:
                within.append(worded)
                worded = len(refuted)
                refuted.append(False)
            if not frame and (tag == "main" or (tag == "article" and not top.article)):
                around = worded
                while not refuted[around]:
                    refuted[around], around = True, within[around]
            inside = top.article or tag == "article"
            mark, number = hashlib.blake2b(tag.encode("utf-8", "replace"), digest_size=8), -1
            if tag not in CONTENT and not (inside and tag in TEXT):
                number = len(hashes)
                hashes.append(0)
            stack.append(_Element(tag, frame, worded, inside and not frame, top.main or tag == "main", mark, number))
            if tag in RAW and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                stack[-1].frame = True
                put(page[at : stop.start() if stop else len(page)])
                close()
                at = stop.end() if stop else len(page)
        elif m[5]:
            tag = m[5].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag == "article":  # what was opened outside an article ends outside
                    if tag not in ("body", "html", "main"):
                        break
            if tag in BLOCK:
                put("\n")
    while len(stack) > 1:
        close()
    for number in range(1, len(refuted)):  # a frame by word that another one holds is in a frame
        refuted[number] = refuted[number] and refuted[within[number]]
    parts = [p for p in parts if refuted[p[3]]]
    level = max((p[2] for p in parts if p[0].strip()), default=0)
    kept: list[tuple[str, list[int]]] = []
    for text, around, where, _ in parts:
        if where < level:
            continue
        own = [hashes[k] for k in around]
        if kept and kept[-1][1] == own:
            kept[-1] = (kept[-1][0] + text, own)
        else:
            kept.append((text, own))
    return [(t, h) for t, h in kept if t], sorted(set(hashes))


def _page_hash(parts: list[tuple[str, list[int]]]) -> int:
    """Of a page's text outside frames: the same for copies, whatever their frames."""
    text = " ".join("".join(t for t, _ in parts).split())
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sites of each page, and the hash of each of its subtrees, or null for the page itself, with that of the page."""
    for batch in batches:
        for at in range(0, len(batch), 200):  # few pages at a time
            sites, pages = (batch.column(k).slice(at, 200) for k in (0, 1))
            found = [(own, _page_hash(parts)) for parts, own in (page_parts(page.as_py() or "") for page in pages)]
            which = [k for k, (own, _) in enumerate(found) for _ in range(len(own) + 1)]
            subtrees = [h for own, _ in found for h in (None, *own)]
            yield pa.RecordBatch.from_arrays([sites.take(pa.array(which, pa.int64())), pa.array(subtrees, pa.int64()), pa.array([found[k][1] for k in which], pa.int64())], ["sites", "subtree", "page"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page without the parts inside subtrees that are `gone`."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            some = batch.slice(at, 200)
            texts = []
            for page, *gone in zip(*(some.column(k) for k in range(2, some.num_columns)), strict=True):
                out = {h for one in gone for h in one.as_py() or ()}
                parts = page_parts(page.as_py() or "")[0]
                texts.append(" ".join("".join(t if out.isdisjoint(around) else "\n" for t, around in parts).split()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    The text is that of the page's articles; of its main element where there is
    no article with text, of its body where there is neither. A null or empty
    page has an empty text. Pages whose url is null or has no host are one site.
    Null ids and repeated rows are rows like any other, but pages of one text
    count once where recurring subtrees are counted. An empty table gives an
    empty result.
    """
    url = F.col(url_column).cast("string")
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    folders = F.filter(F.regexp_extract_all(path, F.lit("([^/]*)/")), lambda part: part != "")  # not the last part, the page's own
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), url.alias("url"), F.col(html_column).alias("html"), host.alias("host"), folders.alias("folders"))
    site = [F.xxhash64("host", F.slice("folders", 1, n)) if n else F.xxhash64("host") for n in range(SECTIONS + 1)]
    sites = F.array_compact(F.array(*[F.when(F.size("folders") >= n, key) for n, key in enumerate(site)]))
    each = rows.select(sites.alias("sites"), "html").mapInArrow(_subtrees, "sites array<long>, subtree long, page long")
    pairs = each.select(F.explode("sites").alias("site"), "subtree", "page").distinct()
    counts = staged(pairs.groupBy("site", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGES))
    of_site = counts.where("subtree is null").select("site", F.col("n").alias("pages"))
    many = counts.where("subtree is not null").join(of_site, "site").where(F.col("n") >= SHARE * F.col("pages"))
    # At most 1 / SHARE times a page's mean number of elements per site; broadcast only if it measures small.
    recurring = lookup(many.groupBy("site").agg(F.collect_list("subtree").alias("gone")), row_bytes=64 + 8 * F.size("gone"))
    cut = rows
    for n, key in enumerate(site):
        own = recurring.select(F.col("site").alias(f"site{n}"), F.col("gone").alias(f"gone{n}"))
        cut = cut.withColumn("key", F.when(F.size("folders") >= n, key)).join(own, F.col("key") == F.col(f"site{n}"), "left")
    cut = cut.select("page_id", "url", "html", *[f"gone{n}" for n in range(len(site))])
    return cut.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
