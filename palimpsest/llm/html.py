"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one per block. Lines where the markup says that they are no article text (menus, footers,
forms, adverts, comments and the like) are empty. With an article element of some length all of its text is kept, links too. Without
one a line weighs its text outside links, weights are summed over windows of lines, and text is kept from the point where
the sums surge to the point where they dive to nothing: once over all lines, and once without the empty lines that only
nested tags make, so that a title or a short block in an element of its own stays with its neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text

WINDOW = 3
#: Without an article element a surge takes this many characters in a window, or half the fullest window if less.
SURGE = 86

_BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("nav header footer aside form menu dialog button select fieldset head object canvas svg audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of a class or id that mark what is no article text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adsbox adsense sponsor sponsored promo promoted promotion banner sidebar menu nav navbar navigation navi breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchbox share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond disqus discussion reader readers widget toolbar pagination pager copyright disclaimer skip hidden".split()
)
#: Words that say nothing about what a block is. A name marks a block if all its words are of these two kinds: "ad-slot"
#: and "site-footer" do, "article-header", "related-work" and "share-prices" don't.
_PLAIN = frozenset(
    "area bar block blocks body bottom box btn button buttons card center class clearfix col column columns container content contents count cta desktop div down element fixed float frame full global grid group hd icon icons id image "
    "in inner item items js large layout left line link links list lists lg main md mid middle mobile module more new of on outer page pages panel placeholder pos position post posts primary rail right row secondary section sections show site size "
    "slot sm small sticky stories story strip tag text the thread title toggle top txt ui unit up view wrap wrapper x xs your you us our a an and by for from to with".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies disqus".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp)\b[^>]*(?:>.*?(?:</(?P=raw)[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _no_article(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _SKIPPED and not (tag == "header" and in_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and value:
            for own in value.split():
                words = {w.lower() for w in _CAMEL.findall(own)}
                if words & (_COMMENTS if tag == "article" else _NAMES) and words <= _NAMES | _PLAIN:
                    return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters outside links, inside an article or main element, heading, a block of its own without any text) of
    each block, in page order; blocks that are no article text have an empty text."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, no article text, inside an article, inside a link
    off = inside = link = False
    linked = 0
    opened = ""  # the block tag before, if it opened a block

    def flush(closed: str = "") -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        out.append((text, max(0, len(text) - linked), inside, any(s[0] in _HEADINGS for s in stack[-8:]), bool(closed) and not text and closed == opened))
        parts.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not off:
            piece = page[at : m.start()]
            parts.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            flush(tag if m["close"] else "")
            opened = "" if m["close"] else tag
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    off, inside, link = stack[-1][1:] if stack else (False, False, False)
                    break
        elif tag not in _VOID and not m["attrs"].endswith("/"):
            if tag in ("article", "main") and off and not any(s[0] in ("article", "main") for s in stack):
                off = False  # an element before the article that was never closed
            off = off or _no_article(tag, m["attrs"], inside)
            inside = inside or (tag in ("article", "main") and not off)
            link = link or tag == "a"
            stack.append((tag, off, inside, link))
    if at < len(page) and not off:
        parts.append(page[at:])
    flush()
    return out


def _regions(weight: list[int]) -> list[tuple[int, int]]:
    """(from, to) of the lines kept: windows from a surge to the dive."""
    sums, total = [], sum(weight[:WINDOW])
    for i in range(len(weight)):
        sums.append(total)
        total += (weight[i + WINDOW] if i + WINDOW < len(weight) else 0) - weight[i]
    surge = min(SURGE, max(1, (max(sums, default=0) + 1) // 2))
    out = []
    i = 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        dive = i
        while dive < len(sums) and sums[dive] > 0:
            dive += 1
        # A window that surges starts up to WINDOW - 1 empty lines early; they add nothing.
        out.append((i, min(len(weight), dive + WINDOW - 1)))
        i = dive + WINDOW - 1
    return out


def extract(page: str | None) -> str:
    """The main text: blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    found = lines(page)
    marked, outside = (sum(len(text) for text, _, inside, _, _ in found if inside is where) for where in (True, False))
    # An element with a word or two in it, on a page with text elsewhere, isn't the article.
    if marked >= SURGE or marked and marked >= outside:
        return " ".join(text for text, _, inside, _, _ in found if text and inside)
    kept = {k for i, j in _regions([n for _, n, _, _, _ in found]) for k in range(i, j)}
    full = [k for k, (text, _, _, _, empty) in enumerate(found) if text or empty]
    for i, j in _regions([found[k][1] for k in full]):
        # Links at the ends of a region are no part of it, but for a heading.
        while i < j and not found[full[i]][1] and not found[full[i]][3]:
            i += 1
        while i < j and not found[full[j - 1]][1]:
            j -= 1
        kept.update(full[i:j])
    return " ".join(found[k][0] for k in sorted(kept) if found[k][0])


def main_text(page: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(as_text(x)) for x in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(page.cast("binary"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row, repeated ones too; a null page has an empty text, an empty table gives none.

    Pages are read whole, very long ones too, in time proportional to their length. Bytes that aren't UTF-8 are read as
    U+FFFD. Null ids and urls stay. A row's result is made from that row alone; other columns are not read, whatever
    they are called.
    """
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("long"))
