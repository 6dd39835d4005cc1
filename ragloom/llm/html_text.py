"""Main text of web pages by line-block distribution.

The markup is stripped into lines, one for each block of the page; a line's
length is its number of characters, or 0 where it stands in a menu, header,
footer, sidebar, notice, advert, form or comment section, or is all links.
Lengths are summed over windows of BLOCK_LINES lines. Text starts at a surge,
where the sums leave zero and reach the threshold before they fall back, and
ends at the dive, where they return to zero; all lines with length between
the two are kept. An article or main element is evidence only: the surge
text outside all of them is weighed against the characters of each. If none
holds as much as the outside, the page's text is the outside, with those
articles that are no mere teasers beside it. Else all articles are text, to
the last line, and the outside is text too if its surges are no mere remnant.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import prepare

BLOCK_LINES = 3
#: Characters that a window must hold for a surge on pages that mark no article.
SURGE = 80
#: An article is a teaser, or the text outside articles a remnant, below this share of the other's characters.
TEASER_SHARE = 0.25
#: A class name or id that stands over more than this share of the text, and over a surge of it, is one of the layout.
#: Comments may be longer than what they are about, so their names need more.
LAYOUT_SHARE = 0.5
COMMENT_SHARE = 0.9
#: Share of link text from which a line outside a marked article counts as a menu.
LINK_SHARE = 0.8

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+>"
    r"|<[a-zA-Z/!?][^<>]*+\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "math", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
           "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
           "sup", "time", "tt", "u", "var", "wbr", "br"}
_OUTSIDE = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset"}
_ARTICLE = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation",
          "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "cookie", "cookies", "consent", "gdpr", "notice",
          "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related",
          "recommended", "comment", "comments", "reply", "replies", "disqus", "widget", "toolbar", "pagination", "pager"}
_COMMENTS = {"comment", "comments", "reply", "replies", "disqus"}
#: Page headers; inside an article a header holds its title.
_HEADER_NAMES = {"header", "masthead", "banner", "topbar"}
#: On the article element itself only these names speak against it.
_NOT_ARTICLE = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "comment", "comments", "reply", "replies"}


def _evidence(tag: str, attributes: str, in_article: bool) -> tuple[bool, set[str]]:
    """Whether the element's tag or role marks what is no main text, and those of its class names and ids that may."""
    if tag in _OUTSIDE or tag == "header" and not in_article:
        return True, set()
    names: set[str] = set()
    if "=" not in attributes or tag in ("html", "body"):
        return False, names
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "role":
            if value.strip() in _ROLES and tag not in _ARTICLE:
                return True, set()
        elif name in ("class", "id"):
            for token in value.split():
                words = set(re.split(r"[^a-z]+", token))
                if words & _NOT_ARTICLE if tag in _ARTICLE else words & _NAMES or not in_article and words & _HEADER_NAMES:
                    names.add(token)
    return False, names


def lines_of(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, number of the outermost article or 0, in a part that is no main text, characters inside links) of every block.

    A tag or role says of its element that it is no main text. A class name
    or id only suspects: one that stands over most of the page's text is a
    name of the layout and says nothing.
    """
    found: list[tuple[str, int, bool, frozenset[str], int]] = []
    stack: list[tuple[str, bool, frozenset[str], int, bool]] = []  # tag, speaks against, suspicious names, in article, in link
    text: list[str] = []
    linked: list[str] = []
    against = in_link = False
    suspects: frozenset[str] = frozenset()
    in_article = articles = 0

    def end_line() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                found.append((joined, in_article, against, suspects, len(" ".join(entities.unescape("".join(linked)).split()))))
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if in_link:
            linked.append(piece)

    def pop_to(k: int) -> None:
        nonlocal against, suspects, in_article, in_link
        del stack[k:]
        _, against, suspects, in_article, in_link = stack[-1] if stack else ("", False, frozenset(), 0, False)

    at = 0
    while m := _MARKUP.search(html, at):
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag not in _INLINE
        if block:
            end_line()
        elif tag == "br":
            add(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if not block and stack[k][0] not in _INLINE:
                    break  # a stray inline end tag closes no block
        elif tag in _RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
        elif tag not in _VOID and not m[3].endswith("/"):
            if block:  # an open paragraph, or an item of the same list, ends here
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        pop_to(k)
                        break
                    if stack[k][0] not in _INLINE:
                        break
            if tag == "body":  # a head that was never closed ends
                pop_to(next((k for k, x in enumerate(stack) if x[0] == "head"), len(stack)))
            sure, names = _evidence(tag, m[3], bool(in_article))
            against, suspects = against or sure, suspects | names if names else suspects
            if not in_article and tag in _ARTICLE and not against:
                in_article = articles = articles + 1
            in_link = in_link or tag == "a"
            stack.append((tag, against, suspects, in_article, in_link))
    if at < len(html):
        add(html[at:])
    end_line()
    return _cleared(found)


def _cleared(found: list[tuple[str, int, bool, frozenset[str], int]]) -> list[tuple[str, int, bool, int]]:
    """Lines with the suspicious names judged by how much of the page's text they stand over."""
    under: dict[str, int] = {}
    for line, _, against, names, _ in found:
        for name in names if not against else ():
            under[name] = under.get(name, 0) + len(line)
    whole = sum(len(line) for line, _, against, _, _ in found if not against)
    guilty = {name for name, n in under.items()
              if n <= max(SURGE, whole * (COMMENT_SHARE if set(re.split(r"[^a-z]+", name)) & _COMMENTS else LAYOUT_SHARE))}
    return [(line, article, against or not guilty.isdisjoint(names), link) for line, article, against, names, link in found]


def kept_lines(lengths: list[int], threshold: int, window: int = BLOCK_LINES) -> Iterator[int]:
    """Positions with length between a surge and the dive that follows it."""
    n = len(lengths)
    run: list[int] = []
    peak = 0
    total = sum(lengths[:window])
    for i in range(n + 1):  # total: characters on lines i to i + window - 1
        if i < n and total > 0:
            peak = max(peak, total)
            if lengths[i]:
                run.append(i)
        elif run:
            if peak >= threshold:
                yield from run
            run, peak = [], 0
        if i < n:
            total += (lengths[i + window] if i + window < n else 0) - lengths[i]


def main_text(html: str | None, surge: int = SURGE) -> str:
    """The article's blocks, one a line; empty for null or blank pages."""
    lines = lines_of(html or "")
    lengths = [0 if against or not article and link >= LINK_SHARE * len(t) else len(t) for t, article, against, link in lines]
    articles: dict[int, int] = {}
    for (_, article, _, _), n in zip(lines, lengths):
        if article and n:
            articles[article] = articles.get(article, 0) + n
    if articles:
        outside = [0 if line[1] else n for line, n in zip(lines, lengths)]
        loose = sum(outside[i] for i in kept_lines(outside, surge))
        if loose > max(articles.values()):
            chosen = {0} | {a for a, n in articles.items() if n >= TEASER_SHARE * loose}
        else:
            chosen = set(articles) | ({0} if loose and loose >= TEASER_SHARE * sum(articles.values()) else set())
        lengths = [n if line[1] in chosen else 0 for line, n in zip(lines, lengths)]
    sums = [sum(lengths[i:i + BLOCK_LINES]) for i in range(len(lengths))]
    kept = set(kept_lines(lengths, min(surge, max(sums, default=0))))
    return "\n".join(line[0] for i, (line, n) in enumerate(zip(lines, lengths)) if i in kept or line[1] and n)


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out`` (replaced if it exists).

    Null and empty html give an empty text, an empty table none. All rows,
    repeated ones too, and other columns stay; no shuffle; a page of any
    length is handled whole, one at a time.
    """
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return pages.withColumn(out, extract(F.col(html)))
