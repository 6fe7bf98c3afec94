"""Main text of web pages by composite text density.

The page becomes a tree. For every node: characters a tag, adjusted by the share of link
text in it and on the page; the sum over the blocks below a block is its density sum. The
subtree of the largest sum is content; the least density on its path up to the body is the
threshold, and below every other node that reaches it, the subtree of the largest sum is
content too. Where such parts stand apart, the least node that holds them all is content,
but for what in it is mostly links. Inline elements count as tags and belong to their block.

What is named as menu, header, footer, side bar, notice, advert, form or reader comments, by
element, role, class or id, counts in all densities and sums to none: it is no content.
Scripts, styles and what is hidden are no part of the tree. A class or id counts as a whole:
'cookie-notice' names a notice, 'has-sidebar' no side bar. What a name or a form would take
out stays if it holds an article or main element, or most of the page's text where no such
element lies elsewhere; where nothing is left, the page is read without regard to names.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.llm.batches import udf_of_lists

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title script style noscript template iframe object svg canvas select option textarea input map audio video".split())
#: Elements that are no content whatever they hold.
ASIDE = frozenset("nav footer aside button dialog menu".split())
#: Share of link text from which a part between contents is a menu.
MOSTLY_LINKS = 0.5
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words of classes and ids that name what is not the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup paywall sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright comment comments commentary discussion disqus replies reply respond related recommended share sharing social widget pagination pager toolbar login".split()
)
COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
#: Words that may stand beside those of NAMED in a name without changing what it names.
BESIDE = frozenset("area article bar block bottom box button buttons container content entry fixed form global icon icons inner item items left link links list main page post posts primary right section secondary site sticky text top user wrap wrapper".split())
#: Names of what is itself made of articles or long texts, and the share of the page's text that a named element must exceed to stay.
LISTS = COMMENTS | frozenset("ad ads adsense adslot advert advertisement advertising adverts aside promo recommended related sidebar sponsored".split())
MOST, MOST_OF_LISTS = 0.5, 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_BY_NAME = HEADINGS | {"html", "body", "main", "p"}
#: Elements that a start tag closes, and where the search for them ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("article aside section div td th li body html table blockquote button".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
UNENDED = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")


class _Page(HTMLParser):
    """A tree in arrays; a child's index is larger than its parent's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.skip, self.link, self.inside, self.aside = ["#root"], [-1], [False], [False], [False], [False]
        self.named: dict[int, frozenset | set] = {}
        self.open = [0]
        self.blocks: list[list[tuple[int, str]]] = [[]]

    def _out(self, tag: str, attrs: dict) -> bool:
        """No part of the tree."""
        return tag in DROPPED or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or bool(HIDDEN.search(attrs.get("style") or ""))

    def _aside(self, tag: str, attrs: dict) -> bool:
        """No content whatever it holds."""
        if tag in ASIDE or tag == "header" and not self.inside[self.open[-1]]:
            return True
        return (attrs.get("role") or "").lower() in ROLES and tag not in ("html", "body", "main", "article")

    def _named(self, tag: str, attrs: dict) -> frozenset | set:
        """Words for which it is left out unless it holds the article."""
        if tag in NEVER_BY_NAME:
            return frozenset()
        found = {"form"} if tag == "form" or (attrs.get("role") or "").lower() == "form" and tag != "article" else set()
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = {w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w and not w.isdigit()}
            if words <= NAMED | BESIDE:
                found |= words & NAMED
        if tag == "article":
            return found & COMMENTS
        return found - {"header"} if self.inside[self.open[-1]] else found

    def _close_to(self, depth: int) -> None:
        if any(self.tag[i] not in INLINE for i in self.open[depth:]):
            self._break()
        del self.open[depth:]

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _close_nearest(self, tags, scope) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags:
                self._close_to(depth)
                return
            if tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close_nearest({"p"}, P_SCOPE)
        if tag in CLOSES:
            self._close_nearest(*CLOSES[tag])
        if tag not in INLINE:
            self._break()
        elif tag == "br":
            self.blocks[-1].append((self.open[-1], " "))
        at = self.open[-1]
        self.parent.append(at)
        self.tag.append(tag)
        attrs = dict(attrs)
        self.skip.append(self.skip[at] or self._out(tag, attrs))
        self.aside.append(self.aside[at] or self.skip[-1] or self._aside(tag, attrs))
        if not self.aside[-1] and (named := self._named(tag, attrs)):
            self.named[len(self.skip) - 1] = named
        self.link.append(self.link[at] or tag == "a")
        self.inside.append(self.inside[at] or tag in ("article", "main"))
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self._close_to(depth)
                return

    def handle_data(self, data):
        if not self.skip[self.open[-1]]:
            self.blocks[-1].append((self.open[-1], data))


def _without_named(page: _Page) -> list[bool]:
    """``page.aside`` with the subtrees of named nodes that hold neither the article nor most of the text."""
    n, parent = len(page.tag), page.parent
    text, articles, mains, largest, around = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for block in page.blocks:
        for node, data in block:
            text[node] += 0 if page.link[node] else len(data) - data.count(" ") - data.count("\n")
    for i in range(n - 1, 0, -1):
        if page.aside[i]:
            continue
        p, own = parent[i], page.tag[i] == "article" and i not in page.named
        text[p] += text[i]
        articles[p] += articles[i] + own
        mains[p] += mains[i] + (page.tag[i] == "main")
        largest[p] = max(largest[p], largest[i], text[i] if own else 0)

    def stays(i: int) -> bool:
        lists = page.named[i] & LISTS
        if mains[i] or articles[i] and (not lists or largest[i] == largest[0]):
            return True
        elsewhere = articles[0] + mains[0] - articles[i] - mains[i] - around[i]
        return not elsewhere and text[i] > (MOST_OF_LISTS if lists else MOST) * text[0]

    out = list(page.aside)
    for i in range(1, n):
        around[i] = around[parent[i]] + (page.tag[parent[i]] == "main" or page.tag[parent[i]] == "article" and parent[i] not in page.named)
        out[i] = out[i] or out[parent[i]] or i in page.named and not stays(i)
    return out


def densities(page: _Page) -> tuple[list[float], list[int], list[int]]:
    """Of every node: composite text density, characters and characters of links, below included."""
    n, parent = len(page.tag), page.parent
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for block in page.blocks:
        for node, data in block:
            size = len(data) - data.count(" ") - data.count("\n")
            chars[node] += size
            link_chars[node] += size * page.link[node]
    for i in range(n - 1, 0, -1):
        if not page.skip[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    all_chars, all_links = max(chars[0], 1), link_chars[0]

    def density(i: int) -> float:
        c, lc, t = chars[i], link_chars[i], max(tags[i], 1)
        if not c or page.skip[i]:
            return 0.0
        base = log(lc * c / max(c - lc, 1) + all_links * c / all_chars + e)
        return c / t * log(c / max(lc, 1) * t / max(min(link_tags[i], t), 1) + 1e-9) / log(max(base, 1.3))

    return [density(i) for i in range(n)], chars, link_chars


def density_sums(page: _Page, dense: list[float], out: list[bool]) -> list[float]:
    """Of every block: the densities of the blocks next below it that may be content, summed."""
    n, sums, block = len(page.tag), [0.0] * len(page.tag), [0] * len(page.tag)
    for i in range(1, n):
        p = page.parent[i]
        block[i] = p if page.tag[p] not in INLINE else block[p]
    for i in range(n - 1, 0, -1):
        if not out[i] and page.tag[i] not in INLINE:
            sums[block[i]] += dense[i]
    return sums


def _content(page: _Page, out: list[bool]) -> list[bool]:
    """Which nodes are content; none of ``out`` is."""
    n, parent = len(page.tag), page.parent
    dense, chars, link_chars = densities(page)
    total = density_sums(page, dense, out)
    best = list(range(n))  # the node of the largest sum below, itself included; the uppermost of equals
    for i in range(n - 1, 0, -1):
        if not out[i] and total[best[i]] >= total[best[parent[i]]]:
            if total[best[i]] > total[best[parent[i]]] or best[parent[i]] != parent[i]:
                best[parent[i]] = best[i]
    marked = [False] * n
    top = best[0]
    at, threshold = top, dense[top]
    while at > 0:
        threshold = min(threshold, dense[at])
        if page.tag[at] == "body":
            break
        at = parent[at]
    for i in range(n):
        if not out[i] and dense[i] >= threshold and chars[i]:
            marked[best[i] if total[best[i]] > 0 else i] = True
    marked[top] = True

    # the least node that holds all of it, but for menus in it
    whole, holds = 0, [0] * n
    for i in range(n - 1, -1, -1):
        holds[i] += marked[i]
        if i:
            holds[parent[i]] += holds[i]
    for i in range(1, n):
        if holds[i] == holds[0]:
            whole = i
    if page.tag[whole] not in ("#root", "html", "body"):
        marked[whole] = True
        for i in range(whole + 1, n):
            menu = page.tag[i] not in INLINE and not holds[i] and link_chars[i] > MOSTLY_LINKS * chars[i]
            out[i] = out[i] or out[parent[i]] or menu and not page.link[parent[i]]
    beside = {parent[i] for i in range(1, n) if marked[i]}
    for i in range(1, n):  # headings beside content
        if page.tag[i] in HEADINGS and not out[i] and parent[i] in beside and not page.link[i]:
            marked[i] = True
    for i in range(1, n):
        marked[i] = not out[i] and (marked[i] or marked[parent[i]])
    return marked


def _text(page: _Page, out: list[bool]) -> str:
    content = _content(page, list(out))
    return " ".join(" ".join(("".join(data for node, data in block if content[node])).split()) for block in page.blocks if any(content[node] and not data.isspace() for node, data in block))


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, joined by one space; '' for no page."""
    if not html:
        return ""
    page = _Page()
    page.feed(UNENDED.sub("", html))
    page.close()
    return _text(page, _without_named(page)) or _text(page, page.aside) or _text(page, page.skip)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or blank html has empty text. Cut-off pages are read as far as they go; an unended
    tag at the end is no text. Repeated rows and null ids give a row each; other columns
    are not read.
    """

    texts = udf_of_lists(StringType(), lambda batches: ([main_text(x) for x in batch] for batch in batches))
    return pages.select("page_id", "url", texts(F.coalesce("html", F.lit(""))).alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
