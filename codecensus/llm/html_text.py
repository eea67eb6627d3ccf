"""Main text of web pages by composite text density.

A page becomes a small tree of elements. Elements that are furniture by their kind (menus, footers, scripts, ...) are left
out. Those that are so by a name, a role or as a form or header (adverts, reader comments, ...) are left out unless they
hold the article: most of what stands in articles of the page, or, without such elements, most of its text with little
beside it. For every other element the characters per tag are computed and adjusted for links; the
element whose block children have the largest sum of densities holds the article. The least density on the way from there
to the body is the threshold at which other subtrees count as content too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codecensus.llm.common import slices

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)

# Names and relations of elements as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

FURNITURE = frozenset("head script style noscript template nav footer aside iframe object svg button select textarea input dialog menu title canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|footer|header|masthead|breadcrumbs?|comments?|disqus|replies|cookies?|consent|"
                    r"gdpr|notices?|popup|modal|overlay|newsletter|subscribe|social|share|sharing|related|recommend\w*|widget|login|signup|paywall|pagination|pager|toolbar)(?=$|[\s_-])", re.IGNORECASE)
LANDMARKS = frozenset(("article", "main"))
#: Names of elements that hold an article where no landmark does.
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?=$|[\s_-])", re.IGNORECASE)
#: Names that tell what stands beside an element, or what it lacks, say nothing about itself.
_BESIDE = re.compile(r"(?<![^\s])(?:has|with|without|no)[_-]\S+", re.IGNORECASE)


def _judged(tag: str, attributes: str, in_landmark: bool) -> tuple[bool, bool, bool]:
    """Whether an element is furniture for sure, whether it is by its name, and whether its name says that it holds an article."""
    if tag in FURNITURE:
        return True, False, False
    doubtful = tag == "form" or (tag == "header" and not in_landmark)
    if tag in ("html", "body") or not attributes:
        return False, doubtful, False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in reversed(list(_ATTRIBUTE.finditer(attributes)))}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, False, False
    doubtful = doubtful or found.get("role", "").lower() in ROLES
    names = [_BESIDE.sub(" ", found.get(k, "")) for k in ("class", "id")]
    if tag in LANDMARKS:
        return False, doubtful, False
    if in_landmark:  # the head of an article is part of it
        names = [re.sub(r"(?i)(?:^|(?<=[\s_-]))header(?=$|[\s_-])", " ", n) for n in names]
    doubtful = doubtful or any(map(_NAMES.search, names))
    return False, doubtful, not doubtful and tag not in INLINE and any(map(_CONTENT.search, names))


class Page:
    """Elements in page order as parallel lists; items hold (element, text) in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.skip, self.doubtful, self.landmark, self.named = ["#root"], [-1], [False], [False], [False], [False]
        self.items: list[tuple[int, str]] = []  # a text, or "" where an element opens or closes
        self._stack, self._open = [0], {"#root": 1}
        self._read(source)
        if any(self.doubtful):
            self._settle()

    def _text(self, text: str) -> None:
        if text and not self.skip[self._stack[-1]]:
            self.items.append((self._stack[-1], html.unescape(text)))

    def _pop(self) -> None:
        self._open[self.tag[self._stack.pop()]] -= 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE and self._open.get("p"):
            while self.tag[self._stack[-1]] != "p":
                self._pop()
            self._pop()
        closes, fences = CLOSES.get(tag, ()), FENCES.get(tag, ())
        for k in range(len(self._stack) - 1, 0, -1) if any(self._open.get(t) for t in closes) else ():
            name = self.tag[self._stack[k]]
            if name in fences:
                break
            if name in closes and all(self.tag[x] not in closes for x in self._stack[max(1, k - 2) : k]):
                while len(self._stack) > k:
                    self._pop()
                break
        up = self._stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        furniture, doubtful, named = _judged(tag, attributes, self.landmark[up])
        self.skip.append(self.skip[up] or furniture)
        self.doubtful.append(doubtful)
        self.named.append(named)
        self.landmark.append(self.landmark[up] or tag in LANDMARKS)
        new = len(self.tag) - 1
        self.items.append((new, ""))
        if tag not in VOID:
            self._stack.append(new)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if self._open.get(tag):
            while self.tag[self._stack[-1]] != tag:
                self._pop()
            self.items.append((self._stack[-1], ""))
            self._pop()

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        low = None
        while True:
            mark = source.find("<", at)
            if mark < 0 or mark > last:
                self._text(source[at:])
                return
            self._text(source[at:mark])
            if source.startswith("<!--", mark):
                end = source.find("-->", mark + 4)
                at = len(source) if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), mark):
                at = source.find(">", mark) + 1
                continue
            m = _TAG.match(source, mark) or _LOOSE_TAG.match(source, mark)
            if not m:
                self._text("<")
                at = mark + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                low = low if low is not None else source.lower()
                # Lower-casing may change the length of rare letters; then the text is searched as it is.
                end = (low if len(low) == len(source) else source).find(f"</{tag}", at)
                self._end(tag)
                if end < 0:
                    return
                at = source.find(">", end) + 1 or len(source)


    def _settle(self) -> None:
        """Leave out the doubtful elements that do not hold the article."""
        n = len(self.tag)
        own = [0] * n
        for element, text in self.items:
            if text:
                own[element] += sum(map(len, text.split()))
        # In a subtree: all text, text in landmarks, text in elements named as content, text under no doubtful element.
        whole, articles, contents, loose = own[:], [0] * n, [0] * n, own[:]
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            articles[k] = whole[k] if self.tag[k] in LANDMARKS else articles[k]
            contents[k] = whole[k] if self.named[k] else contents[k]
            for sums in (whole, articles, contents):
                sums[up] += sums[k]
            loose[up] += 0 if self.doubtful[k] else loose[k]
        clear = loose[0]
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.parent[k]]
            if not self.doubtful[k] or gone[k] or self.skip[k]:
                continue
            if articles[0]:
                holds = 2 * articles[k] > articles[0]
            elif contents[0]:
                holds = 2 * contents[k] > contents[0] and 2 * whole[k] > whole[0]
            else:
                holds = 2 * whole[k] > whole[0] and 4 * clear < whole[k]
            if holds:
                clear += loose[k]
            gone[k] = not holds
        self.skip = [a or b for a, b in zip(self.skip, gone, strict=True)]
        self.items = [(k, t) for k, t in self.items if not (t and self.skip[k])]


def _density(chars: float, tags: float, link_chars: float, link_tags: float, body_ratio: float) -> float:
    """Characters per tag, less the more of them are in links."""
    if not chars:
        return 0.0
    per_tag = chars / max(1.0, tags)
    plain = max(1.0, chars - link_chars)
    inner = math.log(chars / plain * link_chars + body_ratio * chars + math.e)
    value = chars / max(1.0, link_chars) * max(1.0, tags) / max(1.0, link_tags)
    return per_tag * math.log(max(value, 1.0)) / math.log(max(inner, 1.0) + 1e-9) if inner > 1 + 1e-9 else per_tag * math.log(max(value, 1.0) + 1.0)


def main_text(source: str | None) -> str:
    """Main text of a whole page: a line for each block, one space for each run of white space; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for element, text in page.items:
        if text:
            chars[element] += sum(map(len, text.split()))
    for k in range(n - 1, 0, -1):  # children stand after their parents
        if page.skip[k]:
            continue
        up = page.parent[k]
        if page.tag[k] == "a":
            link_chars[k], link_tags[k] = chars[k], link_tags[k] + 1
        chars[up] += chars[k]
        link_chars[up] += link_chars[k]
        tags[up] += tags[k] + 1
        link_tags[up] += link_tags[k]
    body = next((k for k in range(n) if page.tag[k] == "body"), 0)
    ratio = link_chars[body] / max(1, chars[body])
    density = [0.0 if page.skip[k] else _density(chars[k], tags[k], link_chars[k], link_tags[k], ratio) for k in range(n)]
    sums = [0.0] * n
    for k in range(1, n):
        if not page.skip[k] and page.tag[k] not in INLINE:
            up = page.parent[k]
            while up and page.tag[up] in INLINE:
                up = page.parent[up]
            sums[up] += density[k]
    top = max((k for k in range(n) if not page.skip[k]), key=lambda k: (sums[k], -k), default=0)
    if not sums[top]:
        top = body if not page.skip[body] else 0
    threshold, k = density[top], top
    while k not in (body, 0):
        k = page.parent[k]
        threshold = min(threshold, density[k])
    # Best sum inside each subtree, so that every dense subtree can name its own content.
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if not page.skip[k] and (sums[best[k]], -best[k]) > (sums[best[up]], -best[up]):
            best[up] = best[k]
    chosen, dense = {top}, [False] * n
    for k in range(n):
        dense[k] = not page.skip[k] and density[k] >= threshold and density[k] > 0 and (k in (0, body) or page.parent[k] < 0 or dense[page.parent[k]])
        if dense[k]:
            chosen.add(best[k])
    # Content inside an article or a main part stands for the whole of it, or else inside the nearest element named so.
    for k in list(chosen):
        named = landmark = 0
        while k > 0:
            named = named or (k if page.named[k] else 0)
            landmark = k if page.tag[k] in LANDMARKS else landmark
            k = page.parent[k]
        if landmark or named:
            chosen.add(landmark or named)
    inside = [False] * n
    for k in range(n):
        inside[k] = not page.skip[k] and (k in chosen or (page.parent[k] >= 0 and inside[page.parent[k]]))
    blocks: list[str] = []
    block: list[str] = []
    for element, text in [*page.items, (0, "")]:
        if text:
            if inside[element]:
                block.append(text)
        elif page.tag[element] == "br":
            block.append(" ")
        elif page.tag[element] not in INLINE:
            if words := "".join(block).split():
                blocks.append(" ".join(words))
            block = []
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: (page_id, url, text, n_chars).

    A null or empty page, and one without an article, has the text ''. Pages of any length and nesting are read whole. Of a
    repeated attribute the first counts. Repeated rows give repeated rows, null ids and addresses stay null; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            text = batch["html"].map(main_text, na_action=None)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": text.map(len)})

    return rows.mapInPandas(scan, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
