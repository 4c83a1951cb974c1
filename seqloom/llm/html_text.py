"""Main text of web pages from parser events and the text-to-tag ratio of lines.

The parser of the standard library gives a stream of events. Block elements end a line; a line has its
text, the number of tags in it, and the container it lies in. The logarithm of the ratio of text to tags is
smoothed over neighbouring lines with a Gaussian kernel, and two-means clustering of the smoothed ratios sets
the threshold above which a line is content. Ratios from ``SURE`` on count alike, and centres closer than ``GAP``
are one cluster, so neither one very long line nor a difference between paragraphs sets the threshold.
Elements that never are content (navigation, scripts, adverts, comments ...) are left out beforehand, by their
name, role and class. A form, or an element left out for its class alone, stays if it holds a main element, or
more than half of the page's text and no article or main element lies outside of such elements: then it is the
page's frame, whatever it is called. The region is the
innermost container that holds all content lines, an article or main element at the latest, and every
line of it is kept, short or long.

A null page counts as empty and has an empty text; broken and unclosed markup is read as far as it goes;
whole pages are read, however long or deeply nested, in time that grows with their length; repeated rows are
returned each.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SKIPPED = frozenset("script style noscript template nav footer aside button select textarea iframe svg "
                    "canvas object head menu dialog".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
SKIPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|comments?|disqus|replies|respond|newsletter|subscribe|"
    r"share|sharing|social|related|recommended|widget|toolbar|login|signup)(?:$|[\s_-])", re.I)
#: Names of which an element that holds most of the text is still left out.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus|replies|respond|cookies?|consent|gdpr|popup|modal)(?:$|[\s_-])", re.I)
CONTAINERS = frozenset("html body main article section div td table tbody tr center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote header figure figcaption address hr br th thead tfoot "
    "caption fieldset details summary title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RADIUS = 2
SIGMA = 1.0
#: Characters per tag that make a line content for sure, and the least difference of the centres, in logarithms.
SURE, GAP = 60.0, math.log(2)


class Lines(HTMLParser):
    """Collects (text, tags, container, doubt) of each line outside of skipped elements.

    Containers are numbered in the order they open, and ``last`` is the last one opened inside each, so one lies in
    another if its number is in that range. A doubt is an element that is left out unless it holds most of the text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.articles, self.last = [-1], [-1], [0]  # by container; the outermost article or main
        self.doubts: list[list] = [[-1, False, True]]  # outer doubt, holds main, may stay
        self.stack: list[tuple[str, bool, int, int, bool]] = []  # name, skipped, container, doubt, a container of its own
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = 0
        self.framed = False  # an article or main element lies outside of doubts

    def _here(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:4] if self.stack else (False, 0, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, *self._here()[1:]))
        self.parts, self.tags = [], 0

    def _cut(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        for name, _, at, _, own in self.stack[i:]:
            self.open[name] -= 1
            if own:
                self.last[at] = len(self.parents) - 1
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and not self._here()[0]:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS:  # a block closes an open paragraph, and inline elements left open in it
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._cut(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        skipped, at, doubt = self._here()
        if not skipped:
            said = dict(attrs)
            skipped = (tag in SKIPPED or tag == "header" and self.articles[at] < 0
                       or (said.get("role") or "").lower() in SKIPPED_ROLES)
            named = [said.get(k) or "" for k in ("class", "id")] if tag not in ("html", "body", "article", "main") else []
            if not skipped and (tag == "form" or any(map(SKIPPED_NAMES.search, named))):
                self.doubts.append([doubt, False, not any(map(NEVER.search, named))])
                doubt = len(self.doubts) - 1
            if tag in ("article", "main") and not skipped:
                self.framed |= doubt == 0
                d = doubt if tag == "main" else 0
                while d > 0 and not self.doubts[d][1]:
                    self.doubts[d][1] = True
                    d = self.doubts[d][0]
        own = tag in CONTAINERS and not skipped
        if own:
            new = len(self.parents)
            self.articles.append(self.articles[at] if self.articles[at] >= 0 else new if tag in ("article", "main") else -1)
            self.parents.append(at)
            self.last.append(new)
            at = new
        self.stack.append((tag, skipped, at, doubt, own))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        i = len(self.stack) - 1
        while self.stack[i][0] != tag:
            i -= 1
        if tag in BLOCKS and not self.stack[i][1]:
            self._end_line()
        self.tags += 1
        self._cut(i)

    def handle_data(self, data):
        if not self._here()[0]:
            self.parts.append(data)

    def close(self):
        super().close()
        self._end_line()
        self._cut(0)
        self.last[0] = len(self.parents) - 1

    def kept(self) -> list[tuple[str, int, int]]:
        """The lines outside of doubts that do not hold most of the text."""
        inside = [0] * len(self.doubts)
        for text, _, _, doubt in self.lines:
            inside[doubt] += len(text)
        for d in range(len(self.doubts) - 1, 0, -1):  # inner doubts have higher numbers
            inside[self.doubts[d][0]] += inside[d]
        out = [False] * len(self.doubts)
        for d in range(1, len(self.doubts)):
            outer, main, may_stay = self.doubts[d]
            out[d] = out[outer] or not (may_stay and (main or not self.framed and 2 * inside[d] > inside[0]))
        return [line[:3] for line in self.lines if not out[line[3]]]


def smoothed(values: list[float], radius: int = RADIUS, sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights are normalised at the ends."""
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in zip(range(i - radius, i + radius + 1), weights):
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Middle of the two centres of one-dimensional two-means; the smallest value if these are no more than a gap apart."""
    low, high = min(values), max(values)
    for _ in range(100):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not under or not over:
            return min(values)
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= GAP else min(values)


def main_text(html: str | None) -> str:
    """Text of the content region: white space in a line is one space, lines are joined by a newline."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.kept()
    if not lines:
        return ""
    ratios = smoothed([math.log1p(min(len(text) / max(1, tags), SURE)) for text, tags, _ in lines])
    cut = threshold(ratios)
    # in an article or main element the region is never smaller than that
    content = [c if parser.articles[c] < 0 else parser.articles[c]
               for (_, _, c), r in zip(lines, ratios) if r >= cut]
    region, other = min(content), max(content)  # containers are numbered as they open: these two span all
    while not region <= other <= parser.last[region]:
        region = parser.parents[region]
    return "\n".join(text for text, _, c in lines if region <= c <= parser.last[region])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")


def op10_html_ratio(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return extract(pages)
