"""Main-content extraction from HTML.

The standard library's parser streams events into lines: one line per block of text,
with the characters of text, the tags met in it and the elements around it.  Lines inside
page furniture (menus, footers, forms, adverts, comments, ...) are set aside; elements that only their
name calls furniture count as such unless they hold an article, or most of the text of a page without any.  Each
remaining line has a text-to-tag ratio; the ratios are smoothed with a Gaussian kernel
and cut at their standard deviation.  The lines above the cut vote for the element
that holds the content, and the text is every line of that element, long or short.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import in_arrow, slices

SIGMA = 1.0
# Share of the votes that an element needs to be taken instead of the one around it.
VOTE_SHARE = 0.8
# An unmarked list of links: at least so much of a line's text is link text.
LINK_SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot
    thead title tr ul""".split())
HOLDERS = frozenset("article main section div td body blockquote".split())
FURNITURE = frozenset("""head nav footer aside form script style noscript template svg canvas iframe object embed button select
    textarea input label fieldset menu dialog audio video map title""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog directory form menu menubar navigation search toolbar".split())
NAMES = frozenset("""ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner
    menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead sidebar sidebars widget widgets related recommended
    recommendations footer foot header cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
    subscription signup login share sharing social pagination pager comment comments commentlist reply replies respond disqus discussion
    copyright legal skip""".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# A name that begins so speaks of what the element has or lacks, one that ends so of content.
ABOUT = frozenset("has had no not non with without is".split())
CONTENT = frozenset("article body content copy entry layout main open page post story text wrapper container".split())


def _named_furniture(value: str) -> bool:
    """Whether one of the names in a class or id is furniture's: the whole name, or its first or last part."""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if name.lower() in NAMES or parts and parts[0] not in ABOUT and parts[-1] not in CONTENT and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def _is_furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Furniture by its tag or attributes, whatever it holds."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value or tag in ("body", "html"):
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag == "article" and re.search(r"comment|repl(y|ies)", value, re.I):
            return True
    return False


def _is_suspect(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Furniture by its name, unless it turns out to hold an article or most of the page's text."""
    return tag not in ("article", "main", "header", "body", "html") and any(name in ("class", "id") and value and _named_furniture(value) for name, value in attrs)


class Lines(HTMLParser):
    """Collects ``rows``: (text, tags in the line, link characters, innermost holder, in a list, innermost suspect), and
    each holder's ``parent``; of each suspect the one around it, and whether it holds an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, int, int, bool, int]] = []
        self.around = [0]  # of suspect 0, which is none, and of those that open
        self.vouched = [True]  # theirs: an article within
        self.parent = [0]  # of holder 0, the page, and of those that open
        self.tag = ["html"]  # theirs
        self.open: list[tuple[str, bool, int, int] | None] = []  # tag, furniture, innermost holder and suspect; None: ended out of order
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag in ``open``
        self.holding: list[int] = []  # places of holders in ``open``
        self.depth: Counter[str] = Counter()
        self.hidden = self.links = self.lists = self.articles = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.has_article = False

    def flush_line(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.rows.append((text, self.tags, self.linked, self._holder(), self.lists > 0, self._suspect()))
        self.parts, self.tags, self.linked = [], 0, 0

    def _holder(self) -> int:
        return self.open[-1][2] if self.open else 0

    def _suspect(self) -> int:
        return self.open[-1][3] if self.open else 0

    def _count(self, tag: str, furniture: bool, by: int) -> None:
        self.depth[tag] += by
        self.hidden += by * furniture
        self.links += by * (tag == "a")
        self.lists += by * (tag in ("ul", "ol"))
        self.articles += by * (tag in ("article", "main"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and not self.hidden:
            self.flush_line()
        if not self.hidden:
            self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        if tag == "body":
            while self.depth["head"]:
                self._pop()
        if tag in BLOCK and self.open and self.open[-1][0] == "p":
            self._pop()  # a paragraph ends where another block begins
        furniture = _is_furniture(tag, attrs, self.articles > 0)
        holder, suspect = self._holder(), self._suspect()
        if not furniture and not self.hidden and _is_suspect(tag, attrs):
            if tag in BLOCK or not self.parts:  # inside a line, a suspect's text goes with the line's
                self.around.append(suspect)
                self.vouched.append(False)
                suspect = len(self.around) - 1
            else:
                furniture = True
        if tag in ("article", "main") and not furniture and not self.hidden:
            self.has_article = True
            s = suspect
            while not self.vouched[s]:
                self.vouched[s] = True
                s = self.around[s]
        if tag in HOLDERS:
            self.parent.append(holder)
            self.tag.append(tag)
            holder = len(self.parent) - 1
            self.holding.append(len(self.open))
        self.places[tag].append(len(self.open))
        self.open.append((tag, furniture, holder, suspect))
        self._count(tag, furniture, 1)

    def _pop(self) -> None:
        """End the innermost element that is open, and places of elements that ended out of order before it."""
        tag, furniture, *_ = self.open.pop()
        self.places[tag].pop()
        if tag in HOLDERS:
            self.holding.pop()
        self._count(tag, furniture, -1)
        while self.open and self.open[-1] is None:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK and not self.hidden:
            self.flush_line()
        if not self.depth[tag]:
            return
        at = self.places[tag][-1]
        if tag not in BLOCK and self.holding and self.holding[-1] > at:
            # an inline element that was left open around blocks: only itself ends
            self.places[tag].pop()
            self._count(tag, self.open[at][1], -1)
            self.open[at] = None
            return
        if not self.hidden:
            self.tags += 1
        if self._suspect() and tag not in BLOCK and self.open[at][3] != (self.open[at - 1][3] if at and self.open[at - 1] else 0):
            self.flush_line()  # a suspect that began a line ends inside it
        while len(self.open) > at:
            self._pop()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` up to the next ``>`` is no text, whatever it holds."""
        return self.rawdata.find(">", i) + 1 or -1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with a kernel of three sigmas, normalised at the ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[radius:-radius] / np.convolve(np.ones_like(ratios), kernel)[radius:-radius]


def _cleared(p: Lines) -> list[tuple[str, int, int, int, bool]]:
    """The lines that lie in no suspect; one that holds an article, or at least half of the text of a page without any, is none."""
    held = [0] * len(p.around)
    for text, *_, suspect in p.rows:
        held[suspect] += len(text)
    total = sum(held)
    for s in range(len(held) - 1, 0, -1):  # suspects are numbered as they open
        held[p.around[s]] += held[s]
    hides = [False] * len(held)
    for s in range(1, len(held)):
        hides[s] = hides[p.around[s]] or not (p.vouched[s] or not p.has_article and 2 * held[s] >= total)
    return [row[:5] for row in p.rows if not hides[row[5]]]


def main_text(html: str) -> str:
    """Text of the content element's lines, joined by one newline; empty if there is none."""
    p = Lines()
    # behind the last ">" nothing can be markup that ends; without this, the parser tries each "<" there to the end
    end = html.rfind(">") + 1
    p.feed(html[:end] + re.split(r"<[A-Za-z/!?]", html[end:], maxsplit=1)[0])
    p.close()
    p.flush_line()
    rows = _cleared(p)
    if not rows:
        return ""
    ratios = np.array([len(t) / max(1, tags) for t, tags, *_ in rows], dtype=float)
    smoothed = smooth(ratios)
    content = smoothed >= smoothed.std()
    # holders are numbered as they open, so a parent's number is smaller than its children's
    votes, links = np.zeros(len(p.parent)), np.zeros(len(p.parent), dtype=np.int64)
    link_line = [linked >= LINK_SHARE * len(text.replace(" ", "")) for text, _, linked, *_ in rows]
    for keep, link, (text, _, _, holder, _) in zip(content, link_line, rows, strict=True):
        links[holder] += link
        if keep and not link:
            votes[holder] += len(text)
    for h in range(len(votes) - 1, 0, -1):
        votes[p.parent[h]] += votes[h]
        links[p.parent[h]] += links[h]
    if not votes[0]:  # nothing but link text above the cut says nothing about the holder
        return "\n".join(text for text, *_ in rows)
    chosen = int(np.flatnonzero(votes >= VOTE_SHARE * votes[0])[-1])  # the innermost with enough votes
    around = [chosen]
    while around[-1]:
        around.append(p.parent[around[-1]])
    article = next((h for h in around if p.tag[h] in ("article", "main")), None)
    if article is not None:
        chosen = article
    else:  # titles, leads and closing lines stand beside the body; unmarked menus are lines of links
        while (up := p.parent[chosen]) and p.tag[up] != "body" and links[up] == links[chosen]:
            chosen = up
    inside = [chosen == 0]
    for h in range(1, len(votes)):
        inside.append(h == chosen or inside[p.parent[h]])
    out = [text for link, (text, _, _, holder, in_list) in zip(link_line, rows, strict=True)
           if inside[holder] and not (article is None and in_list and link)]
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``text`` and ``n_chars`` (its code points), one row per page.

    Null or empty markup, and markup without text, give the empty text; broken markup is
    read as far as it goes (unclosed elements end with the one around them); repeated
    rows and null ids pass through; other columns are ignored, also one named ``text``.
    """
    rows = pages.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = rows.drop("_html").schema.add("_text", "string")
    at = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts = [main_text(h) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string())], [*b.schema.names[:at], "_text"])

    out = in_arrow(rows, run, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
                      F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
