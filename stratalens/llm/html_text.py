"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

# HTML element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of an article.
NOISE = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea datalist dialog menu title".split())
#: Words in class, id or role that name something other than the article.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall nav navbar navigation navigate menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations recirc share sharing sharebar social comment comments commentlist commenter disqus discussion respond reply replies footer foot header masthead topbar pagination pager toolbar login search searchbox copyright legal skip complementary contentinfo dialog outbrain taboola teaser teasers".split()
)
#: Words beside a noise word that make it name content.
CONTENT_WORDS = frozenset("article content story".split())
#: Words that say what is, is not or was there besides.
BESIDES = frozenset("has no with without".split())
#: Words that stand beside a noise word without making it anything else.
FURNITURE = frozenset(
    "area bar bottom box button buttons block cards center container fixed form global group holder icons inline inner item items js left line link links list main media message mobile module outer page panel post posts primary region right row secondary section site slot sticky strip text title top unit wrap wrapper".split()
)
#: Text elements: within an article their class says how they look.
TEXT = frozenset("p h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements within a line, which hold no article.
INLINE = frozenset("a abbr b big cite code em font i img label small span strong sub sup time u".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: How many times the clustered text of an article or main element counts against text outside them.
ELEMENT_WEIGHT = 10
#: Elements whose open paragraph ends when one of BLOCKS begins.
CLOSES_P = BLOCKS - {"html", "head", "body"}


class Events(HTMLParser):
    """Turns parser events into lines: a block's text with its counts of tags and link text.

    ``lines`` holds [parts, tags, link characters, container, headline, doubt].
    Containers are numbered in the order in which they open: ``above`` is the one
    around each, ``last`` the last one inside it, ``bounds`` names those that are
    article or main elements, and ``owner`` is the outermost article around each, or
    else the outermost main, itself included, or 0.
    Elements known to be noise are skipped with all they hold. Containers that only
    their class, id or role calls noise are doubted: their lines are kept apart, and
    ``cleared`` has those that hold an article, main or h1. ``free`` has those that
    stand outside articles and are cleared if most of the clustered text is theirs.
    ``doubt_above`` is the doubted container around each.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: dict[str, int] = {}  # open elements by name, and those since the noise began
        self.inside: dict[str, int] = {}
        self.noise_at: int | None = None  # depth of the outermost open noise element
        self.links = 0
        self.holds: list[int] = [0]  # open containers; 0 is the page
        self.above, self.last, self.owner = [0], [0], [0]
        self.article_depth: list[int] = []
        self.articles = 0
        self.bounds: dict[int, str] = {}
        self.doubts: list[tuple[int, int]] = []  # depth and number of open doubted containers
        self.doubt_above = [0]
        self.cleared: set[int] = {0}
        self.free: set[int] = set()
        self.lines: list[list] = []
        self.line: list = [[], 0, 0, 0, False, 0]

    def end_line(self) -> None:
        if self.line[0]:
            self.lines.append(self.line)
        self.line = [[], 0, 0, self.holds[-1], self.count.get("h1", 0) > 0, self.doubts[-1][1] if self.doubts else 0]

    def noise(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether an element is noise for certain."""
        if tag in NOISE:
            return True
        if tag == "header":
            return not self.article_depth
        if not attrs or tag in ("html", "body", "main", "article", "h1"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and HIDDEN.search(value.lower()) for name, value in attrs)

    def named_noise(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether class, id or role, name by name, call an element noise and nothing else."""
        if not attrs or tag in ("html", "body", "main", "article", "h1") or self.article_depth and tag in TEXT:
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.split():
                    words = set(SPLIT.split(CAMEL.sub(" ", one).lower())) - {""}
                    if one.lower() in NOISE_WORDS:
                        words = {one.lower()}  # sideBar is a sidebar
                    hit = words & NOISE_WORDS
                    if not hit or words & BESIDES or self.article_depth and hit <= {"header", "banner"}:
                        continue
                    rest = {w for w in words - hit if not w.isdigit()}
                    if rest <= FURNITURE or not self.article_depth and not rest & CONTENT_WORDS:
                        return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if tag in VOID:
            if self.noise_at is None:
                self.line[1] += 1
                if self.line[0]:
                    self.line[0].append(" ")
                if tag == "hr":
                    self.end_line()
            return
        if tag in CLOSES_P and (self.count if self.noise_at is None else self.inside).get("p"):
            self.close("p", stop=("article", "section", "div", "td", "li", "main", "body", "aside", "nav", "footer", "header"))
        if tag == "li" and self.open and self.open[-1] == "li":
            self.close("li", stop=("ul", "ol", "menu"))
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        if self.noise_at is not None:
            self.inside[tag] = self.inside.get(tag, 0) + 1
            return
        named = self.named_noise(tag, attrs)
        if named and tag in INLINE or self.noise(tag, attrs):
            self.noise_at = len(self.open) - 1
            self.inside = {}
            if block:
                self.end_line()
            else:
                self.line[0].append(" ")
            return
        if self.doubts and (tag == "article" or tag in ("main", "h1") and not self.articles):
            for _, i in reversed(self.doubts):
                if i in self.cleared:
                    break  # and so are those around it
                self.cleared.add(i)
        if named:
            self.doubt_above.append(self.doubts[-1][1] if self.doubts else 0)
            self.doubts.append((len(self.open) - 1, len(self.doubt_above) - 1))
            if not self.article_depth:
                self.free.add(self.doubts[-1][1])
            self.end_line()
        self.line[1] += 1
        if tag == "a":
            self.links += 1
        if block:
            around, made = self.holds[-1], len(self.above)
            self.above.append(around)
            self.last.append(made)
            own = self.owner[around]
            if tag in ("article", "main"):
                self.article_depth.append(len(self.open) - 1)
                self.articles += tag == "article"
                self.bounds[made] = tag
                if not own or tag == "article" and self.bounds[own] == "main":
                    own = made
            self.owner.append(own)
            self.holds.append(made)
            self.end_line()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close(self, tag: str | None = None, stop: tuple[str, ...] = ()) -> None:
        """Close open elements up to the nearest ``tag``; without a tag, the document."""
        if tag is None:
            super().close()
            self.end_line()
            for i in self.holds:  # those left open, and the page
                self.last[i] = len(self.above) - 1
            return
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i]
            if name == tag:
                for gone in reversed(self.open[i:]):
                    self.leave(gone)
                return
            if name in stop:
                return

    def leave(self, name: str) -> None:
        self.open.pop()
        self.count[name] -= 1
        depth = len(self.open)
        if self.noise_at is not None:
            if depth > self.noise_at:
                self.inside[name] -= 1
                return
            self.noise_at = None
            return
        if self.doubts and self.doubts[-1][0] >= depth:
            self.end_line()
            self.doubts.pop()
            self.line[5] = self.doubts[-1][1] if self.doubts else 0
        if self.article_depth and self.article_depth[-1] >= depth:
            self.article_depth.pop()
            self.articles -= name == "article"
        if name == "a":
            self.links -= 1
        if name in BLOCKS:
            self.last[self.holds.pop()] = len(self.above) - 1
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if self.noise_at is None:
            self.line[1] += 1
        elif tag != self.open[self.noise_at] and not self.inside.get(tag):
            # an outer block's end closes noise that was left open; other stray ends are ignored
            if tag not in BLOCKS or tag == "p":
                return
        self.close(tag)

    def handle_data(self, data: str) -> None:
        if self.noise_at is None:
            if self.line[0] or not data.isspace():
                self.line[0].append(data)
                if self.links:
                    self.line[2] += len(data)


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, renormalised at the ends."""
    radius = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[radius:-radius] / np.convolve(np.ones(len(values)), kernel)[radius:-radius]


def clusters(ratios: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio passes the threshold: the smaller of mean and deviation, above 0."""
    level = smooth(ratios)
    return level >= max(min(level.mean(), level.std() if len(level) > 1 else level.mean()), 1e-9)


def main_text(html: str | None) -> str:
    """The article's text of one page; see :func:`extract`."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and (html[cut + 1 : cut + 2].isalpha() or html[cut + 1 : cut + 2] in ("/", "!", "?")):
        html = html[:cut]  # a page that ends inside a tag
    parser = Events()
    parser.feed(html)
    parser.close()
    rows = [(t, line) for line in parser.lines if (t := " ".join("".join(line[0]).split()))]
    if not rows:
        return ""
    chosen = clusters(measured(rows))
    if parser.free or parser.doubt_above[1:]:
        fine = cleared_of(parser, rows, chosen)
        rows = [(t, line) for t, line in rows if fine[line[5]]]
        if not rows:
            return ""
        chosen = clusters(measured(rows))
    return " ".join(t for t, _ in region(parser, rows, chosen))


def measured(rows: list[tuple[str, list]]) -> np.ndarray:
    """Text outside links to tags, of each line."""
    return np.array([max(len(t) - line[2], 0) / (line[1] + 1) for t, line in rows])


def cleared_of(parser: Events, rows: list[tuple[str, list]], chosen: np.ndarray) -> list[bool]:
    """Whether each doubted container is content, with all around it: it holds an article, main or h1, or most of the clustered text."""
    weight, total = [0] * len(parser.doubt_above), 0
    for (t, line), c in zip(rows, chosen, strict=True):
        if c:
            total += len(t)
            weight[line[5]] += len(t)
    for i in range(len(weight) - 1, 0, -1):  # inner ones come behind
        weight[parser.doubt_above[i]] += weight[i]
    fine = [True]
    for i in range(1, len(weight)):
        fine.append(fine[parser.doubt_above[i]] and (i in parser.cleared or i in parser.free and 2 * weight[i] > total))
    return fine


def region(parser: Events, rows: list[tuple[str, list]], chosen: np.ndarray) -> list[tuple[str, list]]:
    """The lines of the content region, which the clusters choose; without clusters there is none.

    Clustered text is weighed by the outermost article around it, or else main. The
    heaviest is the region, with the headline of the main around an article, if its
    weight, ELEMENT_WEIGHT times over, is not less than that of the clustered text
    outside articles and mains: a short article outweighs a notice, a card does not
    outweigh a long text. Else the region is the smallest
    container of all clustered lines and headlines, less blocks of links before and
    behind them, which are menus.
    """
    marked = np.flatnonzero(chosen).tolist()
    if not marked:
        return []
    marked = [i for i in marked if rows[i][1][2] <= 0.5 * len(rows[i][0])] or marked  # smoothing lifts links beside text
    weight: dict[int, int] = {}
    for i in marked:
        owner = parser.owner[rows[i][1][3]]
        weight[owner] = weight.get(owner, 0) + len(rows[i][0])
    loose = weight.pop(0, 0)
    best = max(weight, key=lambda i: (weight[i], -i), default=0)
    if best and ELEMENT_WEIGHT * weight[best] >= loose:
        outer, at = set(), parser.above[best]
        while at:
            if at in parser.bounds:
                outer.add(at)
            at = parser.above[at]
        return [row for row in rows if best <= row[1][3] <= parser.last[best] or row[1][4] and parser.owner[row[1][3]] in outer]
    held = [rows[i][1][3] for i in marked] + [line[3] for _, line in rows if line[4]]
    low, high = min(held), max(held)
    while high > parser.last[low]:
        low = parser.above[low]
    if low and any(line[3] == low for _, line in rows):
        low = parser.above[low]  # a line of its own, and what stands beside it
    return [row for i, row in enumerate(rows) if low <= row[1][3] <= parser.last[low] and (marked[0] <= i <= marked[-1] or row[1][2] <= 0.5 * len(row[0]))]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: ``id_col`` (long), ``url_col``, ``text``.

    A standard-library parser streams the page; every block becomes a line with
    its text and tag counts. Menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments are recognised by element, role, class or
    id and left out; what only a role, class or id calls so stays if it holds an
    article, main or h1 or most of the clustered text. Ratios of text to tags are smoothed and cut at a threshold.
    The clusters choose the content region (:func:`region`): the article or main
    element with most clustered text, whole, unless more of it stands outside such
    elements; else the smallest container of all clustered lines and h1 headlines,
    less blocks of links before and behind them.
    White space runs become one space; blocks are joined by one space.

    Null or empty html and pages without content: empty text. Pages of any size
    are parsed whole, a slice at a time, without shuffle. Repeated rows give
    repeated results; an empty table an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return small_batches(rows).mapInArrow(run, "id long, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
