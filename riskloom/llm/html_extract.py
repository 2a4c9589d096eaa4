"""Main-text extraction from HTML: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The page is read once as a stream of standard-library parser events and cut into lines at the ends and starts of block elements.
Every line has a text-to-tag ratio: its characters outside links over its tags (1 at least). The ratios are
smoothed with a Gaussian kernel, and runs of lines above the threshold (the standard deviation of the smoothed
ratios) are clusters, which select the content:

* its region is all outermost ``article`` and ``main`` elements or, where these hold less of the clusters' text than the rest
  of the page, the smallest block with the clusters and headings;
* within it, a line that looks like furniture (mostly links, or in an element whose class, id or role has an ambiguous
  name, as ``tags`` or ``related``) stays only if it is in a cluster, by its own ratio too;
* all other lines of the region stay, short ones too: a title or a one-word paragraph has no ratio to show.

Lines inside elements that can't be the article's are set aside before: menus, headers and footers, sidebars, notices,
adverts, forms, scripts, styles and comments, told by the element or by an unmistakable class, id or role.

Time and memory grow in proportion to the page, however deep its elements are nested.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import slices

#: Elements without a text of the page.
_SILENT = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea option datalist map".split())
#: Elements that are not the article's, whatever they hold.
_ASIDE = frozenset("nav footer aside form button dialog menu fieldset label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
_CONTAINER = ("article", "main")
#: Blocks of prose, which are no menus even where all their text is linked.
_PROSE = (*_HEADING, "p", "blockquote", "pre", "dd", "figcaption")
#: An open <p> ends where one of these starts.
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_P_FENCES = ("article", "main", "section", "div", "td", "li", "blockquote", "body", "button")
_ITEM_FENCES = ("ul", "ol", "dl", "table", "menu")


def _names(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-]|\d)", re.I)


#: Names of furniture that no part of an article bears.
_FURNITURE = _names(
    r"nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|footer|masthead|site-?header|page-?header|top-?bar|side-?bar|widgets?|"
    r"cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus|replies|share|sharing|social|toolbar"
)
#: Names that furniture and articles both bear; the ratios decide.
_AMBIGUOUS = _names(r"aside|related|recommend\w*|banner|alert|commercial|reply|respond|reactions?|discussion|follow|tags?|search|skip|copyright|legal|disclaimer|toc|author-?box|byline-?links")
_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CUT_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!(?:--)?[^<>]*|/)$")


@dataclass
class Line:
    pieces: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    aside: bool = False
    doubtful: bool = False  # inside an element with an ambiguous name
    block: int = 0  # number of the innermost open block element, 0 for the page
    contained: bool = False  # inside an article or main
    heading: bool = False
    title: bool = False
    prose: bool = False

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class _Reader(HTMLParser):
    """Turns events into lines. Open elements are kept on a stack, of inline ones only links and those set aside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, whether set aside, whether doubtful, number of the block or -1
        self.where: dict[str, list[int]] = defaultdict(list)  # of each tag its places on the stack
        self.parents, self.ends = [0], [0]  # of each block, numbered in page order, its parent and the last block inside it
        self.block = self.asides = self.doubts = self.silent = 0
        self.line = Line()

    def _push(self, tag: str, aside: bool, doubtful: bool = False) -> None:
        number = -1
        if tag in _BLOCK:
            number = len(self.parents)
            self.parents.append(self.block)
            self.ends.append(number)
            self.block = number
        self.where[tag].append(len(self.open))
        self.open.append((tag, aside, doubtful, number))
        self.asides += aside
        self.doubts += doubtful
        self.silent += tag in _SILENT

    def _pop(self) -> tuple[str, bool, bool, int]:
        element = tag, aside, doubtful, number = self.open.pop()
        self.where[tag].pop()
        if number >= 0:
            self.ends[number] = len(self.parents) - 1
            self.block = self.parents[number]
        self.asides -= aside
        self.doubts -= doubtful
        self.silent -= tag in _SILENT
        return element

    def _inside(self, tags: Iterable[str]) -> bool:
        return any(self.where[t] for t in tags if t in self.where)

    def _new_line(self) -> None:
        tags = 0
        if self.line.pieces:
            self.lines.append(self.line)
        else:
            tags = self.line.tags
        self.line = Line(
            tags=tags, aside=self.asides > 0, doubtful=self.doubts > 0, block=self.block, contained=self._inside(_CONTAINER),
            heading=self._inside(_HEADING), title=self._inside(("h1",)), prose=self._inside(_PROSE),
        )

    def _nature(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether the element sets aside what it holds, and whether it makes it doubtful."""
        if tag in _ASIDE or (tag == "header" and not self._inside(_CONTAINER)):
            return True, False
        if tag in ("html", "body", "main", "article") or not attrs:
            return False, False
        own = {k: v or "" for k, v in attrs}
        if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in _ROLE or _HIDDEN.search(own.get("style", "")):
            return True, False
        names = [own[k] for k in ("class", "id", "data-role") if k in own]
        return any(map(_FURNITURE.search, names)), any(map(_AMBIGUOUS.search, names))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag in _SILENT:
            self._push(tag, True)
            return
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in _VOID:
            if tag == "hr":
                self._new_line()
            return
        if tag in _ENDS_P:
            self._close("p", _P_FENCES)
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self._close(tag, _ITEM_FENCES)
        aside, doubtful = self._nature(tag, attrs)
        if tag == "a" and self.where["a"]:
            self._close("a", ())
        if tag in _BLOCK or aside or doubtful or tag == "a":
            self._push(tag, aside, doubtful)
            if tag != "a" or aside or doubtful:
                self._new_line()

    def _close(self, tag: str, fences: tuple[str, ...]) -> None:
        """Close the innermost open ``tag`` unless a fence stands between. An open link goes on, as browsers have it."""
        if not self.where[tag]:
            return
        at = self.where[tag][-1]
        if any(self.where[f] and self.where[f][-1] > at for f in fences if f in self.where):
            return
        link = None
        while len(self.open) > at:
            element = self._pop()
            if element[0] == "a" and not element[1] and not element[2]:
                link = element
        if link and tag != "a":
            self._push("a", False)
        if tag != "a":
            self._new_line()

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag in _VOID or not self.where.get(tag):
            if tag in _BLOCK:
                self._new_line()
            return
        at, cut = self.where[tag][-1], tag in _BLOCK
        while len(self.open) > at:
            _, aside, doubtful, _ = self._pop()
            cut |= aside or doubtful
        if cut:
            self._new_line()

    def handle_data(self, data: str) -> None:
        if self.silent or not data:
            return
        if not self.line.pieces and not data.strip():
            return
        self.line.pieces.append(data)
        if self.where["a"]:
            self.line.linked += len(data.strip())

    def finish(self) -> None:
        self._new_line()
        while self.open:
            self._pop()
        self.ends[0] = len(self.parents) - 1

    def root(self, blocks: list[int]) -> int:
        """The smallest block element that holds all of these; 0 for the page. Of a single one, its parent: its other blocks belong to it."""
        if not blocks:
            return 0
        low, high = min(blocks), max(blocks)
        here = self.parents[low] if low == high and self.parents[low] else low
        while self.ends[here] < high:
            here = self.parents[here]
        return here


def _read(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(_CUT_TAG.sub("", html))
    reader.close()
    reader.finish()
    reader.lines = [x for x in reader.lines if x.text()]
    return reader


def lines(html: str) -> list[Line]:
    """The page's lines of text, in page order."""
    return _read(html).lines


def smooth(values: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; at both ends the kernel is cut off and scaled to weight 1."""
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        part = [(w, values[i + k]) for k, w in zip(range(-radius, radius + 1), kernel, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in part) / sum(w for w, _ in part))
    return out


def deviation(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def clusters(ratios: list[float]) -> list[bool]:
    """Whether each line is in a run whose smoothed ratio reaches the standard deviation of all."""
    if not ratios:
        return []
    flat = smooth(ratios)
    threshold = deviation(flat)
    return [v >= threshold for v in flat]


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    page = _read(html)
    own = [x for x in page.lines if not x.aside]
    if not own:
        return ""
    texts = [x.text() for x in own]
    ratios = [max(0, len(t) - x.linked) / max(1, x.tags) for t, x in zip(texts, own, strict=True)]
    flat = smooth(ratios)
    threshold = deviation(flat)
    clustered = [v >= threshold for v in flat]
    # neighbours alone lift a line over the threshold; its own ratio shows whether it is text itself
    strong = [c and r >= threshold for c, r in zip(clustered, ratios, strict=True)]
    mass = [0, 0]
    for t, c, x in zip(texts, clustered, own, strict=True):
        mass[x.contained] += len(t) if c else 0
    if mass[1] >= mass[0] and any(x.contained for x in own):
        # a title in front of the containers is theirs if they have none
        titled = any(x.title for x in own if x.contained)
        region = [x.contained or (x.title and not titled) for x in own]
    else:
        root = page.root([x.block for x, s in zip(own, strong, strict=True) if s or x.contained or (x.heading and not x.doubtful)])
        end = page.ends[root]
        region = [x.contained or root <= x.block <= end for x in own]
    keep = []
    for x, t, inside, s in zip(own, texts, region, strong, strict=True):
        menu = x.linked >= 0.8 * len(t) and not x.prose
        keep.append(inside and (s or not (x.doubtful or menu)))
    return "\n\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points of the text).

    A null or empty html has an empty text, and so has a page of nothing but markup. Truncated tags and
    unclosed elements are closed as browsers do. Pages are read whole whatever their length; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
