"""Main text of HTML pages by text-to-tag ratios (after CETR, Weninger et al. 2010).

The standard library's parser streams its events over the whole page; block-level elements cut the text into lines, and
each line knows its text, the tags met since the line before, and its place in a tree of the sections and of the
elements that look like boilerplate by element, role or name. The ratio of text to tags per line is smoothed by a
Gaussian over the page and clustered into two; lines of the upper cluster are content.

The ratio overrules names: what is named like boilerplate but holds most of the page's text, in content lines, is
layout. The region is what holds the content lines: the articles (else the main part) with such lines, else the smallest
section with all of them, and what stands directly in the sections around it, links apart. All lines of the region go
out, short ones too, but for boilerplate inside it and for runs of short links in the lower cluster.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag, and elements that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split()
)
#: Elements whose text is never main text, and sections that the region is chosen from.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search".split())
SECTION = frozenset("article main section div body blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of classes and ids of menus, adverts, notices, sidebars and comments.
NAMES = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bwith)(?<!\bno)(?<!\bwithout)(?<!\bis)[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|breadcrumbs?|nav\w*|menu|sidebar|side-?bar|footer|foot|masthead|site-?header|page-?header|topbar|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-?in|login|paywall|share|sharing|social|related|recommended|"
    r"recommendations|comments?|comment-?list|comment-?section|disqus|replies|reply|respond|reactions|widget|pagination|pager|skip-?link|toolbar|copyright|disclaimer|tags|trending|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
#: Articles that are comments or adverts themselves.
NOT_MAIN = re.compile(r"(?:^|\s)(?:comment|reply|sponsored|advert|ad)(?:\s|$|-(?!open|closed|status))", re.I)
#: Names of what readers write, which may well be most of a page's text.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?\w+|disqus|replies|reply|respond|reactions)(?:$|[\s_-])", re.I)
#: A run of so many links or more on end, of so many characters at most each on average, is a menu.
MENU_LINKS, MENU_CHARS = 5, 25
#: What may stand in a head; anything else ends it.
HEAD = frozenset("head title meta link script style base noscript template".split())
#: An open p ends where one of these starts.
ENDS_P = BLOCK - frozenset(["html", "body", "title", "option", "optgroup", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"])


class Line:
    __slots__ = ("links", "node", "prose", "skip", "tags", "text")

    def __init__(self, text: str, tags: int, node: int, skip: bool, linked: int, links: int):
        self.text, self.tags, self.node, self.skip, self.links = text, tags, node, skip, links
        self.prose = max(0, len(text) - linked)


class Node:
    """A section, or an element that is boilerplate by element, role or name; 0 is the page."""

    __slots__ = ("around", "boiler", "by_element", "inside", "name", "parent", "reader", "section", "soft", "wrapping")

    def __init__(self, name: str, parent: int, section: bool, boiler: bool = False, by_element: bool = False, inside: bool = False, soft: bool = False, reader: bool = False):
        self.name, self.parent, self.section, self.boiler, self.by_element, self.inside, self.soft, self.reader = name, parent, section, boiler, by_element, inside, soft, reader
        self.around = False  # holds an article or the main part: layout
        self.wrapping = 0  # 1: holds a first heading or other boilerplate; 2: an article


class Lines(HTMLParser):
    """Collects the lines of a page and the tree that they stand in; parents come before children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node("", 0, True)]
        self.open: list[tuple[str, bool, int, bool]] = []  # name, silent, the node before if it made one or -1, a link
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each name, where in open it stands
        self.node = 0
        self.boxes: list[int] = []  # the open nodes that are boilerplate
        self.told = [0, 0, 0]  # of these, how many know that they wrap something, an article, the main part
        self.silent = self.main = self.head = self.tags = self.links = self.linked = self.anchors = 0
        self.parts: list[str] = []

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append(Line(text, self.tags, self.node, False, self.linked, self.anchors))
                self.tags = 0
            self.linked = self.anchors = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.head and tag not in HEAD:
            self.end_element("head")
        if tag in VOID:
            if tag == "hr":
                self.cut()
            elif tag in ("br", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self.cut()
            if tag in ENDS_P:
                self.end_element("p", within=SECTION)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.end_element(tag, within=frozenset(["ul", "ol", "dl", "table", "select", "tr"]) - {tag})
        inside = self.main > 0
        named = hard = reader = False
        if tag not in ("html", "body", "article", "main"):
            for key, value in attrs:
                if key in ("class", "id") and value and NAMES.search(value):
                    named, reader = True, reader or bool(READERS.search(value))
                elif value and key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                    hard = True
        elif tag == "article":
            hard = any(key in ("class", "id") and value and NOT_MAIN.search(value) for key, value in attrs)
        by_element = tag in BOILERPLATE or tag == "header" and not inside
        boiler, section = named or hard or by_element, tag in SECTION
        if tag in ("article", "main") and not boiler:
            kind = 2 if tag == "main" else 1
            for n in self.boxes[self.told[kind] :]:
                box = self.nodes[n]
                box.wrapping = 2
                box.around = box.around or not box.by_element or box.name == "form" or tag == "main"
            self.told[kind] = len(self.boxes)
        if tag == "h1" or boiler:
            for n in self.boxes[self.told[0] :]:
                self.nodes[n].wrapping = max(1, self.nodes[n].wrapping)
            self.told[0] = len(self.boxes)
        before = -1
        if section or boiler:
            before, self.node = self.node, len(self.nodes)
            self.nodes.append(Node(tag, before, section, boiler, by_element and not (named or hard), inside, named and not (hard or by_element), reader))
            if boiler:
                self.boxes.append(self.node)
        silent, link = tag in SILENT, tag == "a" and any(key == "href" for key, _ in attrs)
        self.places[tag].append(len(self.open))
        self.open.append((tag, silent, before, link))
        self.links += link
        self.anchors += link
        self.silent += silent
        self.head += tag == "head"
        self.main += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def end_element(self, tag: str, within: frozenset = frozenset()) -> None:
        """Close the innermost open ``tag`` and what is open inside it, unless an element of ``within`` lies between."""
        if not self.places[tag]:
            return
        i = self.places[tag][-1]
        if len(self.open) - i <= len(within):
            between = any(x[0] in within for x in self.open[i + 1 :])
        else:  # nesting may be deep: of each name only the innermost place is looked at
            between = any(self.places[x] and self.places[x][-1] > i for x in within)
        if between:
            return
        for name, silent, before, link in reversed(self.open[i:]):
            self.places[name].pop()
            self.links -= link
            self.main -= name in ("article", "main")
            self.head -= name == "head"
            self.silent -= silent
            if before >= 0:
                if self.nodes[self.node].boiler:
                    self.boxes.pop()
                    self.told = [min(x, len(self.boxes)) for x in self.told]
                self.node = before
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCK:
            self.cut()
        # an inline end tag does not close a block, and no end tag but a section's own closes a section
        self.end_element(tag, within=frozenset() if tag in SECTION or tag in BOILERPLATE or tag in ("header", "body", "html") else SECTION | BOILERPLATE | {"header"} | (frozenset() if tag in BLOCK else BLOCK))

    def handle_data(self, data: str) -> None:
        if self.head and self.open[-1][0] == "head" and not data.isspace():
            self.end_element("head")
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section that SGML does not know is a comment up to its next ``>``, as in browsers."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def within(self, values: list[float]) -> list[float]:
        """Sums over each node and what is in it, of one value for each line."""
        out = [0.0] * len(self.nodes)
        for x, v in zip(self.lines, values):
            out[x.node] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.nodes[n].parent] += out[n]
        return out

    def below(self, flags: list[bool]) -> list[bool]:
        """Which nodes are flagged or lie in one that is."""
        out = list(flags)
        for n in range(1, len(out)):
            out[n] = out[n] or out[self.nodes[n].parent]
        return out

    def settled(self) -> list[Line]:
        """The lines, those in boilerplate marked.

        Boilerplate with an article or the main part in it is layout; an element such as an aside is so for an article
        only if most of the page's prose (text outside links) is in it. Boxes with most of the prose lie in each other.
        Such a box is layout as well where no other article or main part has prose, if it is a form or wraps a first
        heading or other boilerplate; and where it has its name only and its lines are content by their ratio, unless
        it is named as the readers' part. What lies in a box that is no layout goes, whatever else is said of it.
        """
        nodes, prose = self.nodes, [x.prose for x in self.lines]
        if not self.lines:
            return []
        ratio = smooth(np.array([len(x.text) / max(1, x.tags) for x in self.lines]))
        rich = ratio >= threshold(ratio)
        held = self.within(prose)
        chain = [n for n in range(1, len(nodes)) if nodes[n].boiler and not nodes[n].around and 2 * held[n] > held[0]]
        ok = set(chain)
        bad = self.below([x.boiler and not x.around and n not in ok for n, x in enumerate(nodes)])
        proper = self.below([x.section and x.name in ("article", "main") for x in nodes])
        clean = [v * (not bad[x.node]) for x, v in zip(self.lines, prose)]
        most, parts = self.within(clean), self.within([v * proper[x.node] for x, v in zip(self.lines, clean)])
        content = self.within([v * bool(r) for v, r in zip(prose, rich)])
        for n in chain:
            box = nodes[n]
            wraps = box.wrapping == 2 or box.name == "form" or box.wrapping and box.name not in ("footer", "header")
            alone = most[0] <= most[n] or not box.inside and parts[0] <= parts[n]
            if not (wraps and alone) and not (box.soft and not box.reader and 2 * content[n] > held[0]):
                break
            box.around = True
        bad = self.below([x.boiler and not x.around for x in nodes])
        for x in self.lines:
            x.skip = bad[x.node]
        return self.lines

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):  # a comment that never ends
            self.rawdata = ""
        super().close()
        self.cut()


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over the lines; the kernel is renormalised at the ends."""
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratio, k)[r : r + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), k)[r : r + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """Where two clusters of the values part (two means, from the extremes)."""
    low, high = values.min(), values.max()
    for _ in range(20):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            break
        low2, high2 = values[~upper].mean(), values[upper].mean()
        if low2 == low and high2 == high:
            break
        low, high = low2, high2
    return (low + high) / 2


def menus(lines: list[Line], kept: list[int], low: np.ndarray) -> set[int]:
    """Lines of the lower cluster that are runs of short links and nothing else."""
    out, run = set(), []
    for i in [*kept, None]:
        if i is not None and low[i] and lines[i].links and 10 * (lines[i].prose - 3 * lines[i].links) <= len(lines[i].text):  # up to three characters part two links
            run.append(i)
            continue
        links = sum(lines[j].links for j in run)
        if links >= MENU_LINKS and sum(len(lines[j].text) for j in run) <= MENU_CHARS * links:
            out.update(run)
        run = []
    return out


def select(page: Lines) -> list[str]:
    """Texts of the region's lines in page order."""
    lines, nodes = page.settled(), page.nodes
    if not lines or all(x.skip for x in lines):
        return []
    ratio = smooth(np.array([0.0 if x.skip else len(x.text) / max(1, x.tags) for x in lines]))
    cut = threshold(ratio)
    kept = [i for i, x in enumerate(lines) if not x.skip]
    gone = menus(lines, kept, ratio < cut)
    kept = [i for i in kept if i not in gone] or kept
    content = {i for i in kept if ratio[i] >= cut} or set(kept)
    held, any_ = page.within([i in content for i in range(len(lines))]), page.within([not x.skip for x in lines])
    for name in ("article", "main"):
        parts = [x.section and x.name == name for x in nodes]
        for count in (held, any_):
            region = [p and c > 0 for p, c in zip(parts, count)]
            if any(region):
                inside = page.below(region)
                return [lines[i].text for i in kept if inside[lines[i].node]]
    # the deepest section with all content lines, and the sections around it
    shared, around = 0, set()
    for n, x in enumerate(nodes):
        if x.section and held[n] == held[0]:
            shared = n
            around.add(n)
    around.discard(shared)
    inside = page.below([n == shared for n in range(len(nodes))])
    section = [0] * len(nodes)
    for n in range(1, len(nodes)):
        section[n] = n if nodes[n].section else section[nodes[n].parent]
    # titles, leads and closings stand beside the region, directly in a section around it
    return [lines[i].text for i in kept if inside[lines[i].node] or lines[i].prose and section[lines[i].node] in around]


def main_text(html: str) -> str:
    """The main text of one page: blocks in page order, white space inside a block as one space, joined by an empty line."""
    p = Lines()
    p.feed(html)
    p.close()
    return "\n\n".join(select(p))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages``.

    Null or empty html: empty text. Null ids and urls stay null, repeated rows stay repeated, an empty table gives an
    empty result; markup that never closes is read to its end. Other columns are ignored.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
