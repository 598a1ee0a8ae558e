"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events; block elements cut them
into lines. A line's ratio is its characters over its tags; the logarithms of the
ratios are smoothed by a Gaussian over neighbouring lines (beyond the page's ends
there is none) and parted into two clusters, or one if they lie less than a
factor of three apart. The lines of the high cluster choose the content: the
deepest element with four fifths of their text, lines of ``article`` and ``main``
counted twice, then up to every branch that holds prose (text outside of links)
of the high cluster, an ``article`` or ``main`` with any text. All lines of that
region are taken, short ones between long ones included.

What a page itself declares not to be content takes no part: scripts, styles and
controls never; menus, headers, footers, sidebars, forms and dialogs, and elements
whose class, id or role is or ends in such a name ("page-footer", not
"has-footer"), unless the page's only content lies within, as in a form around
the whole page or after a menu that is never closed. That is known at the page's
end.

Defined results: a null, empty or textless page has an empty text; markup left
open or closed twice ends with its parent; repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from histmerge.llm.batches import Texts, map_slices, with_columns

SIGMA = 1.0
#: Least distance of two clusters of logarithms of ratios.
APART = float(np.log(3))
#: Characters outside of links that make a piece of text prose.
LEAST_PROSE = 50
#: Characters of chosen prose from which a branch beside the region is content.
LEAST_BRANCH = 120

#: Elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main"
    " menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
LEFT_OUT = frozenset(
    "button canvas datalist head iframe input noscript object option script select style svg"
    " template textarea title".split()
)
#: Left out unless the page's only content lies within; of these, forms and menus need no article.
BESIDE = frozenset("aside dialog footer form header menu nav".split())
AROUND = frozenset("form nav".split())
TELLING = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark what is not content.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alertdialog banner breadcrumb"
    " breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus"
    " dialog disclaimer footer gdpr header masthead menu menubar modal nav navbar navigation"
    " newsletter notice notices notification outbrain overlay pager pagination popup promo"
    " promotion related reply replies search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription taboola toolbar tooltip topbar widget widgets".split()
)
#: Of these, words that in an article may be part of a name for content ("binary-search").
LOOSE = frozenset("alert banner disclaimer header notice notices search share skip social".split())
#: Of these, the marks of readers' comments.
COMMENTS = frozenset("comment comments disqus reply replies".split())
#: Words that may follow a mark ("ad-slot"), and that turn it ("has-sidebar").
PARTS = frozenset(
    "area bar block body box button buttons container form inner item items link links list panel"
    " section slot unit wrap wrapper".split()
)
TURNS = frozenset("has have no non not with without".split())
#: Elements that a new one of the same group ends.
ENDS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Elements that keep an open ``li`` or the like from being ended from within.
FENCES = frozenset("ul ol dl table article section div main body aside nav footer form".split())
WORDS = re.compile(r"[A-Za-z]+")


def mark_of(attrs: dict[str, str | None], told: bool = False) -> str:
    """The noise word that an element's class, id or role ends in, or nothing;
    ``told`` says that the element is in an article."""
    found = ""
    for token in " ".join(attrs.get(k) or "" for k in ("class", "id", "role")).lower().split():
        words = WORDS.findall(token)
        while len(words) > 1 and words[-1] in PARTS and words[-1] not in NOISE:
            words.pop()
        if words and words[-1] in NOISE and not TURNS.intersection(words[:-1]):
            if told and words[-1] in LOOSE and len(words) > 1 and not NOISE.intersection(words[:-1]):
                continue
            if words[-1] in COMMENTS:
                return words[-1]
            found = words[-1]
    return found


@dataclass
class Node:
    tag: str
    parent: int
    out: bool
    trail: tuple[int, ...] = ()
    link: bool = False
    mark: str = ""


@dataclass
class Line:
    pieces: list[tuple[str, int]]
    tags: int
    node: int
    text: str = ""
    linked: int = 0


class Lines(HTMLParser):
    """The page's lines outside of what is left out, with their place in the tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, False)]
        self.stack = [0]
        # Where in the stack the open elements of each name, and the fences, are.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.fences: list[int] = []
        self.lines: list[Line] = []
        self.held: list[tuple[str, int]] = []
        self.tags = 0

    def flush(self) -> None:
        if any(piece.strip() for piece, _ in self.held):
            self.lines.append(Line(self.held, self.tags, self.stack[-1]))
            self.tags = 0
        self.held = []

    def noisy(self, tag: str, values: dict[str, str | None]) -> bool:
        if tag in LEFT_OUT:
            return True
        if tag in ("html", "body", "article", "main") or tag in HEADINGS:
            return False
        return "hidden" in values or (values.get("aria-hidden") or "").lower() == "true"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br" or tag in ("td", "th"):
            self.held.append((" ", 0))
        if tag in VOID:
            return
        if tag in BLOCKS and tag not in HEADINGS or tag in ENDS:
            self.close_open(ENDS.get(tag, {"p"} if tag in BLOCKS else set()))
        top = self.stack[-1]
        values = dict(attrs)
        out = self.nodes[top].out or self.noisy(tag, values)
        link = self.nodes[top].link or tag == "a" and "href" in values
        told = bool(self.open["article"] or self.open["main"])
        mark = ""
        if not (out or tag in ("html", "body", "main") or tag in HEADINGS or tag == "header" and told):
            mark = mark_of(values, told)
            if tag in BESIDE and mark not in COMMENTS:
                mark = f"<{tag}>"
        self.nodes.append(Node(tag, top, out, link=link, mark=mark))
        self.open[tag].append(len(self.stack))
        if tag in FENCES:
            self.fences.append(len(self.stack))
        self.stack.append(len(self.nodes) - 1)

    def cut(self, k: int) -> None:
        """End the open elements from the ``k``-th on."""
        for n in self.stack[k:]:
            tag = self.nodes[n].tag
            self.open[tag].pop()
            if tag in FENCES:
                self.fences.pop()
        del self.stack[k:]

    def close_open(self, tags: set[str]) -> None:
        """End the nearest open element among ``tags``, unless a fence is nearer."""
        k = max((self.open[t][-1] for t in tags if self.open[t]), default=0)
        if k and (not self.fences or k >= self.fences[-1]):
            self.cut(k)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        k = self.open[tag][-1]
        # An inline end tag does not close blocks.
        if tag in BLOCKS or not self.fences or k >= self.fences[-1]:
            self.cut(k)

    def handle_data(self, data: str) -> None:
        if not self.nodes[self.stack[-1]].out:
            self.held.append((data, self.stack[-1]))

    def done(self) -> list[Line]:
        self.close()
        self.flush()
        self.leave_out()
        taken, tags = [], 0
        for line in self.lines:
            held = [(piece, n) for piece, n in line.pieces if not self.nodes[n].out]
            line.text = " ".join("".join(piece for piece, _ in held).split())
            line.linked = sum(len(" ".join(p.split())) for p, n in held if self.nodes[n].link)
            tags += line.tags
            if line.text:
                line.tags, tags = tags, 0
                taken.append(line)
        return taken

    def leave_out(self) -> None:
        """Decide which marked elements are left out, now that the page is known."""
        nodes = self.nodes
        if not any(n.mark for n in nodes):
            return
        # Articles that are no comments tell content; another mark on them means nothing.
        tells = [n.tag in TELLING and n.mark not in COMMENTS for n in nodes]
        told = [False] * len(nodes)
        for k in range(1, len(nodes)):
            told[k] = tells[k] or told[nodes[k].parent]
        text, inside, prose = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
        for line in self.lines:
            for piece, k in line.pieces:
                text[k] += (n := len(piece.strip()))
                inside[k] += n * told[k]
                prose[k] += n * (n >= LEAST_PROSE and not nodes[k].link)
        holds = [t and i > 0 for t, i in zip(tells, inside, strict=True)]
        for k in range(len(nodes) - 1, 0, -1):
            up = nodes[k].parent
            text[up] += text[k]
            inside[up] += inside[k]
            prose[up] += prose[k]
            holds[k] = holds[k] or tells[k] and inside[k] > 0
            holds[up] = holds[up] or holds[k]
        for k in range(1, len(nodes)):
            node = nodes[k]
            alone = inside[0] == inside[k]  # no content is told outside
            if node.mark.startswith("<"):
                stays = alone and (holds[k] or node.tag in AROUND and 2 * prose[k] > prose[0])
            else:
                most = alone and 2 * text[k] > text[0]
                stays = most or holds[k] and (alone or node.mark not in COMMENTS)
            marked = bool(node.mark) and (node.tag != "article" or node.mark in COMMENTS)
            node.out = node.out or nodes[node.parent].out or marked and not stays


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach), kernel / kernel.sum(), "valid")


def high_cluster(values: np.ndarray) -> np.ndarray:
    """Which values lie in the higher of two clusters (two-means on a line); all,
    if the clusters are not ``APART``."""
    low, high = values.min(), values.max()
    if low == high:
        return np.ones(len(values), bool)
    for _ in range(50):
        split = values > (low + high) / 2
        a, b = values[~split].mean(), values[split].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    if high - low < APART:
        return np.ones(len(values), bool)
    return values > (low + high) / 2


def weights(parser: Lines, lines: list[Line], of: list[int]) -> list[int]:
    """For each element the sum of its lines' numbers, all below it included."""
    out = [0] * len(parser.nodes)
    for line, n in zip(lines, of, strict=True):
        out[line.node] += n
    for node in range(len(out) - 1, 0, -1):
        out[parser.nodes[node].parent] += out[node]
    return out


def content_node(parser: Lines, lines: list[Line], chosen: np.ndarray) -> int:
    """The element that holds the content: the deepest one with at least four fifths
    of the chosen text, then up to every branch that holds chosen prose or an article."""
    nodes = parser.nodes
    told = [False] * len(nodes)
    for n in range(1, len(nodes)):
        told[n] = told[nodes[n].parent] or nodes[n].tag in TELLING
    sizes = [len(line.text) for line in lines]
    picked = weights(
        parser, lines,
        [n * int(c) * (1 + told[x.node]) for x, n, c in zip(lines, sizes, chosen, strict=True)],
    )
    region = max(n for n, w in enumerate(picked) if 5 * w >= 4 * picked[0])
    # Chosen prose, and any text of an article, beside the way up: in the lines of an
    # element itself or in one of its children.
    prose_of = [
        max(n, LEAST_BRANCH) if told[x.node] else n if c and 2 * x.linked < n else 0
        for x, n, c in zip(lines, sizes, chosen, strict=True)
    ]
    prose = weights(parser, lines, prose_of)
    own = [0] * len(nodes)
    for line, n in zip(lines, prose_of, strict=True):
        own[line.node] += n
    children: dict[int, list[int]] = {}
    for n in range(1, len(nodes)):
        if prose[n] >= LEAST_BRANCH:
            children.setdefault(nodes[n].parent, []).append(n)
    below, up = region, nodes[region].parent
    while up >= 0:
        if own[up] >= LEAST_BRANCH or any(n != below for n in children.get(up, [])):
            region = up
        below, up = up, nodes[up].parent
    return region


def main_text(page: str) -> str:
    cut = page.rfind("<")
    if cut >= 0 and ">" not in page[cut:] and page[cut + 1 : cut + 2].strip("/!").isalpha():
        page = page[:cut]  # a tag that the page's end cuts off
    parser = Lines()
    parser.feed(page)
    lines = parser.done()
    if not lines:
        return ""
    ratio = np.array([len(x.text) / (x.tags + 1) for x in lines])
    region = content_node(parser, lines, high_cluster(smoothed(np.log1p(ratio))))
    # A line's element may itself be the region's leaf: go up to a block that holds others.
    while parser.nodes[region].parent > 0 and parser.nodes[region].tag not in FENCES:
        region = parser.nodes[region].parent
    taken = []
    for line in lines:
        node = line.node
        while node > region:
            node = parser.nodes[node].parent
        if node == region:
            taken.append(line.text)
    return "\n\n".join(taken)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``html`` whole)."""

    def work(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        found = [main_text(texts.text(k).decode("utf-8", "replace")) for k in range(len(texts))]
        ids, urls = (part.column(part.schema.get_field_index(c)) for c in ("page_id", "url"))
        return pa.record_batch(
            [ids, urls, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    plain = with_columns(pages, {"page_id": "long", "url": "string", "html": "string"})
    return map_slices(plain, work, "page_id long, url string, text string, n_chars long", "html")
