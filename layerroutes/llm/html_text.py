"""Main text of web pages by tag-path ratios.

Each text node has a root-to-leaf tag path. Per path, text length and punctuation are summed
and divided by its nodes, and text in links is taken off. The ratios are smoothed along the page
and fused with the plain ones; a class name of advert or menu kind lowers what is below it. Paths
that reach a share of the typical content's score hold the content nodes.

Content nodes give the article. To them come the other blocks of an article or main element
that holds most of them; without such an element, what lies beside and between them and the
heading before them. Low-scored marked parts, reader comments and lists of links never come. Scripts, styles,
menus, page headers, footers, asides, forms and hidden parts are out by their element alone."""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul br".split())
NO_TEXT = frozenset("script style head title nav footer aside form noscript template svg math button select textarea iframe object canvas audio video dialog menu".split())
CONTAINER = frozenset("article main section div body td html blockquote center ul ol table".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("br option legend caption summary".split())
SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words of class names and roles that lower a score, and words beside them that
#: change nothing. A name counts if it has a word of the first list and none outside both.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social related widget login signup search form toolbar pagination complementary contentinfo toc".split()
)
BESIDE = frozenset("left right top bottom inner outer box block list item items area bar panel link links site page global user users reader section wrap wrapper container post posts article articles text thread slot unit".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Words of the lists above written as one.
_JOINED = re.compile(r"(ad|advert|comment|promo|newsletter|cookie|share|social|sidebar)s?(list|box|area|form|section|thread|slot|unit|banner|bar|wrap|wrapper|container|block|signup|widget|item)s?")
PUNCTUATION = frozenset(",.;:!?，。；：！？、…")
PENALTY = 0.05
SHARE = 0.2  # of the content's typical score: what a path must reach
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CUT = re.compile(r"[^a-z]+")
_SPACES = re.compile(r"\s+")


def _marked(names: str) -> int:
    """0 if no name marks an element, 2 if one marks it as readers' comments, else 1."""
    kind = 0
    for name in names.lower().split():
        words = set(_CUT.split(name)) - {""}
        joined = {m.group(1) for m in map(_JOINED.fullmatch, words) if m}
        plain = {w for w in words if not _JOINED.fullmatch(w)}
        if (joined or plain & MARKS) and plain <= MARKS | BESIDE:
            kind = max(kind, 2 if "comment" in joined or plain & READERS else 1)
    return kind


class _Page(HTMLParser):
    """Elements of a page, parents before children, and its text nodes. An element has its tag,
    parent and path; paths are numbers in a tree of their own, so that deep nesting costs no
    more than its tags. Text of elements that are out is not kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.path = [""], [0], [0]
        self.out, self.named, self.mark, self.link, self.head = [False], [False], [0], [False], [False]
        self.numbers: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.open: dict[str, int] = defaultdict(int)
        self.nodes: list[tuple[int, str, int]] = []  # element, text, block
        self.block = 0

    def _close(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[self.tag[e]] -= 1
            self.block += self.tag[e] in BLOCK
        del self.stack[k:]

    def _close_open(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in tags:
                self._close(k)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.block += 1
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_open(("p",), ("button", "td", "th", "table", "caption", "object", "template", "article", "div", "section", "body"))
        if tag in SAME:
            self._close_open(("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,), SAME[tag])
        up, given = self.stack[-1], {k: v or "" for k, v in attrs}
        names = given.get("class", "") + " " + given.get("role", "")
        if not self.named[up] or tag != "section":  # in an article a section's id is a place to jump to
            names += " " + given.get("id", "")
        name = tag + "".join("." + x for x in sorted(set(_CUT.split(names.lower())) - {""}))
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(self.numbers.setdefault((self.path[up], name), len(self.numbers) + 1))
        self.named.append(self.named[up] or tag in ("article", "main"))
        self.out.append(self.out[up] or tag in NO_TEXT or (tag == "header" and not self.named[up]) or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", ""))))
        self.mark.append(_marked(names) if tag in CONTAINER and tag not in ("html", "body") else 0)
        self.link.append(self.link[up] or tag == "a")
        self.head.append(self.head[up] or tag in HEADING)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.block += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                self._close(k)
                return

    def handle_data(self, data):
        if not self.out[self.stack[-1]]:
            self.nodes.append((self.stack[-1], data, self.block))

    def below(self, own: list[int]) -> list[int]:
        """Sums over each element and all below it."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def inherited(self, own: list[bool]) -> list[bool]:
        """Is it so for the element or one above it?"""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian mean over two neighbours on each side."""
    k = np.array([0.054, 0.242, 0.399, 0.242, 0.054])
    return np.convolve(x, k)[2:-2] / np.convolve(np.ones(len(x)), k)[2:-2]


def content_paths(nodes: list[tuple[int, str, bool, bool]]) -> set[int]:
    """Paths whose score reaches the threshold. nodes, in page order: path, text, is it in a
    link, is it in a marked element.

    A path's ratio is its characters outside links a node, times one and its punctuation marks a
    node. A node fuses the ratio of its path with the smoothed ratios around it to their
    geometric mean, a marked one's counts a twentieth, and a path scores the mean of its nodes.
    The threshold is a fifth of the content's typical score: the median over the unmarked nodes,
    each with the weight of its characters outside links (over all nodes where these have none);
    or the greatest score, if that is less."""
    count, chars, points = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, link, _ in nodes:
        count[path] += 1
        chars[path] += 0 if link else len(text.strip())
        points[path] += sum(map(text.count, PUNCTUATION))
    ratio = np.array([chars[p] / count[p] * (1 + points[p] / count[p]) for p, *_ in nodes])
    marks = np.array([m for *_, m in nodes], dtype=bool)
    fused = np.sqrt(ratio * _smooth(ratio)) * np.where(marks, PENALTY, 1.0)
    weight = np.array([0 if link else len(t.strip()) for _, t, link, _ in nodes])
    if weight[~marks].sum():
        weight = np.where(marks, 0, weight)
    order = np.argsort(fused, kind="stable")
    run = np.cumsum(weight[order])
    typical = float(fused[order[np.searchsorted(run, run[-1] / 2)]])
    score: dict[int, float] = defaultdict(float)
    for (p, *_), v in zip(nodes, fused.tolist(), strict=True):
        score[p] += v / count[p]
    edge = min(SHARE * typical, max(score.values()))
    return {p for p, v in score.items() if v >= edge}


def _kept(page: _Page) -> list[bool]:
    """Which text nodes of the page are main text."""
    n = len(page.tag)
    full = [len(t.strip()) for _, t, _ in page.nodes]
    chars, linked, links, holds = [0] * n, [0] * n, [0] * n, [0] * n
    for (e, _, _), c in zip(page.nodes, full, strict=True):
        chars[e] += c
        linked[e] += c if page.link[e] else 0
        links[e] += bool(c) and page.link[e]
    for e, tag in enumerate(page.tag):
        holds[page.parent[e]] += tag in ("article", "main")
    chars, linked, links, holds = (page.below(x) for x in (chars, linked, links, holds))
    # a mark means nothing on what holds an article, nor, on a page without one, on what holds
    # nearly all of the text; readers' comments never are the text
    plain = page.inherited([bool(m) for m in page.mark])
    article = any(tag in ("article", "main") and chars[e] and not plain[e] for e, tag in enumerate(page.tag))
    free = sum(c for (e, _, _), c in zip(page.nodes, full, strict=True) if not plain[e] and not page.link[e])
    counts = [m and not holds[e] and (m == 2 or article or 10 * free >= chars[e]) for e, m in enumerate(page.mark)]
    marked = page.inherited([bool(c) for c in counts])
    readers = page.inherited([bool(c) and page.mark[e] == 2 for e, c in enumerate(counts)])
    menu = page.inherited([tag in CONTAINER and links[e] > 1 and 10 * linked[e] >= 6 * chars[e] > 0 for e, tag in enumerate(page.tag)])
    chosen = content_paths([(page.path[e], t, page.link[e], marked[e]) for (e, t, _), c in zip(page.nodes, full, strict=True) if c])
    bad = [menu[e] or readers[e] or (marked[e] and page.path[e] not in chosen) for e in range(n)]
    good = [c > 0 and page.path[e] in chosen and not bad[e] for (e, _, _), c in zip(page.nodes, full, strict=True)]
    weight = [0] * n
    sure = [g and not marked[e] for (e, _, _), g in zip(page.nodes, good, strict=True)]
    if not any(sure):
        sure = [c > 0 and not marked[e] and not bad[e] for (e, _, _), c in zip(page.nodes, full, strict=True)]
    for (e, _, _), c, g in zip(page.nodes, full, sure, strict=True):
        weight[e] += c if g else 0
    weight = page.below(weight)
    if not weight[0]:
        return good

    for kind in ("article", "main"):  # the outermost ones, if they hold most content
        top = [tag == kind and not page.out[e] for e, tag in enumerate(page.tag)]
        over = page.inherited(top)
        outer = [e for e in range(1, n) if top[e] and not over[page.parent[e]]]
        if outer and 2 * sum(weight[e] for e in outer) >= weight[0]:
            # teasers of other articles are much shorter than the article
            most = max(weight[e] for e in outer)
            over = page.inherited([top[e] and not over[page.parent[e]] and 4 * weight[e] >= most for e in range(n)])
            return [over[e] and not bad[e] for e, _, _ in page.nodes]

    box = [0] * n  # nearest container
    for e in range(1, n):
        box[e] = e if page.tag[e] in CONTAINER else box[page.parent[e]]
    region = max(e for e in range(n) if box[e] == e and weight[e] == weight[0])
    within = page.inherited([e == region for e in range(n)])
    beside = {box[e] for (e, _, _), g in zip(page.nodes, sure, strict=True) if g}
    keep = [not bad[e] and (g or box[e] in beside) for (e, _, _), g in zip(page.nodes, good, strict=True)]
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    for k in range(first, last + 1):
        e = page.nodes[k][0]
        keep[k] = keep[k] or (within[e] and not bad[e])
    above, e = {region}, region
    while e:
        e = page.parent[e]
        above.add(e)
    for k in range(first - 1, -1, -1):  # the heading before it and what lies between
        e = page.nodes[k][0]
        if full[k] and bad[e]:
            break
        if full[k] and page.head[e] and box[e] in above:
            inside = page.inherited([x == box[e] for x in range(n)])
            for j in range(k, first):
                keep[j] = inside[page.nodes[j][0]]
            break
    return keep


def main_text(html: str) -> str:
    page = _Page()
    page.feed(html)
    page.close()
    if not any(t.strip() for _, t, _ in page.nodes):
        return ""
    blocks: dict[int, list[str]] = defaultdict(list)
    for (_, text, block), keep in zip(page.nodes, _kept(page), strict=True):
        if keep:
            blocks[block].append(text)
    found = (_SPACES.sub(" ", "".join(b)).strip() for _, b in sorted(blocks.items()))
    return "\n".join(x for x in found if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id_col, url_col, text (main text, empty if there is none) and
    n_chars (its code points).

    Null and empty html give an empty text; html without tags is all text. Null ids and urls,
    ties and repeated rows go through row by row; other columns are ignored. An empty table
    gives an empty result. No shuffle; memory is one Arrow batch and one page's nodes."""
    kinds = [pages.schema[c].dataType for c in (id_col, url_col)]

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["a", "b", "text", "n_chars"])

    schema = T.StructType([T.StructField("a", kinds[0]), T.StructField("b", kinds[1]), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = pages.select(F.col(id_col).alias("a"), F.col(url_col).alias("b"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)
    return out.withColumnsRenamed({"a": id_col, "b": url_col})
