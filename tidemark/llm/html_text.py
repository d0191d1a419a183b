"""Main text of web pages by a tree-structured graphical model over the document's elements.

Every block element and every run of text is a node that is main text or not. A node has a potential
from its features (element, names in class, id and role, length, link share) and a potential with its
parent. Sum-product messages go up from the leaves and down from the root, for all pages of a batch
at once, level by level; texts whose marginal probability is at least one half are kept. Weights are
fitted to the hand-labelled pages in ``labelled_pages`` by scaled gradient ascent on the conditional
likelihood, whose gradient needs only the same marginals.

Scripts, styles, heads, titles, comments and form fields hold no text nodes. Character references are
decoded, white space in a block becomes one space, blocks are joined by one space in page order.
Defined results: null and empty html give an empty text; broken markup is read as browsers do in the
usual cases (unclosed elements end with their parent, stray end tags are ignored). A script or style
without an end takes the rest of the page; of a head or any other such element without an end only
the tag is skipped. A tag whose quotation never ends stops at the next ``>``, as do all tags after it;
a tag without any ``>`` is text. Elements nested more than ``DEEPEST`` deep hang below the one at that
depth. A page is read in time that grows with its length. Rows are read by themselves, also repeated
ones; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exchange import Batches
from tidemark.llm.labelled_pages import PAGES

STEPS, RATE, DECAY = 400, 0.2, 0.003
DEEPEST = 512
_TOKEN, _PLAIN = (
    re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({attributes})>|<[!?][^>]*+>", re.S)
    for attributes in (r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+", r"[^>]*+")
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_MARK = re.compile(r"(?:^|\s)([yn])(?=\s|/|$)")

# HTML's elements without content, with raw text, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg math head title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time "
    "tt u var wbr".split()
)
# An opening element on the left ends an open one on the right.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"},
}
_KEEPS_P = INLINE | VOID | RAW
GROUPS = [
    {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label"}, {"article", "main"},
    {"section"}, {"div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "thead", "tbody", "tr", "td", "th", "caption"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"body", "html"},
]
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
WORDS = [
    re.compile(w, re.I)
    for w in (
        r"\bads?\b|\bad[-_]|[-_]ad\b|advert|sponsor|promo|banner", r"nav|menu|breadcrumb", r"header|masthead|\btop\b", r"foot|copyright|legal",
        r"side|rail|widget", r"comment|repl(y|ies)|discuss|respond", r"cookie|consent|notice|popup|modal|alert",
        r"subscri|newsletter|signup|login|search|form", r"share|social|related|recommend|tags?\b", r"content|article|post|entry|story|main|body",
    )
]
_TEXT = len(GROUPS) + 1
_SIZES, _SHARES = (4, 10, 20, 50), (0.01, 0.3, 0.7)
N_FEATURES = _TEXT + 1 + len(WORDS) + len(_SIZES) + len(_SHARES) + 2


class Page:
    """Nodes of a page: parent, features, and the text of text nodes; ``mark`` holds labels."""

    def __init__(self, source: str) -> None:
        self.parent, self.features, self.texts, self.marks = [-1], [[len(GROUPS)]], [None], [None]
        self.level = [0]
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open_at: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        self._names: dict[int, list[int]] = {}
        self._pieces: list[str] = []
        self._token = _TOKEN
        self._link, self._linked, self._size = 0, 0, 0
        self._read(source)

    def _node(self, features: list[int], text: str | None, mark: str | None) -> int:
        up = self._stack[min(len(self._stack) - 1, DEEPEST)][1]
        self.parent.append(up)
        self.level.append(self.level[up] + 1)
        self.features.append(features)
        self.texts.append(text)
        self.marks.append(mark if mark is not None else self.marks[up])
        return len(self.parent) - 1

    def _flush(self) -> None:
        """End a block: its text becomes a node."""
        if not self._pieces:
            return
        words = "".join(self._pieces).split()
        if words:
            share = self._linked / max(1, self._size)
            last = words[-1][-1]
            features = [_TEXT]
            base = _TEXT + 1 + len(WORDS)
            features += [base + i for i, size in enumerate(_SIZES) if len(words) >= size]
            base += len(_SIZES)
            features += [base + i for i, cut in enumerate(_SHARES) if share >= cut]
            base += len(_SHARES)
            features += [base + (last not in ".!?:…。")]
            self._node(features, " ".join(words), None)
        self._pieces, self._linked, self._size = [], 0, 0

    def _say(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self._pieces.append(text)
        self._size += len(text)
        if self._link:
            self._linked += len(text)

    def _close(self, tags: set[str], until: frozenset[str]) -> None:
        """Pop to the nearest open element of ``tags``, unless one of ``until`` is nearer."""
        nearest = max((at[-1] for t in tags if (at := self._open_at.get(t))), default=0)
        if nearest and not any(at[-1] > nearest for t in until - tags if (at := self._open_at.get(t))):
            while len(self._stack) > nearest:
                self._open_at[self._stack.pop()[0]].pop()

    def _next(self, source: str, at: int, last: int) -> re.Match | None:
        """The next tag or comment from ``at``, none where only text is left; ``last`` is the last ``>``."""
        while (start := source.find("<", at)) >= 0:
            if start < last or source.startswith("<!--", start):
                found = self._token.match(source, start)
                if found is None and (found := _PLAIN.match(source, start)):
                    self._token = _PLAIN  # a quotation has no end
                if found:
                    return found
            at = start + 1
        return None

    @staticmethod
    def _raw_end(source: str, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, or -1."""
        end = re.compile(f"</{re.escape(tag)}(?=[\\s>/])", re.I).search(source, at)
        if end is None and tag == "head":
            end = re.compile(r"(?=<body\b)", re.I).search(source, at)
            return end.end() if end else -1
        return source.find(">", end.end()) + 1 or -1 if end else -1

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")
        endless: set[str] = set()
        while match := self._next(source, at, last):
            if match.start() > at:
                self._say(source[at : match.start()])
            at = match.end()
            tag = match[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not match[1] and not match[3].endswith("/"):
                    end = -1 if tag in endless else self._raw_end(source, tag, at)
                    if end >= 0:
                        at = end
                    elif tag in ("script", "style"):
                        at = len(source)
                    else:
                        endless.add(tag)
                if tag not in ("svg", "math"):
                    self._flush()
            elif tag in INLINE:
                if tag == "a":
                    self._link = 0 if match[1] else 1
            elif tag in VOID:
                if tag == "br":
                    self._say(" ")
                elif tag == "hr":
                    self._flush()
            elif match[1]:
                self._flush()
                self._link = 0
                self._close({tag}, frozenset(("td", "th", "table")) - {tag} if tag not in ("table", "tbody", "tr") else frozenset())
            else:
                self._flush()
                self._open(tag, match[3])
        if at < len(source):
            self._say(source[at:])
        self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        if self._stack[-1][0] == "p":
            self._open_at[self._stack.pop()[0]].pop()
        if tag in ENDS:
            self._close(ENDS[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        features = [_GROUP.get(tag, len(GROUPS))]
        mark = None
        if attributes:
            names = " ".join(_NAMES.findall(attributes))
            if names:
                features += [_TEXT + 1 + i for i, word in enumerate(WORDS) if word.search(names)]
            told = _MARK.search(attributes)
            mark = told and told[1]
        node = self._node(features, None, mark)
        self._open_at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, node))


class Forest:
    """Trees of many pages as arrays, nodes grouped by depth."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = [len(p.parent) for p in pages]
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        shift = np.repeat(self.first[:-1], sizes)
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, int(self.first[-1]))
        self.parent = np.where(parent < 0, -1, parent + shift)
        level = np.fromiter((x for p in pages for x in p.level), np.int64, len(parent))
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(level))[:-1]) if len(order) else []
        self.row = np.repeat(np.arange(len(parent)), [len(f) for p in pages for f in p.features])
        self.feature = np.fromiter((x for p in pages for f in p.features for x in f), np.int64, len(self.row))
        self.text = np.fromiter((t is not None for p in pages for t in p.texts), bool, len(parent))
        self.kind = self.text.astype(np.int64)  # the potential with the parent: of an element or of a text

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each node to be main text, and of each state pair with its parent."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.row, weights[self.feature], minlength=n)
        up, belief = np.zeros((n, 2)), own.copy()
        for nodes in self.levels[:0:-1]:  # messages to the parents, deepest first
            pair = edges[self.kind[nodes]] + belief[nodes][:, None, :]
            up[nodes] = np.logaddexp(pair[:, :, 0], pair[:, :, 1])
            np.add.at(belief, self.parent[nodes], up[nodes])
        joint = np.zeros((n, 2, 2))
        for nodes in self.levels[1:]:  # messages to the children, from the root
            rest = belief[self.parent[nodes]] - up[nodes]
            pair = edges[self.kind[nodes]] + belief[nodes][:, None, :] + rest[:, :, None]
            pair -= pair.max(axis=(1, 2), keepdims=True)
            pair = np.exp(pair)
            joint[nodes] = pair / pair.sum(axis=(1, 2), keepdims=True)
            down = edges[self.kind[nodes]] + rest[:, :, None]
            belief[nodes] += np.logaddexp(down[:, 0], down[:, 1])
        gap = np.clip(belief[:, 0] - belief[:, 1], -700, 700)
        return 1 / (1 + np.exp(gap)), joint


def train(sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and parent potentials from labelled pages."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    truth = np.array([m == "y" for p in pages for m in p.marks], int)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], truth[forest.parent[child]], truth[child]), 1)
    weights, edges = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    squares = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    for _ in range(STEPS):
        node, joint = forest.marginals(weights, edges)
        gradient = np.bincount(forest.feature, (truth - node)[forest.row], minlength=N_FEATURES)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.kind[child], joint[child])
        for held, total, slope in (
            (weights, squares[0], gradient / len(pages) - DECAY * weights),
            (edges, squares[1], (seen - expected) / len(pages) - DECAY * edges),
        ):
            total += slope**2
            held += RATE * slope / np.sqrt(total + 1e-12)
    return weights, edges


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(PAGES)


def main_texts(sources: list[str | None], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    """Main text of every page."""
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    keep = (forest.marginals(weights, edges)[0] >= 0.5) & forest.text
    return [
        " ".join(t for t, k in zip(page.texts, keep[a:b].tolist()) if k)
        for page, a, b in zip(pages, forest.first, forest.first[1:])
    ]


def extract(pages: DataFrame, column: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    weights, edges = model()

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                kept = [i for i, name in enumerate(part.schema.names) if name not in (column, text)]
                found = main_texts(part.column(column).to_pylist(), weights, edges)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in kept] + [pa.array(found, pa.string())],
                    names=[part.schema.names[i] for i in kept] + [text],
                )

    pages = pages.withColumn(column, F.col(column).cast("string"))
    shape = pages.drop(column, text).withColumn(text, F.lit(None).cast("string")).schema
    return pages.mapInArrow(read, shape)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
