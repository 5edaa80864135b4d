"""Main-text extraction by a tree-structured graphical model over DOM nodes.

Every element is a node that is frame (holds the page together), content (the article) or boiler (menus, headers,
footers, sidebars, notices, adverts, forms, comments). Content and boiler are two states each: the element that
begins such a region, and those within it, since what begins a region has telling tags and names and what lies
within has not. A node's potential scores its features - tag, words of its class, id and role, amount of text,
share of link text, sentence ends - and each parent-child edge has a potential over their states. The tree has no
cycles, so one upward and one downward pass of sum-product messages give exact marginals; text whose element is
content with more than half the mass is the article's.

Both kinds of potential are frequencies, smoothed, counted in Spark over pages whose elements carry labels. Pages
are parsed one by one in tasks; messages of all pages of a slice are passed together, level by level, in numpy.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.labelled_pages import LABEL_ATTRIBUTE, labelled_pages

LABELS = ("frame", "content", "boiler")
FRAME, CONTENT_ROOT, CONTENT, BOILER_ROOT, BOILER = range(5)
STATES = 5
SLICE = 256
#: Amount, links and sentence ends of an element and of those around it say much the same, so each counts in part.
TEXT_WEIGHT = 0.35
#: What lies within a region says little of its kind, and says it over and over: that difference counts in small part.
INNER_WEIGHT = 0.05

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is raw text up to their end tag or, without one, the page's end.
RAW_TEXT = frozenset("script style title textarea".split())
#: Elements whose inside a browser does not show as text of the page: raw text, what stands in for something else, drawings and choices of forms.
DROPPED = RAW_TEXT | frozenset("noscript template iframe svg object select option".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An opening tag ends an open element of its kind up to the nearest of the given elements.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "body": (("head",), ()),
}

_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|aria-label|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HINT = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。]")


@dataclass
class Page:
    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    hints: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    labels: list[int] = field(default_factory=lambda: [0])  # places in LABELS
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, decoded text


class _Markup:
    """Finds a page's tags, comments and declarations in time linear in its length.

    A tag ends at the first `>` outside quotes. Where none comes, its `<` is text; what is known of such places is
    kept, so that no stretch is searched again for each `<` in it.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = {mark: source.rfind(mark) for mark in ">\"'"}
        self.hopeless: set[int] = set()  # places outside quotes of > " ' from which no tag ends
        self.searched = (0, -1)  # the first special character from a place on
        self.ends: dict[str, re.Pattern] = {}
        self.unended: set[str] = set()

    def _special(self, at: int) -> int:
        start, found = self.searched
        if not start <= at <= found:
            match = _SPECIAL.search(self.source, at)
            found = match.start() if match else len(self.source)
            self.searched = (at, found)
        return found

    def _close(self, at: int) -> int:
        """The place of the `>` that ends the tag whose inside is read from `at` on, or -1."""
        source, seen, size = self.source, [], len(self.source)
        at = self._special(at)
        while at < size and at not in self.hopeless:
            mark = source[at]
            if mark == ">":
                return at
            seen.append(at)
            if self.last[mark] <= at:
                break
            match = _SPECIAL.search(source, source.index(mark, at + 1) + 1)
            at = match.start() if match else size
        self.hopeless.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Start and end of the next tag, comment or declaration, and the match of a tag's beginning; (n, n, None) at the end."""
        source, size = self.source, len(self.source)
        while (start := source.find("<", at)) >= 0:
            follows = source[start + 1 : start + 2]
            if follows == "!" and source.startswith("!--", start + 1):
                end = source.find("-->", start + 4)
                return start, size if end < 0 else end + 3, None
            if self.last[">"] < start:
                break  # nothing ends any more, but a comment may still begin
            if follows and follows in "!?":
                return start, source.index(">", start) + 1, None
            tag = _TAG.match(source, start)
            if tag:
                end = self._close(tag.end())
                if end >= 0:
                    return start, end + 1, tag
            at = start + 1
        start = source.find("<!--", max(at, 0))
        return (start, size, None) if start >= 0 else (size, size, None)

    def raw_end(self, tag: str, at: int) -> int:
        """Where a raw element's inside and end tag end."""
        if tag in self.unended:
            return len(self.source)
        pattern = self.ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.IGNORECASE))
        end = pattern.search(self.source, at) if self.last[">"] >= at else None
        if end is None:
            self.unended.add(tag)
        return end.end() if end else len(self.source)


class _Open:
    """The open elements, with where those of each name stand among them."""

    def __init__(self, page: Page) -> None:
        self.page, self.nodes = page, [0]
        self.named: dict[str, list[int]] = {}
        self.blocks = [0]  # those that are not inline

    def push(self, node: int) -> None:
        tag = self.page.tags[node]
        depth = len(self.nodes)
        self.named.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.blocks.append(depth)
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The depth of the innermost open element of any of the names, 0 if there is none."""
        return max((found[-1] for tag in tags if (found := self.named.get(tag))), default=0)

    def close(self, depth: int) -> None:
        while len(self.nodes) > depth:
            tag = self.page.tags[self.nodes.pop()]
            self.named[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()


def parse(source: str | None, labelled: bool = False) -> Page:
    """The elements and texts of a page; tolerant of unclosed, misnested and cut-off markup. Only labelled pages' labels are read.

    Takes time in proportion to the page's length, whatever its markup: nothing is searched twice, and elements are
    found by name among the open ones.
    """
    page = Page()
    if not source:
        return page
    markup, opened = _Markup(source), _Open(page)
    block, at, n = 0, 0, len(source)
    while at < n:
        text_from = at
        start, at, found = markup.next(at)
        if start > text_from:
            page.texts.append((opened.nodes[-1], block, html_lib.unescape(source[text_from:start])))
        if found is None:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            depth = opened.last(tag)
            if depth and (tag not in INLINE or depth > opened.blocks[-1]):
                opened.close(depth)
            block += tag not in INLINE
            continue
        attrs = source[found.end() : at - 1]
        selfclosed = attrs.endswith("/")
        if tag in DROPPED and not selfclosed:
            at = markup.raw_end(tag, at) if tag in RAW_TEXT else _dropped_end(markup, tag, at, opened)
            continue
        if tag in CLOSES_P and (depth := opened.last("p")):
            opened.close(depth)
        if tag in SIBLINGS:
            own, until = SIBLINGS[tag]
            while (depth := opened.last(*own)) > opened.last(*until):
                opened.close(depth)
                if tag != "tr":
                    break
        block += tag not in INLINE
        if tag == "br":
            page.texts.append((opened.nodes[-1], block, " "))
        if tag in VOID:
            continue
        hints, label = _attributes(attrs, labelled) if attrs.strip() else ((), None)
        parent = opened.nodes[-1]
        page.tags.append(tag)
        page.parents.append(parent)
        page.depths.append(page.depths[parent] + 1)
        page.hints.append(hints)
        page.labels.append(page.labels[parent] if label is None else label)
        if not selfclosed or tag in INLINE or tag in CLOSES_P:
            opened.push(len(page.tags) - 1)
    return page


def _dropped_end(markup: _Markup, dropped: str, at: int, around: _Open) -> int:
    """Where what follows a dropped element begins: past its own end tag, or at the end tag of an element around it.

    An option also ends where the next option or a block begins.
    """
    inner, opened, n = [dropped], Counter([dropped]), len(markup.source)
    while at < n:
        start, at, found = markup.next(at)
        if found is None:
            continue
        tag = found["tag"].lower()
        selfclosed = markup.source[at - 2] == "/"
        if found["end"]:
            if opened[tag]:
                while (last := inner.pop()) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
                if not inner:
                    return at
            elif around.last(tag):
                return start
        elif dropped == "option" and (tag in CLOSES_P or tag in ("option", "optgroup")):
            return start
        elif not selfclosed and tag in RAW_TEXT:
            at = markup.raw_end(tag, at)
        elif not selfclosed and tag not in VOID:
            inner.append(tag)
            opened[tag] += 1
    return n


def _attributes(attrs: str, labelled: bool) -> tuple[tuple[str, ...], int | None]:
    hints: set[str] = set()
    label = None
    for name, *values in _ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "").lower()
        if name.lower() == LABEL_ATTRIBUTE:
            label = LABELS.index(value) if labelled and value in LABELS else label
        else:
            hints.update(x for x in _HINT.findall(value) if len(x) > 1)
    return tuple(sorted(hints)), label


def states(page: Page) -> list[int]:
    """The labelled state of each node: a node begins a region if its parent's label is another."""
    inner = (FRAME, CONTENT, BOILER)
    begun = (FRAME, CONTENT_ROOT, BOILER_ROOT)
    return [(inner if parent >= 0 and page.labels[parent] == label else begun)[label] for label, parent in zip(page.labels, page.parents)]


def _bucket(n: int) -> int:
    return 0 if n == 0 else 1 if n < 25 else 2 if n < 100 else 3 if n < 400 else 4


def features(page: Page) -> list[tuple]:
    """For each node (tag, text amount, link share, sentence end, hints)."""
    n = len(page.tags)
    chars, linked, ends = [0] * n, [0] * n, [False] * n
    for node, _, text in page.texts:
        size = len(text.strip())
        if size:
            chars[node] += size
            ends[node] = ends[node] or bool(_SENTENCE.search(text))
    for node in range(n - 1, 0, -1):  # children come after their parents
        parent = page.parents[node]
        if page.tags[node] == "a":
            linked[node] = chars[node]
        chars[parent] += chars[node]
        linked[parent] += linked[node]
        ends[parent] = ends[parent] or ends[node]
    share = [0 if not c else 3 if 2 * k > c else 2 if 5 * k > c else 1 if k else 0 for c, k in zip(chars, linked)]
    return list(zip(page.tags, map(_bucket, chars), share, ends, page.hints))


def _keys(feature: tuple) -> list[str]:
    tag, amount, share, ends, hints = feature
    return [f"tag={tag}" if hints else f"tag={tag}/plain", f"amount={amount}", f"links={share}", f"ends={int(ends)}", *(f"hint={h}" for h in hints), *([f"names={'+'.join(hints)}"] if hints else [])]


@dataclass
class TreeModel:
    """Log potentials: of features by state, of edges by parent's and child's state, of the root."""

    feature_scores: dict[str, np.ndarray]
    edge: np.ndarray
    root: np.ndarray

    def node_score(self, feature: tuple) -> np.ndarray:
        known = [k for k in map(self._known, _keys(feature)) if k]
        score = sum((self.feature_scores[k] * (TEXT_WEIGHT if k.startswith(("amount", "links", "ends")) else 1.0) for k in known), np.zeros(STATES))
        inner = score[[CONTENT, BOILER]]
        score[[CONTENT, BOILER]] = inner.mean() + INNER_WEIGHT * (inner - inner.mean())
        return score

    def _known(self, key: str) -> str | None:
        """The key itself, or for a new name the longest known one of four letters or more that it starts with."""
        least = len(key) if not key.startswith("hint=") else min(len(key), len("hint=") + 4)
        return next((key[:n] for n in range(len(key), least - 1, -1) if key[:n] in self.feature_scores), None)

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """P(state) of every node of every page, by sum-product over the forest of all the pages' trees."""
        scores: dict[tuple, int] = {}
        rows = [scores.setdefault(f, len(scores)) for page in pages for f in features(page)]
        phi = np.array([self.node_score(f) for f in scores])[rows]
        sizes = [len(p.tags) for p in pages]
        first = np.concatenate(([0], np.cumsum(sizes)))
        depth = np.concatenate([p.depths for p in pages])
        parent = np.concatenate([np.asarray(p.parents) + at for p, at in zip(pages, first)])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        below = phi.copy()  # a node's potential and what its children say
        up = np.zeros_like(phi)  # message to the parent, by the parent's state
        for level in reversed(levels[1:]):
            up[level] = _log_sum(self.edge[None] + below[level][:, None, :])
            np.add.at(below, parent[level], up[level])
        belief = below.copy()
        belief[levels[0]] += self.root
        for level in levels[1:]:
            others = belief[parent[level]] - up[level]  # all that the parent knows from elsewhere
            others -= others.max(axis=1, keepdims=True)
            belief[level] = below[level] + _log_sum(self.edge.T[None] + others[:, None, :])
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return np.split(p / p.sum(axis=1, keepdims=True), first[1:-1])


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=2)
    return top + np.log(np.exp(x - top[..., None]).sum(axis=2))


def main_text(page: Page, marginal: np.ndarray) -> str:
    """The content's blocks in page order, one on a line, white space within a block made single spaces."""
    content = (marginal[:, CONTENT_ROOT] + marginal[:, CONTENT] > 0.5).tolist()
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if content[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def fit(pages: DataFrame, *, html_col: str = "html", smoothing: float = 0.02) -> TreeModel:
    """Counts features and edges by state over pages labelled with data-label attributes (see labelled_pages).

    An element without a label has its parent's. What reaches the driver is one row for each distinct feature
    and state: bounded by the words that the labelled pages use, not by the pages to be extracted.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for source in batch.column(0).to_pylist():
                page = parse(source, labelled=True)
                labelled = states(page)
                for feature, state, parent in zip(features(page), labelled, page.parents):
                    found["root" if parent < 0 else f"edge={labelled[parent]}", state] += 1
                    found["nodes", state] += 1
                    for key in _keys(feature):
                        found[key, state] += 1
            keys, of = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(of, pa.int32()), pa.array(found.values(), pa.int64())], names=["key", "state", "n"])

    table = pages.select(html_col).mapInArrow(counted, "key string, state int, n long").groupBy("key", "state").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in table:
        counts.setdefault(r["key"], np.zeros(STATES))[r["state"]] = r["n"]
    nodes, root = counts.pop("nodes"), counts.pop("root")
    edge = np.array([counts.pop(f"edge={s}", np.zeros(STATES)) + smoothing for s in range(STATES)])
    # potentials need not be probabilities: staying within a region costs nothing, or long regions would lose by their length alone
    edge /= edge.sum(axis=1, keepdims=True)
    for state, inner in ((CONTENT_ROOT, CONTENT), (CONTENT, CONTENT), (BOILER_ROOT, BOILER), (BOILER, BOILER)):
        edge[state] /= edge[state, inner]
    return TreeModel(
        {k: np.log((v + smoothing) / (nodes + 2 * smoothing)) for k, v in counts.items()},
        np.log(edge), np.log((root + smoothing) / (root + smoothing).sum()),
    )


def default_model(spark: SparkSession) -> TreeModel:
    return fit(spark.createDataFrame([(x,) for x in labelled_pages()], "html string"))


def extract(pages: DataFrame, model: TreeModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every row.

    Null, empty or markup-free input without content has an empty text. Cut-off and misnested pages are read as
    far as they go, pages of any length whole. Repeated rows are extracted one by one; no rows give none. Other
    columns are not carried.
    """
    source = pages.select(id_col, url_col, html_col)
    given = source.sparkSession.sparkContext.broadcast(model)  # as large as the labelled pages' vocabulary
    schema = T.StructType([*source.schema[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                parsed = [parse(x) for x in batch.column(2).to_pylist()]
                texts = [main_text(p, m) for p, m in zip(parsed, given.value.marginals(parsed))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
