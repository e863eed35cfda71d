"""Main text of web pages by a minimum cut (operator 11).

A page is read into blocks, the runs of text between block-level tags, and the elements that hold them. A classifier's log odds,
with what the elements around a block say of themselves, are the capacities between a block and the two terminals; neighbours in
the page and in the tree are tied by smoothness edges. The minimum cut leaves the main text on the source's side.

The classifier is a logistic regression on the form of a block. It is trained on blocks whose element says what they are
(article, main; nav, footer, aside, header, form), by Newton steps whose sums Spark takes over the sample.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches, stored

#: About so many pages, by a hash, are what the classifier is fitted on.
TRAIN_PAGES = 2_000
#: Fixed values of the HTML standard: elements without an end, elements whose content is no markup, elements that end a line.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: What a new element of a kind ends if it is open, up to the element that holds such elements.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
#: Elements that are never text of a page.
SILENT = frozenset(["head", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist", "button"])
#: What elements say of their blocks, in log odds, and the words of class and id that do.
SAYS = {"article": 3.0, "main": 2.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "header": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "fieldset": -4.0, "label": -4.0}
ROLES = {"main": 2.0, "article": 3.0, "navigation": -6.0, "banner": -6.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "dialog": -6.0, "alert": -6.0, "menu": -6.0, "menubar": -6.0, "form": -6.0}
AGAINST = frozenset(["ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promos", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "widget", "widgets", "related", "recommended", "recommendations", "popular", "trending", "share", "sharing", "social", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "footer", "header", "masthead", "topbar", "copyright", "disclaimer", "pager", "pagination", "toolbar", "search", "form", "aside", "skip", "hidden", "announcement", "warning", "paywall", "discussion", "responses", "guestbook", "adsense", "adsbygoogle", "outbrain", "taboola"])
FOR = frozenset(["article", "content", "post", "entry", "story", "main", "maincontent", "articlebody", "body", "text"])
#: Titles of sections that aren't the article, whole and in lower case.
SECTIONS = frozenset(["comments", "reader comments", "leave a comment", "leave a reply", "related articles", "related posts", "kommentare", "commentaires", "comentarios"])
#: Weight of an element's word by how many other elements with a word lie between it and the block.
FADE = (1.0, 0.5, 0.25, 0.125)
#: Edges: neighbours in the page (less as they are further apart in the tree), a block and its element, an element and its parent.
NEXT, HELD, NESTED = 0.6, 0.3, 0.2
#: The classifier's odds are at most this far from even, and begin from these weights.
LIMIT = 2.0
FEATURES = ["bias", "words", "link", "punctuation", "end", "digits", "capitals", "p", "heading", "li", "cell"]
PRIOR = np.array([-0.3, 0.5, -3.0, 0.3, 0.5, -0.5, -0.5, 0.8, 0.4, -0.4, -0.2])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


def _says(tag: str, attributes: str, open_tags: list[str]) -> tuple[float | None, bool]:
    """What an element says of its blocks (None: nothing), and whether it is hidden."""
    value = SAYS.get(tag)
    if tag == "header" and ("article" in open_tags or "main" in open_tags):
        value = None
    if not attributes or tag in ("html", "body"):
        return value, False
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I))
    value = ROLES.get(own.get("role", "").lower(), value)
    names = f"{own.get('class', '')} {own.get('id', '')}"
    if len(names) > 1:
        words = {w.lower() for w in _WORD.findall(names)} | {w.lower() for w in re.findall(r"[a-zA-Z]+", names)}
        against = words & AGAINST
        if against == {"header"} and words & FOR:
            pass  # an article's own title
        elif against and tag != "main":
            value = min(-6.0, value or 0.0)
        elif words & FOR:
            value = max(2.0, value or 0.0) if (value or 0) >= 0 else value
    return value, hidden


class Page:
    """Blocks of a page: text, tag, characters in links, element; and of each element its parent, tag and what it says."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.tags: list[str] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        self.parent, self.tag, self.says, self.depth = [-1], [""], [None], [0]
        self._stack, self._silent, self._parts, self._in_link, self._link = [(0, "")], 0, [], 0, None
        self._quiet: list[int] = []
        self._read(source)
        self._flush()
        self._wrappers()

    def _wrappers(self) -> None:
        """Elements around the whole page, whose names speak of what else is in them, say nothing: those around an article, or
        around the first title and half of the text."""
        inside, half = [0] * len(self.parent), sum(map(len, self.texts)) / 2
        for text, e in zip(self.texts, self.element):
            inside[e] += len(text)
        around, titled = [False] * len(self.parent), [False] * len(self.parent)
        for e in range(len(self.parent) - 1, 0, -1):
            up = self.parent[e]
            inside[up] += inside[e]
            around[up] |= around[e] or (self.tag[e] in ("article", "main") and (self.says[e] or 0) > 0)
            titled[up] |= titled[e] or self.tag[e] == "h1"
            if (self.says[e] or 0) < 0 and (self.tag[e] not in SAYS or self.tag[e] == "form") and (around[e] or titled[e] and inside[e] >= half):
                self.says[e] = None

    def _flush(self) -> None:
        if not self._parts:
            return
        text = " ".join("".join(self._parts).split())
        self._parts = []
        if text:
            element = self._stack[-1][0]
            self.texts.append(text), self.tags.append(self.tag[element]), self.linked.append(self._in_link), self.element.append(element)
            up = self.parent[element]
            if self.tag[element] in HEADINGS and text.lower().rstrip(":") in SECTIONS and self.tag[up] not in ("", "html", "body", "article", "main"):
                self.says[up] = -6.0
        self._in_link = 0

    def _say(self, text: str) -> None:
        if self._silent or not text:
            return
        text = html.unescape(text) if "&" in text else text
        self._parts.append(text)
        if self._link is not None:
            self._in_link += len(text)

    def _open(self, tag: str, attributes: str) -> None:
        value, hidden = _says(tag, attributes, [t for _, t in self._stack])
        self.parent.append(self._stack[-1][0]), self.tag.append(tag), self.says.append(value), self.depth.append(len(self._stack))
        self._stack.append((len(self.parent) - 1, tag))
        if hidden or tag in SILENT:
            self._silent += 1
            self._quiet.append(len(self._stack))

    def _close(self, upto: int) -> None:
        """Close the elements from place ``upto`` of the stack on."""
        while len(self._stack) > upto:
            if self._quiet and self._quiet[-1] == len(self._stack):
                self._quiet.pop()
                self._silent -= 1
            self._stack.pop()
        if self._link is not None and len(self._stack) < self._link:
            self._link = None

    def _last(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> int | None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][1] in tags:
                return i
            if self._stack[i][1] in within:
                return None
        return None

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                self._say(source[at:])
                return
            self._say(source[at : found.start()])
            at, (ends, tag, attributes) = found.end(), found.groups()[:3] if found[2] else found.groups()[3:]  # quotes without an end are signs
            if not tag:
                continue
            tag = tag.lower()
            block = tag in BLOCKS or tag in SILENT
            if ends:
                if tag == "a":
                    self._link = None
                elif tag == "br":
                    self._say(" ")
                elif block or tag == "label":
                    self._flush()
                    i = self._last((tag,))
                    if i is not None:
                        self._close(i)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag == "body":
                i = self._last(("head",))
                if i is not None:
                    self._close(i)
            if tag == "br":
                self._say(" ")
            elif tag == "a":
                self._link = len(self._stack)
            elif block or tag == "label":
                self._flush()
                if tag in BLOCKS:
                    i = self._last(("p",), ("button", "td", "th", "table", "li"))
                    if i is not None:
                        self._close(i)
                if tag in ENDS:
                    while (i := self._last(*ENDS[tag])) is not None:
                        self._close(i)
                if tag not in VOID and not attributes.rstrip().endswith("/"):
                    self._open(tag, attributes)

    def own_word(self, element: int) -> float:
        """What the elements around a block say, the nearest first."""
        total, k = 0.0, 0
        while element > 0 and k < len(FADE):
            if self.says[element] is not None:
                total += FADE[k] * self.says[element]
                k += 1
            element = self.parent[element]
        return total

    def features(self) -> np.ndarray:
        out = np.zeros((len(self.texts), len(FEATURES)))
        for i, (text, tag, linked) in enumerate(zip(self.texts, self.tags, self.linked)):
            n = len(text)
            kind = "heading" if tag in HEADINGS else "cell" if tag in ("td", "th") else tag if tag in ("p", "li") else None
            out[i, :7] = 1, math.log1p(text.count(" ") + 1), min(1.0, linked / n), min(1.0, 10 * len(_PUNCTUATION.findall(text)) / n), text[-1] in ".!?…\"'”»", sum(map(str.isdigit, text)) / n, sum(map(str.isupper, text)) / n
            if kind:
                out[i, FEATURES.index(kind)] = 1
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        """Smoothness edges between blocks and, numbered after them, the elements that hold some."""
        n, number, out = len(self.texts), {}, []
        for i, e in enumerate(self.element):
            if i:
                a, b, steps = self.element[i - 1], e, 0
                while a != b:
                    if self.depth[a] >= self.depth[b]:
                        a = self.parent[a]
                    else:
                        b = self.parent[b]
                    steps += 1
                out.append((i - 1, i, NEXT / (1 + 0.5 * steps)))
            if e not in number:
                number[e] = n + len(number)
            out.append((i, number[e], HELD))
        for e in list(number):
            while e > 0:
                up = self.parent[e]
                new = up not in number
                if new:
                    number[up] = n + len(number)
                out.append((number[e], number[up], NESTED))
                if not new:
                    break
                e = up
        return out


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source. A node's odds are its capacity from the source (to the sink, if they are negative).

    Nodes whose odds outweigh all their edges are settled first, which leaves the minimum as it is; flow decides the others.
    """
    n = len(odds)
    u = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(u[i]) < sum(near[i].values()) or (u[i] == 0 and near[i]):
            continue
        side[i] = u[i] > 0
        for j, w in near[i].items():
            u[j] += w if side[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        _flow(left, u, near, side)
    return [bool(x) for x in side]


def _flow(left: list[int], u: list[float], near: list[dict[int, float]], side: list[bool | None], least: float = 1e-12) -> None:
    """Maximum flow by levels of shortest paths among the nodes that are left."""
    number = {i: k for k, i in enumerate(left)}
    s, t = len(left), len(left) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def edge(a: int, b: int, x: float, y: float) -> None:
        out[a].append(len(to)), to.append(b), room.append(x)
        out[b].append(len(to)), to.append(a), room.append(y)

    for i in left:
        if u[i]:
            edge(*((s, number[i], u[i], 0.0) if u[i] > 0 else (number[i], t, -u[i], 0.0)))
        for j, w in near[i].items():
            if i < j:
                edge(number[i], number[j], w, w)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > least and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if t not in level:
            break
        turn, path, a = [0] * (t + 1), [], s
        while True:
            if a == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                a, path = to[path[k] ^ 1], path[:k]
                continue
            while turn[a] < len(out[a]) and not (room[out[a][turn[a]]] > least and level.get(to[out[a][turn[a]]]) == level[a] + 1):
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
    for i in left:
        side[i] = number[i] in level


def label(page: Page, weights: np.ndarray) -> tuple[list[float], list[bool]]:
    """Log odds of the blocks, and which of them are main text."""
    if not page.texts:
        return [], []
    odds = (np.clip(page.features() @ weights, -LIMIT, LIMIT) + [page.own_word(e) for e in page.element]).tolist()
    edges = page.edges()
    nodes = 1 + max(max(i, j) for i, j, _ in edges)
    return odds, minimum_cut(odds + [0.0] * (nodes - len(odds)), edges)[: len(odds)]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            for x, e in zip(page.features().tolist(), page.element):
                while e > 0 and page.tag[e] not in SAYS:
                    e = page.parent[e]
                if e > 0:
                    rows.append((1.0 if SAYS[page.tag[e]] > 0 else 0.0, x))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "x"])


def train(pages: DataFrame, sample: int = TRAIN_PAGES, rounds: int = 4, strength: float = 20.0) -> np.ndarray:
    """Weights for FEATURES: a Gaussian prior about PRIOR and the blocks of about ``sample`` pages whose element says what they
    are. A task gives sums of a fixed size for each round. Without such blocks the weights are PRIOR."""
    part = min(1.0, sample / max(1, pages.count()))
    few = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(part * 1_000_000)).select("html")
    rows = stored(few.mapInArrow(K.tidied(_examples), "y double, x array<double>"), "examples")
    size, weights = len(FEATURES), PRIOR.copy()
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size)
            for batch in batches:
                if batch.num_rows:
                    x, y = batch.column("x").flatten().to_numpy().reshape(-1, size), batch.column("y").to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                    total += np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["cell", "value"])

        total = np.zeros(size + size * size)
        for r in rows.mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            total[r.cell] = r.value
        step = total[:size] - strength * (weights - PRIOR)
        weights = weights + np.linalg.solve(total[size:].reshape(size, size) + strength * np.eye(size), step)
    return weights


def page_blocks(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """All blocks in page order: page_id, block (from 0), tag, text, odds and main."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, source in zip(batch.column("page_id"), batch.column("html")):
                page = Page(source.as_py() or "")
                odds, main = label(page, weights)
                n = len(odds)
                yield pa.RecordBatch.from_arrays([pa.array([page_id.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(page.tags, pa.string()), pa.array(page.texts, pa.string()), pa.array(odds, pa.float64()), pa.array(main, pa.bool_())], names=["page_id", "block", "tag", "text", "odds", "main"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(K.tidied(run), "page_id long, block int, tag string, text string, odds double, main boolean")


def main_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text (main blocks joined by line feeds) and n_chars of each page; trains the classifier if no weights are given.

    White space within a block is one space; character references are decoded; scripts, styles, controls of forms and hidden
    elements are no text. A null or empty html, and a page without main text, give an empty text. Rows that repeat a page_id, or
    have none, have a row each; an empty table gives an empty result; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    if weights is None:
        weights = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                texts.append("\n".join(t for t, main in zip(page.texts, label(page, weights)[1]) if main))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(K.tidied(run), "page_id long, url string, text string, n_chars long")
