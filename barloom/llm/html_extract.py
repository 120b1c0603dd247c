"""Main text of web pages by a tree-structured graphical model.

Each element and each piece of text in a page's tree is main text or not. What a node looks like
(its tag, the words of its class, id and role, how much text and how much of it in links) gives its own
potential, with its share of the page's text and the paragraphs beside it; a table of potentials joins each node to
its parent. What holds both kinds is labelled as most of its text. Messages pass upward and then downward
(sum-product), which gives exact marginals on a tree, and pieces of text that are more likely main
text than not are kept. The weights maximise the likelihood of labelled pages by the same two passes.

Pages are parsed in tasks, one by one; the message passing runs level by level over the trees of up to
64 pages at once, or of fewer if they are over 4 MB together.

Defined cases: a null or empty page, or one without main text, gives an empty text; unclosed and
misnested tags are closed as browsers do for the common cases, an open head at the first tag or text
that can't stand in it, a tag that the page's end cuts off is dropped, and what is opened within 400 open
elements stands beside the innermost; a page takes time in proportion to its length; scripts, styles, comments and
the head give no text; rows that repeat give the same text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.labelled_pages import PAGES
from barloom.llm.shared import bodies

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head script style noscript template title textarea select option button svg iframe object canvas".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALL = frozenset("ul ol dl table tr td th div section article main body html aside nav header footer form blockquote".split())
_DEEPEST = 400  #: open elements; what is opened within so many stands beside the innermost, as in browsers
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: a tag's attributes; a quote opens a value only right after the "=" of a name
_ATTRS = r"(?>[\s/]+|[^\s/>][^\s/>=]*+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*|(?=>))|(?!\s*=)))*+"
_TOKEN = re.compile(rf"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: words of classes, ids and roles, by what they tell
_WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar topbar links skip".split(),
    "header": "header masthead hero topper logo branding".split(),
    "footer": "footer copyright colophon legal bottom contentinfo".split(),
    "side": "sidebar aside side widget widgets related recommended popular more next toc complementary".split(),
    "notice": "cookie cookies consent gdpr notice notices alert alerts banner popup modal overlay message warning".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp outbrain taboola".split(),
    "form": "form login signup signin search subscribe subscription newsletter register contact poll survey".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus reader readers responses feedback".split(),
    "share": "share sharing social follow tags meta byline author date".split(),
    "main": "article content main post entry story body text page prose".split(),
}
_KIND = {w: k for k, words in _WORDS.items() for w in words}
_CUES = re.compile(r"©|copyright|all rights reserved|cookie|subscribe|sign (?:in|up)|log ?in|advertis|read more|share this|comments?\b|newsletter", re.I)


class Tree:
    """A page's nodes in order: parents, and tags of elements or texts of pieces."""

    __slots__ = ("parent", "tag", "text", "words", "main", "depth")

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.text, self.words, self.main, self.depth = [-1], ["html"], [None], [()], [None], [0]
        stack, silent, at, end = [0], 0, 0, len(html)
        open_: Counter[str] = Counter()  # of each name how many are open, so that nothing is looked for in vain
        find, match = html.find, _TOKEN.match
        while at < end:
            begin = find("<", at)
            while begin >= 0 and not (m := match(html, begin)):
                begin = find("<", begin + 1)
            stop = begin if begin >= 0 else end
            if silent and stop > at and self.tag[stack[-1]] == "head" and html[at:stop].strip(" \t\n\f\r"):
                silent -= self._leave_head(stack, open_)
            if stop > at and not silent:
                text = html[at:stop]
                self._add(stack[-1], "", unescape(text) if "&" in text else text, (), None)
            if begin < 0:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if open_[name]:
                    silent -= self._close(stack, open_, next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name))
                continue
            if silent and name not in _IN_HEAD and open_["head"]:
                silent -= self._leave_head(stack, open_)
            if name in ("html", "body"):
                continue
            shut = {"p"} if name in _BLOCK else _CLOSES.get(name, ())
            if name in _CLOSES:
                shut = {*_CLOSES[name], "p"}
            for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in shut) else ():
                tag = self.tag[stack[k]]
                if tag in shut:
                    silent -= self._close(stack, open_, k)
                    if name not in _CLOSES:
                        break
                elif tag in _WALL and not (name in ("tr", "td", "th") and tag in ("tr", "td", "th")):
                    break
            attrs = m[3] or ""
            node = self._add(stack[-1], name, None, tuple(sorted({_KIND[w] for a in _ATTR.findall(attrs) for w in _WORD.findall("".join(a).lower()) if w in _KIND})) if "=" in attrs else (), re.search(r'data-main="([01])"', attrs) if "data-main" in attrs else None)
            if name in _VOID or attrs.endswith("/"):
                continue
            if name in _RAW:
                close = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if len(stack) < _DEEPEST:
                stack.append(node)
                open_[name] += 1
                silent += name in _SILENT

    def _close(self, stack: list[int], open_: Counter[str], k: int) -> int:
        """Closes all from the k-th open element on; how many silent ones that are."""
        gone = [self.tag[v] for v in stack[k:]]
        del stack[k:]
        open_.subtract(gone)
        return sum(t in _SILENT for t in gone)

    def _leave_head(self, stack: list[int], open_: Counter[str]) -> int:
        """Closes an open head; how many silent elements that closes."""
        tags = [self.tag[v] for v in stack]
        if "head" not in tags:
            return 0
        k = tags.index("head")
        if "template" in tags[k:] or "noframes" in tags[k:]:  # their content isn't the page's
            return 0
        return self._close(stack, open_, k)

    def _add(self, parent: int, tag: str, text: str | None, words: tuple[str, ...], main: re.Match | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.text.append(text)
        self.words.append(words)
        self.main.append(None if main is None else main[1] == "1")
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def looks(self) -> list[list[str]]:
        """The names of each node's features: what it is and says, how much of the page's text it has, and what
        stands beside it."""
        n = len(self.parent)
        chars, linked, long = [0] * n, [0] * n, [0] * n
        for v in range(1, n):
            if self.text[v] is not None and not self.text[v].isspace():
                chars[v] = len(self.text[v]) - self.text[v].count(" ")
        for v in range(n - 1, 0, -1):
            if self.tag[v] == "a":
                linked[v] = chars[v]
            p = self.parent[v]
            chars[p] += chars[v]
            linked[p] += linked[v]
            long[p] += chars[v] >= 60 and 2 * linked[v] < chars[v]
        whole = max(1, chars[0])
        last: dict[int, int] = {}  # of each element the child before
        near = [0] * n
        for v in range(1, n):
            if self.text[v] is None:
                p = self.parent[v]
                if p in last:
                    u = last[p]
                    near[v] += chars[u] >= 60 and 2 * linked[u] < chars[u]
                    near[u] += chars[v] >= 60 and 2 * linked[v] < chars[v]
                last[p] = v
        inside = [False] * n
        out = []
        for v in range(n):
            p = self.parent[v]
            size = "0" if not chars[v] else "1" if chars[v] < 20 else "2" if chars[v] < 60 else "3" if chars[v] < 200 else "4"
            if self.text[v] is None:
                inside[v] = self.tag[v] == "a" or (p >= 0 and inside[p])
                share = linked[v] / chars[v] if chars[v] else 0
                part = 4 * chars[v] // whole
                links = "2" if share > 0.6 else "1" if share > 0.25 else "0"
                tag = self.tag[v]
                names = ["element", f"at={self.tag[p] if p >= 0 else ''}", f"tag={tag}", f"size={size}", f"links={links}", f"part={part}", f"long={min(long[v], 3)}", f"near={near[v]}", f"{tag}:{size}:{links}", f"share={part}{min(long[v], 3)}{links}"]
                names += [f"word={w}" for w in self.words[v]]
                names += [f"word={w}:{'much' if part >= 2 else 'little'}" for w in self.words[v]]
            else:
                text = self.text[v].rstrip()
                names = ["text", f"in={self.tag[p]}", f"text={size}", f"by={near[p]}", f"{self.tag[p]}:{size}:{near[p]}"]
                if inside[p]:
                    names.append("linked")
                if text[-1:] in ".!?…":
                    names.append("sentence")
                if chars[v] < 50 and _CUES.search(text):
                    names.append(f"cue:{near[p]}")
            out.append(names)
        return out

    def labels(self) -> list[float]:
        """1 for main text, from the marks of labelled pages; what holds both kinds counts as what most of its text is."""
        n = len(self.parent)
        out: list[float | None] = []
        for v, mark in enumerate(self.main):
            out.append(float(mark) if mark is not None else out[self.parent[v]] if v else None)
        every, kept = [0] * n, [0.0] * n
        for v in range(n - 1, 0, -1):
            if self.text[v] is not None and not self.text[v].isspace():
                every[v] = len(self.text[v])
                kept[v] = every[v] * (out[v] or 0.0)
            every[self.parent[v]] += every[v]
            kept[self.parent[v]] += kept[v]
        return [float(2 * kept[v] > every[v]) if x is None and self.text[v] is None else x or 0.0 for v, x in enumerate(out)]

    def blocks(self, keep: list[bool]) -> str:
        """The kept pieces: white space made one space, and a line for each block."""
        lines: list[list[str]] = [[]]
        n = len(self.parent)
        open_: list[int] = [0]
        for v in range(1, n):
            while open_[-1] != self.parent[v]:
                if self.tag[open_.pop()] in _BLOCK:
                    lines.append([])
            if self.text[v] is None:
                if self.tag[v] in _BLOCK:
                    lines.append([])
                elif self.tag[v] == "br":
                    lines[-1].append(" ")
                open_.append(v)
            elif keep[v]:
                lines[-1].append(self.text[v])
        joined = (" ".join("".join(x).split()) for x in lines)
        return "\n".join([x for x in joined if x])


class Forest:
    """Many trees as arrays, for messages that pass a level at a time."""

    def __init__(self, trees: list[Tree]) -> None:
        self.starts = np.cumsum([0, *(len(t.parent) for t in trees)])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, self.starts)]) if trees else np.empty(0, dtype=np.int64)
        depth = np.concatenate([np.array(t.depth) for t in trees]) if trees else np.empty(0, dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.piece = np.array([x is not None for t in trees for x in t.text], dtype=np.int64)

    def pass_messages(self, own: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of being main text for each node, and of (parent, child) states for each child.

        ``own`` are the nodes' log potentials for main text over not; ``joint`` has log potentials
        [kind of child, parent's state, child's state]."""
        n = len(own)
        base = np.stack([np.zeros(n), own], axis=1)
        up, sent = base.copy(), np.zeros((n, 2))
        for nodes in reversed(self.levels[1:]):
            both = joint[self.piece[nodes]] + up[nodes][:, None, :]
            sent[nodes] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[nodes], sent[nodes])
        full = up.copy()
        pairs = np.zeros((n, 2, 2))
        for nodes in self.levels[1:]:
            rest = full[self.parent[nodes]] - sent[nodes]  # what the parent hears from all others
            both = joint[self.piece[nodes]] + rest[:, :, None]
            full[nodes] = up[nodes] + np.logaddexp(both[:, 0], both[:, 1])
            table = both + up[nodes][:, None, :]
            table -= table.max(axis=(1, 2), keepdims=True)
            table = np.exp(table)
            pairs[nodes] = table / table.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pairs


class Model:
    """Weights of the features, and the table that joins a node to its parent."""

    def __init__(self, weights: dict[str, float], joint: np.ndarray) -> None:
        self.weights, self.joint = weights, joint

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        get = self.weights.get
        forest = Forest(trees)
        own = np.array([sum([get(x, 0.0) for x in names]) for t in trees for names in t.looks()])
        chance, _ = forest.pass_messages(own, self.joint)
        return [chance[a:b] for a, b in zip(forest.starts, forest.starts[1:])]

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [Tree(p or "") for p in pages]
        return [t.blocks((chance >= 0.5).tolist()) for t, chance in zip(trees, self.marginals(trees))] if trees else []

    @classmethod
    def fit(cls, pages: list[str], steps: int = 220, rate: float = 0.15, ridge: float = 0.0005) -> Model:
        """Gradient ascent (with running scales) on the likelihood of the labels of ``pages``."""
        trees = [Tree(p) for p in pages]
        forest = Forest(trees)
        looks = [names for t in trees for names in t.looks()]
        names = sorted({x for row in looks for x in row})
        index = {x: k for k, x in enumerate(names)}
        node = np.array([v for v, row in enumerate(looks) for _ in row])
        feature = np.array([index[x] for row in looks for x in row])
        y = np.array([x for t in trees for x in t.labels()])
        child = forest.parent >= 0
        seen = np.zeros((2, 2, 2))
        np.add.at(seen, (forest.piece[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
        theta, first, second = np.zeros(len(names) + 8), np.zeros(len(names) + 8), np.zeros(len(names) + 8)
        for step in range(1, steps + 1):
            w, joint = theta[:-8], theta[-8:].reshape(2, 2, 2)
            own = np.bincount(node, w[feature], minlength=len(y))
            chance, pairs = forest.pass_messages(own, joint)
            slope = np.bincount(feature, (y - chance)[node], minlength=len(names))
            expected = np.stack([pairs[child & (forest.piece == k)].sum(axis=0) for k in (0, 1)])
            grad = np.concatenate([slope, (seen - expected).ravel()]) / len(trees) - ridge * theta
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        return cls(dict(zip(names, theta[:-8].tolist())), theta[-8:].reshape(2, 2, 2))


def extract(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(Model.fit(labelled or PAGES))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, raw in bodies(batch.column(2), 64):
                part = batch.slice(a, len(raw))
                texts = shared.value.texts([p and p.decode() for p in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    light = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    schema = T.StructType([*light.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return light.mapInArrow(extracted, schema)
