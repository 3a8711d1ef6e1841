"""Operator 3: HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks of text, each with the tags, classes, ids and roles above it. A bidirectional
LSTM in numpy reads a vector of each block's path, of its hashed words and of its form, over the whole page, and
labels each block as main text or not. It is trained here on pages made up from lists of common markup.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import small_batches

#: Made-up pages that are learnt from, and sizes of the model.
TRAIN_PAGES, EPOCHS, RATE = 1000, 4, 0.01
PATHS, WORDS, PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 2048, 4096, 16, 6, 8, 16
#: Elements that make blocks, that hold no text to read, that have no end, and that end an open one of their kind.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("head title script style template noscript svg math iframe object textarea select button audio video canvas datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?|<[!?/][^>]*>?""", re.S)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


@lru_cache(20_000)
def path_features(tag: str, attrs: str) -> tuple[int, ...]:
    """Buckets of a tag and of the parts of its class, id and role."""
    parts = [tag]
    for m in ATTR.finditer(attrs):
        value = unescape(m[2] or m[3] or m[4] or "")
        parts += ["." + x.lower() for x in NAME.findall(value)] + ["#" + x.lower() for x in value.split()]
    return tuple(zlib.crc32(x.encode()) % PATHS for x in parts)


class Page(list):
    """(node, text, characters within links) of each leaf block with text, in page order. A node of the page's tree is its parent, its depth and its features; the first has none."""

    def __init__(self):
        super().__init__()
        self.nodes: list[tuple[int, int, tuple[int, ...]]] = [(0, 0, ())]


#: Elements that end another of their kind, or that bar this, when they begin.
MARKS = frozenset(ENDS) | {"ul", "ol", "table", "dl", "article", "section", "div", "menu", "nav"}
RAW_END = {tag: re.compile(rf"</{tag}", re.I) for tag in RAW}


def blocks(html: str | None) -> Page:
    """The blocks of a page; white space within one is one space each. Time and memory are linear in the page, however deep its elements lie."""
    out = Page()
    if not html:
        return out
    stack, marks, parts, linked, at, silent, inside_a = [], [], [], 0, 0, 0, 0  # marks: places in the stack of MARKS
    open_: Counter = Counter()
    n, search = len(html), TAG.search

    def close_block():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((stack[-1][1] if stack else 0, text, linked))
        parts, linked = [], 0

    def pop():
        nonlocal silent, inside_a
        tag = stack.pop()[0]
        open_[tag] -= 1
        if marks and marks[-1] == len(stack):
            marks.pop()
        silent -= tag in SILENT
        inside_a -= tag == "a"
        return tag

    def text(s):
        nonlocal linked
        if s and not silent:
            s = unescape(s) if "&" in s else s
            parts.append(s)
            if inside_a:
                linked += len(s)

    while at < n:
        m = search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                close_block()
            while open_[tag] and pop() != tag:
                pass
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            close_block()
            if tag in ENDS_P:
                while open_["p"] and pop() != "p":
                    pass
            ends = ENDS.get(tag, "").split()
            k = len(marks) - 1
            while k >= 0 and any(open_[e] for e in ends):
                name = stack[marks[k]][0]
                if name in ends:
                    keep = marks[k]
                    while len(stack) > keep:
                        pop()
                elif name not in ENDS:
                    break
                k -= 1
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag == "body":
            while stack and stack[-1][0] != "html":
                pop()
        if tag in MARKS:
            marks.append(len(stack))
        out.nodes.append((stack[-1][1] if stack else 0, len(stack) + 1, path_features(tag, m[3])))
        stack.append((tag, len(out.nodes) - 1))
        open_[tag] += 1
        silent += tag in SILENT
        inside_a += tag == "a"
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.start() if end else n
    close_block()
    return out


class Paths:
    """The nodes of pages, those of each depth together: sums of features run down the trees, gradients run up."""

    def __init__(self, pages: list[Page]):
        first = np.cumsum([0, *(len(p.nodes) for p in pages)])
        flat = [x for p in pages for x in p.nodes]
        self.parent = np.fromiter((x[0] for x in flat), np.int64, len(flat)) + np.repeat(first[:-1], np.diff(first))
        depth = np.fromiter((x[1] for x in flat), np.int64, len(flat))
        self.size = np.fromiter((len(x[2]) for x in flat), np.int64, len(flat))
        self.ids = np.fromiter((f for x in flat for f in x[2]), np.int64, self.size.sum())
        self.of = np.fromiter((b[0] + o for p, o in zip(pages, first.tolist()) for b in p), np.int64, sum(map(len, pages)))
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:] if len(flat) else []
        total = self.down(self.size.astype(float)[:, None])[:, 0]
        self.total = np.maximum(total[self.of], 1)[:, None]

    def down(self, x: np.ndarray) -> np.ndarray:
        for own in self.levels:
            x[own] += x[self.parent[own]]
        return x

    def means(self, table: np.ndarray) -> np.ndarray:
        """For each block the mean of its path's features."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        sums = np.stack([np.bincount(owner, table[self.ids, d], len(self.size)) for d in range(table.shape[1])], 1)
        return (self.down(sums)[self.of] / self.total).astype(np.float32)

    def gradient(self, dx: np.ndarray, n: int) -> np.ndarray:
        """Of the table, from that of the means."""
        g = np.stack([np.bincount(self.of, c, len(self.size)) for c in (dx / self.total).T], 1)
        for own in reversed(self.levels):
            np.add.at(g, self.parent[own], g[own])
        per = np.repeat(g, self.size, 0)
        return np.stack([np.bincount(self.ids, c, n) for c in per.T], 1).astype(np.float32)


def features(pages: list[Page]) -> tuple:
    """Paths, flat buckets of words with their sizes, and numbers on form, of all blocks of all pages."""
    flat = [b for p in pages for b in p]
    words = [b[1].lower().split() for b in flat]
    memo = {w: zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in {w for ws in words for w in ws}}
    word = np.fromiter((memo[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
    n_word = np.fromiter(map(len, words), np.int64, len(flat))
    chars = np.array([len(b[1]) for b in flat], float)
    ends = np.array([b[1].count(".") + b[1].count(",") for b in flat], float)
    link = np.array([b[2] for b in flat], float)
    place = np.array([i / max(len(p) - 1, 1) for p in pages for i in range(len(p))], float)
    shape = np.stack([np.log1p(n_word) / 4, np.minimum(link / np.maximum(chars, 1), 1), np.minimum(ends / np.maximum(n_word, 1), 1), place, np.log1p(chars) / 6, np.array([b[1][-1:] in ".!?" for b in flat], float), np.array(["©" in b[1] for b in flat], float), np.ones(len(flat))], 1) if flat else np.zeros((0, SHAPE_DIM))
    return Paths(pages), word, n_word, shape.astype(np.float32)


def mean(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.stack([np.bincount(owner, table[ids, d], len(sizes)) for d in range(table.shape[1])], 1).astype(np.float32) / np.maximum(sizes, 1)[:, None]


def sig(a):
    return 0.5 * (np.tanh(0.5 * a) + 1)


class Labeller:
    IN = PATH_DIM + WORD_DIM + SHAPE_DIM

    def __init__(self, rng: np.random.Generator):
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"P": (rng.standard_normal((PATHS, PATH_DIM)) * 0.3).astype(np.float32), "W": (rng.standard_normal((WORDS, WORD_DIM)) * 0.1).astype(np.float32), "o": n(2 * HIDDEN, 1), "q": n(self.IN, 1), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {d + "x": n(self.IN, 4 * HIDDEN), d + "h": n(HIDDEN, 4 * HIDDEN), d + "b": np.repeat([0, 1, 0, 0], HIDDEN).astype(np.float32)}

    def inputs(self, f) -> np.ndarray:
        return np.concatenate([f[0].means(self.p["P"]), mean(self.p["W"], f[1], f[2]), f[3]], 1)

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """States of both directions at each block; x holds the pages' blocks one after the other. Pages go side by side, longest first."""
        order = np.argsort(-lengths, kind="stable")
        start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        out, tape = np.zeros((len(x), 2 * HIDDEN), np.float32), {"f": [], "b": []}
        steps = int(size[0]) if len(size) else 0
        for d, at in (("f", 0), ("b", HIDDEN)):
            proj = x @ self.p[d + "x"] + self.p[d + "b"]
            h, c = np.zeros((len(size), HIDDEN), np.float32), np.zeros((len(size), HIDDEN), np.float32)
            for t in range(steps):
                a = int(np.searchsorted(-size, -t, "left"))  # pages longer than t
                rows = start[:a] + (t if d == "f" else size[:a] - 1 - t)
                g = proj[rows] + h[:a] @ self.p[d + "h"]
                i, f, o = (sig(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
                u = np.tanh(g[:, 3 * HIDDEN :])
                hp, cp = h[:a].copy(), c[:a].copy()
                c[:a] = f * cp + i * u
                tc = np.tanh(c[:a])
                h[:a] = o * tc
                out[rows, at : at + HIDDEN] = h[:a]
                if keep:
                    tape[d].append((rows, a, hp, cp, i, f, o, u, tc))
        return out, tape

    def logits(self, x: np.ndarray, states: np.ndarray) -> np.ndarray:
        return (states @ self.p["o"] + x @ self.p["q"] + self.p["c"])[:, 0]

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pages], np.int64)
        if not lengths.sum():
            return [np.zeros(0, bool) for _ in pages]
        x = self.inputs(features(pages))
        z = self.logits(x, self.run(x, lengths)[0]) > 0
        return np.split(z, np.cumsum(lengths)[:-1])

    def step(self, pages: list[Page], y: np.ndarray, past: dict) -> float:
        """One step of gradient descent on a batch of pages."""
        f, lengths = features(pages), np.array([len(p) for p in pages], np.int64)
        x = self.inputs(f)
        states, tape = self.run(x, lengths, keep=True)
        z = self.logits(x, states)
        dz = ((sig(z) - y) / len(y)).astype(np.float32)[:, None]
        g = {"o": states.T @ dz, "q": x.T @ dz, "c": dz.sum(0)}
        dx, dstates = dz @ self.p["q"].T, dz @ self.p["o"].T
        for d, at in (("f", 0), ("b", HIDDEN)):
            wh, dproj = self.p[d + "h"], np.zeros((len(x), 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((len(pages), HIDDEN), np.float32), np.zeros((len(pages), HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            for rows, a, hp, cp, i, fo, o, u, tc in reversed(tape[d]):
                e = dh[:a] + dstates[rows, at : at + HIDDEN]
                q = dc[:a] + e * o * (1 - tc * tc)
                dg = np.concatenate([q * u * i * (1 - i), q * cp * fo * (1 - fo), e * tc * o * (1 - o), q * i * (1 - u * u)], 1)
                dproj[rows] = dg
                gh += hp.T @ dg
                dh[:a], dc[:a] = dg @ wh.T, q * fo
            g |= {d + "x": x.T @ dproj, d + "h": gh, d + "b": dproj.sum(0)}
            dx = dx + dproj @ self.p[d + "x"].T
        g["P"] = f[0].gradient(dx[:, :PATH_DIM], PATHS)
        per = np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(f[2], 1)[:, None], f[2], 0)
        g["W"] = np.stack([np.bincount(f[1], per[:, d], WORDS) for d in range(WORD_DIM)], 1).astype(np.float32)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m, s, t = past.get(k, (0, 0, 0))
            m, s, t = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v, t + 1
            past[k] = (m, s, t)
            self.p[k] = (self.p[k] - RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return float(np.logaddexp(0, -(2 * y - 1) * z).mean())


#: Names that mark main text and other parts of pages.
MAIN_NAMES = "content main article post entry story body text page-content post-content entry-content article-body main-content story-body post-body articleBody prose markdown reader blog-post single news-item chapter documentation".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumbs breadcrumb site-nav main-menu pagination pager tabs toc links categories".split(),
    "header": "header site-header masthead top topbar branding logo banner hero-bar page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon credits foot".split(),
    "aside": "sidebar side aside widget related recommended popular trending right-rail more-stories archive tag-cloud".split(),
    "div": "ad ads advert advertisement sponsored promo promotion banner-ad adsense sponsor partner offer".split(),
    "section": "notice cookie cookie-banner consent gdpr alert popup modal newsletter subscribe signup paywall overlay message warning".split(),
    "form": "form search login search-form contact-form subscribe-form register poll survey".split(),
    "ol": "comments comment-list comment replies discussion responses disqus reader-comments thread reviews".split(),
    "ul": "share social social-links sharing follow tags meta byline-links tools".split(),
}


def made_up(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of random markup and, for each of its blocks, whether it is main text."""
    labels: list[bool] = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick("th er on an re he in ed nd ha at en es of st la de le ou ai que un ch ge be ver sch ación os ar".split()) for _ in range(int(rng.integers(1, 5))))

    def prose(low, high):
        ws = [word() for _ in range(int(rng.integers(low, high)))]
        for i in range(len(ws)):
            if rng.random() < 0.12:
                ws[i] += pick([",", ".", ".", "&amp;", "!", ";"])
        s = " ".join(ws).capitalize()
        if rng.random() < 0.3:
            k = int(rng.integers(len(ws)))
            s = s.replace(ws[k], f"<{pick(['b', 'em', 'i', 'a href=/x', 'span', 'strong', 'code'])}>{ws[k]}</b>".replace("</b>", ""), 1) if rng.random() < 0.3 else s
        return s + (pick([".", ".", ".", "!", "?"]) if high > 8 and rng.random() < 0.85 else "")

    def names(own):
        if rng.random() < 0.2:
            return ""
        extra = [pick(["x1", "css-9ab", "col", "row", "box", "wrap", "clearfix", "u-mt", "inner", "container", "block", "js"])] if rng.random() < 0.4 else []
        value = " ".join(rng.permutation([own, *extra]))
        return f' {pick(["class", "class", "class", "id"])}="{value}"' if rng.random() < 0.95 else f" class={own}"

    def leaf(tag, text, main):
        labels.append(main)
        return f"<{tag}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.85 else "")

    def junk(kind):
        own = pick(OTHER_NAMES[kind])
        tag = kind if rng.random() < 0.6 or kind == "form" else pick(["div", "div", "section", "aside"])
        attrs = names(own) if tag == kind and kind not in ("div", "section", "ol", "ul") else f' class="{own}"' if rng.random() < 0.7 else f' id="{own}"'
        out = [f"<{tag}{attrs}>"]
        if kind in ("nav", "ul") or kind in ("aside", "footer", "header") and rng.random() < 0.4:
            out.append("<ul>")
            for _ in range(int(rng.integers(2, 9))):
                labels.append(False)
                out.append(f"<li><a href='/{word()}'>{prose(1, 4)}</a></li>")
            out.append("</ul>")
        elif kind == "ol":
            for _ in range(int(rng.integers(1, 6))):
                out.append(f"<{pick(['li', 'div', 'article'])} class=\"{pick(['comment', 'reply', 'comment-body', 'c'])}\">")
                if rng.random() < 0.6:
                    out.append(leaf(pick(["h4", "p", "div"]), prose(1, 3), False))
                out.append(leaf(pick(["p", "div", "blockquote"]), prose(4, 60), False))
                out.append("</" + re.findall(r"^<(\w+)", next(x for x in reversed(out) if " class=" in x))[0] + ">")
        elif kind == "form":
            for _ in range(int(rng.integers(1, 4))):
                out.append(leaf(pick(["p", "div", "fieldset"]), prose(1, 6) + "<input name=q>", False))
            out.append("<button>Go</button>")
        else:
            if rng.random() < 0.15:
                labels.append(False)
                out.append(prose(3, 40))
            else:
                for _ in range(int(rng.integers(1, 4))):
                    out.append(leaf(pick(["p", "p", "div", "h3", "p"]), (pick(["&copy; ", ""]) if kind == "footer" else "") + prose(2, 50), False))
        out.append(f"</{tag}>")
        return "".join(out)

    def article():
        out = [leaf(pick(["h1", "h1", "h2"]), prose(1, 16), True)] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 25))):
            r = rng.random()
            if r < 0.72:
                out.append(leaf("p", prose(1, 5) if rng.random() < 0.25 else prose(3, 120), True))
            elif r < 0.78:
                out.append(leaf(pick(["h2", "h3"]), prose(1, 10), True))
            elif r < 0.83:
                out.append("<ul>" + "".join(leaf("li", prose(2, 25), True) for _ in range(int(rng.integers(1, 6)))) + "</ul>")
            elif r < 0.87:
                out.append("<blockquote>" + leaf("p", prose(5, 50), True) + "</blockquote>")
            elif r < 0.9:
                out.append(leaf(pick(["pre", "figcaption", "div"]), prose(3, 40), True))
            elif r < 0.93:
                out.append("<table><tr>" + "".join(leaf("td", prose(1, 5), True) for _ in range(int(rng.integers(1, 5)))) + "</tr></table>")
            elif r < 0.96:
                out.append(f"<p><b>{prose(1, 30)}<br>")
                labels.append(True)
                out.append(leaf("p", prose(2, 60), True))
            else:
                out.append(junk(pick(["div", "div", "aside", "ul", "section"])))
        return "".join(out)

    page = ["<!DOCTYPE html><html><head><title>" + prose(2, 9) + "</title><style>p{}</style></head><body>"]
    wraps = []
    for _ in range(int(rng.integers(0, 3))):
        page.append(f"<div{names(pick(['wrapper', 'container', 'page', 'site', 'layout', 'root', 'grid']))}>")
        wraps.append("</div>")
    before = [k for k in ("header", "nav", "section", "div", "form", "aside", "ul") if rng.random() < 0.4]
    for k in rng.permutation(before) if before else []:
        page.append(junk(str(k)))
    tag = pick(["article", "article", "main", "div", "div", "section"])
    strong = tag in ("article", "main")
    page.append(f"<{tag}{names(pick(MAIN_NAMES)) if strong and rng.random() < 0.6 else '' if strong else chr(32) + 'class=' + chr(34) + pick(MAIN_NAMES) + chr(34)}>")
    if rng.random() < 0.25:
        page.append(f"<{pick(['div', 'section'])}{names(pick(MAIN_NAMES))}>")
        page.append(article())
        page.append("</div></section>" if page[-2].startswith("<div") else "</section>")
    else:
        page.append(article())
    if rng.random() < 0.15:
        page.append(junk("ol"))
    page.append(f"</{tag}>" if rng.random() < 0.95 else "")
    after = [k for k in ("ol", "aside", "div", "ul", "nav", "form", "section") if rng.random() < 0.3] + ["footer"] * (rng.random() < 0.8)
    for k in after:
        page.append(junk(k))
    return "".join(page + wraps) + "</body></html>", labels


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        html, y = made_up(rng)
        b = blocks(html)
        if len(b) == len(y) and y:  # a made-up page whose markup merges blocks teaches nothing
            data.append((b, y))
    model, past = Labeller(rng), {}
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), 24):
            some = [data[i] for i in order[k : k + 24]]
            model.step([b for b, _ in some], np.array([v for _, y in some for v in y], np.float32), past)
    return model


@lru_cache(1)
def standard() -> Labeller:
    """The model of the standard made-up pages, which are the same each time: it is trained once a session."""
    return train()


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    The text joins the blocks labelled as main text by two line feeds; it is empty for a null or empty html or if no
    block is. Character references are decoded, white space within a block (Unicode's, and br) is one space. Repeated
    rows and null ids are kept; extra columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    model = model or standard()
    out = io.BytesIO()
    np.savez(out, **model.p)
    sent = spark.sparkContext.broadcast(out.getvalue())

    def run(batches):
        own = Labeller.__new__(Labeller)
        z = np.load(io.BytesIO(sent.value))
        own.p = {k: z[k] for k in z.files}
        for b in batches:
            parsed = [blocks(h) for h in b.column(2).to_pylist()]
            texts = ["\n\n".join(x[1] for x, y in zip(p, ys) if y) for p, ys in zip(parsed, own.label(parsed))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
