"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level
tags. Each block is a vector: the mean of hashed embeddings of its tag path (tag
names and the words of class, id and role on the way down), the mean of hashed
embeddings of its words, and a few measures (length, share of text in links,
punctuation, place in the page). A bidirectional LSTM, written and trained in
numpy, reads the whole sequence, so every block is judged by what stands around
it, and a logistic layer keeps or drops the block.

No labelled pages are given, so the model is trained on pages that
``synthetic_page`` makes up: random words in random layouts, with menus, headers,
footers, side bars, notices, adverts, forms, comments and an article, whose
blocks carry their label by construction. Training is deterministic for a seed
and happens once per process.

Defined results: a null or empty page, or one without an article, has the empty
text. Broken markup is read as far as it goes: unclosed elements end with their
parent, a cut tag ends with the page. Repeated rows give repeated results, and
rows without an id get theirs. A page of any length is read whole; of a path of
more than ``MOST_NAMES`` different names the outermost count. An empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.llm.common import prepare, tidy

# HTML's own sets of element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: An opening tag of the key closes an open element of the values first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARENTS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
CLOSE_P = BLOCK - {"body", "html", "head", "button", "label", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "select"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>|</?[A-Za-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

PATH_BUCKETS, WORD_BUCKETS = 4096, 4096
PATH_DIMS, WORD_DIMS, MEASURES = 16, 8, 6
#: Names of a tag path that a block's vector takes in: all of a path, or of a longer one the outermost and the innermost half each.
MOST_NAMES = 64
#: Blocks that the labeller reads in one step, of all pages together.
STEP_BLOCKS = 40_000
HIDDEN = 16
INPUT = PATH_DIMS + WORD_DIMS + MEASURES


def blocks_of(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, tag path, characters inside links) of each leaf block, in page order."""
    found: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = [0]

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, path, min(linked[0], len(text))))
        parts.clear()
        linked[0] = 0

    # how often each name stands on the way down, in the order of its first place, and how many links are open
    held: dict[str, int] = {}
    links = [0]

    # where each name and each block element stands in the stack, innermost last
    places: dict[str, list[int]] = defaultdict(list)
    block_places: list[int] = []

    def push(tag: str, own: tuple[str, ...]) -> None:
        places[tag].append(len(stack))
        if tag in BLOCK:
            block_places.append(len(stack))
        stack.append((tag, own))
        links[0] += tag == "a"
        for x in own:
            held[x] = held.get(x, 0) + 1

    def cut(at: int) -> None:
        while len(stack) > at:
            tag, own = stack.pop()
            links[0] -= tag == "a"
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()
            for x in own:
                if held[x] == 1:
                    del held[x]
                else:
                    held[x] -= 1

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            if not parts:
                nonlocal path
                half = MOST_NAMES // 2
                path = tuple(held) if len(held) <= MOST_NAMES else (*islice(held, half), *reversed([*islice(reversed(held), half)]))
            parts.append(text)
            if links[0]:
                linked[0] += len(text)

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCK:
                flush()
            at_tag = innermost((tag,))
            # an inline end tag does not close the block around it
            if at_tag >= 0 and (tag in BLOCK or not block_places or block_places[-1] < at_tag):
                cut(at_tag)
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSE_P and block_places and stack[block_places[-1]][0] == "p":
                cut(block_places[-1])
            if (at_tag := innermost(CLOSES.get(tag, ()))) > innermost(PARENTS.get(tag, ())):
                cut(at_tag)
        if tag in VOID or token[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        own = [f"<{tag}"]
        if token[3]:
            for m in ATTRIBUTE.finditer(token[3]):
                own += PART.findall((m[1] or m[2] or m[3] or "").lower())
        push(tag, tuple(own))
    flush()
    return found


_paths: dict[str, int] = {}
_words: dict[str, int] = {}


def _bucket(known: dict[str, int], text: str, buckets: int) -> int:
    found = known.get(text)
    if found is None:
        found = zlib.crc32(text.encode("utf-8", "surrogatepass")) % buckets
        if len(known) < 100_000:
            known[text] = found
    return found


def features(blocks: list[tuple[str, tuple[str, ...], int]]):
    """Bucket numbers of paths and words with their offsets, and the measures, of one page."""
    paths, path_counts, words, word_counts, measures = [], [], [], [], []
    for k, (text, path, linked) in enumerate(blocks):
        own = [_bucket(_paths, x, PATH_BUCKETS) for x in path] or [0]
        paths += own
        path_counts.append(len(own))
        own = [_bucket(_words, w, WORD_BUCKETS) for w in text.lower().split()]
        words += own
        word_counts.append(len(own))
        n = len(text)
        marks = text.count(".") + text.count(",")
        measures.append((np.log1p(n) / 6, linked / n, min(marks / n * 20, 2), float(text[-1:] in ".!?…"), k / len(blocks), 1 / (1 + k)))
    return paths, path_counts, words, word_counts, measures


class Labeller:
    """Embeddings, a bidirectional LSTM and a logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.params = {
            "path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIMS)),
            "word": rng.normal(0, 0.05, (WORD_BUCKETS, WORD_DIMS)),
            "out": rng.normal(0, 0.2, 2 * HIDDEN),
            "out_bias": np.zeros(1),
        }
        for side in ("ahead", "back"):
            self.params[f"{side}_in"] = rng.normal(0, 0.25, (INPUT, 4 * HIDDEN))
            self.params[f"{side}_own"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.params[f"{side}_bias"] = bias
        self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """(pages, steps, INPUT) padded with zeros, and which steps are real."""
        steps = max(len(p[1]) for p in pages)
        x = np.zeros((len(pages), steps, INPUT), np.float32)
        real = np.zeros((len(pages), steps), bool)
        for k, (paths, path_counts, words, word_counts, measures) in enumerate(pages):
            n = len(path_counts)
            real[k, :n] = True
            for name, ids, counts, a, dims in (("path", paths, path_counts, 0, PATH_DIMS), ("word", words, word_counts, PATH_DIMS, WORD_DIMS)):
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                x[k, :n, a : a + dims] = np.add.reduceat(self.params[name][ids], starts, axis=0) / np.asarray(counts)[:, None]
            x[k, :n, PATH_DIMS + WORD_DIMS :] = measures
        return x, real

    def _run(self, side: str, x: np.ndarray, real: np.ndarray, training: bool):
        """Hidden states of one direction; padding carries the state along. What the gradients need is kept in training alone."""
        p = self.params
        pages, steps, _ = x.shape
        given = x @ p[f"{side}_in"] + p[f"{side}_bias"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "ahead" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ p[f"{side}_own"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            own = real[:, t : t + 1]
            now = f * c + i * g
            s = np.tanh(now)
            if training:
                kept.append((t, h, c, i, f, o, g, s, own))
            c = np.where(own, now, c)
            h = np.where(own, o * s, h)
            out[:, t] = h
        return out, kept

    def logits(self, pages: list, training: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
        x, real = self.inputs(pages)
        ahead, kept_a = self._run("ahead", x, real, training)
        back, kept_b = self._run("back", x, real, training)
        both = np.concatenate((ahead, back), axis=2)
        return both @ self.params["out"] + self.params["out_bias"][0], real, (x, both, kept_a, kept_b)

    def _backward(self, side: str, x: np.ndarray, kept: list, push: np.ndarray, grads: dict) -> np.ndarray:
        p = self.params
        dx = np.zeros_like(x)
        dh_next, dc_next = np.zeros_like(push[:, 0]), np.zeros_like(push[:, 0])
        for t, h, c, i, f, o, g, s, own in reversed(kept):
            dh = push[:, t] + dh_next
            dh_real, dc_real = np.where(own, dh, 0), np.where(own, dc_next, 0)
            dc = dc_real + dh_real * o * (1 - s * s)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh_real * s * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            grads[f"{side}_in"] += x[:, t].T @ dz
            grads[f"{side}_own"] += h.T @ dz
            grads[f"{side}_bias"] += dz.sum(axis=0)
            dx[:, t] = dz @ p[f"{side}_in"].T
            dh_next = dz @ p[f"{side}_own"].T + np.where(own, 0, dh)
            dc_next = np.where(own, dc * f, dc_next)
        return dx

    def train(self, pages: list, labels: list[np.ndarray], epochs: int = 8, batch: int = 16, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        order, turn = np.arange(len(pages)), 0
        for epoch in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                part = [pages[k] for k in own]
                z, real, (x, both, kept_a, kept_b) = self.logits(part, training=True)
                truth = np.zeros_like(z)
                for row, k in enumerate(own):
                    truth[row, : len(labels[k])] = labels[k]
                d = np.where(real, 1 / (1 + np.exp(-z)) - truth, 0) / real.sum()
                grads = {k: np.zeros_like(v) for k, v in self.params.items()}
                grads["out"] += np.einsum("pt,pth->h", d, both)
                grads["out_bias"] += d.sum()
                push = d[:, :, None] * self.params["out"]
                dx = self._backward("ahead", x, kept_a, push[:, :, :HIDDEN], grads)
                dx += self._backward("back", x, kept_b, push[:, :, HIDDEN:], grads)
                for row, (paths, path_counts, words, word_counts, _) in enumerate(part):
                    n = len(path_counts)
                    for name, ids, counts, a, dims in (("path", paths, path_counts, 0, PATH_DIMS), ("word", words, word_counts, PATH_DIMS, WORD_DIMS)):
                        share = dx[row, :n, a : a + dims] / np.asarray(counts)[:, None]
                        np.add.at(grads[name], ids, np.repeat(share, counts, axis=0))
                turn += 1
                rate = 0.01 * (1 - epoch / epochs / 1.2)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.98 * second[k] + 0.02 * g * g
                    self.params[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.98**turn)) + 1e-5)

    def keep(self, pages: list) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length are read together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p[1]), key=lambda k: len(pages[k][1]))
        at = 0
        while at < len(order):
            size = max(1, min(64, STEP_BLOCKS // max(1, len(pages[order[min(at + 63, len(order) - 1)]][1]))))
            own = order[at : at + size]
            z, _, _ = self.logits([pages[k] for k in own])
            for row, k in enumerate(own):
                out[k] = z[row, : len(pages[k][1])] > 0
            at += size
        return out


# --- training pages -------------------------------------------------------

_MENU = ("nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "skip", "links")
_HEADER = ("header", "masthead", "banner", "topbar", "branding", "site", "page", "logo", "hero", "top", "head")
_FOOTER = ("footer", "bottom", "colophon", "copyright", "legal", "foot", "site", "page", "credits", "contact")
_SIDE = ("sidebar", "aside", "widget", "related", "rail", "recommended", "popular", "trending", "tags", "share", "social", "secondary", "more", "author", "bio", "meta", "teaser")
_NOTICE = ("cookie", "notice", "consent", "alert", "gdpr", "privacy", "message", "popup", "modal", "overlay", "subscribe", "paywall", "newsletter", "warning", "info", "bar")
_ADVERT = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adbox", "banner", "adsense", "slot", "commercial", "partner")
_FORM = ("form", "search", "login", "signup", "register", "contact", "feedback", "reply", "newsletter", "input", "poll", "survey")
_COMMENTS = ("comment", "comments", "commentlist", "discussion", "disqus", "respond", "responses", "thread", "replies", "reader", "readers", "reviews", "reactions", "talk")
_MAIN = ("article", "content", "main", "post", "entry", "body", "story", "text", "page", "maincontent", "articlebody", "wrapper", "container", "blog", "copy", "prose")


class _Writer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        letters = "etaoinshrdlucmfwypvbgkéäößüñóç"
        self.syllables = ["".join(self.rng.choice(list(letters), self.rng.integers(1, 4))) for _ in range(50)]

    def pick(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        words = ["".join(self.pick(self.syllables) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        return " ".join(words).capitalize()

    def prose(self, low: int, high: int) -> str:
        n, out = int(self.rng.integers(low, high + 1)), []
        while n > 0:
            size = min(n, int(self.rng.integers(1, 18)))
            out.append(self.words(size, size) + self.pick([".", ".", ".", ",", "?", "!"]))
            n -= size
        return " ".join(out)

    def name(self, names) -> str:
        own = [self.pick(names)]
        if self.chance(0.4):
            own.append(self.pick(names + ("box", "block", "section", "inner", "wrap", "area", "list", "item")))
        text = self.pick(["-", "_", " "]).join(own)
        attribute = self.pick(["class", "class", "class", "id"])
        return f' {attribute}="{text}"'


def synthetic_page(seed: int) -> list[tuple[str, bool]]:
    """A page as pieces (markup, whether its text belongs to the article)."""
    w = _Writer(seed)
    out: list[tuple[str, bool]] = []
    drop = lambda text: out.append((text, False))

    def links(names, tag) -> None:
        drop(f"<{tag}{w.name(names) if w.chance(0.6) or tag in ('div', 'ul', 'section') else ''}>")
        items = int(w.rng.integers(2, 9))
        if w.chance(0.7):
            drop("<ul>" + "".join(f'<li><a href="/x">{w.words(1, 3)}</a></li>' for _ in range(items)) + "</ul>")
        else:
            drop(" ".join(f'<a href="/x">{w.words(1, 3)}</a>' for _ in range(items)))
        drop(f"</{tag}>")

    def bland(names, tag, most=30) -> None:
        named = tag in ("div", "section", "p", "ul", "span") or w.chance(0.5)
        drop(f"<{tag}{w.name(names) if named else ''}>")
        for _ in range(int(w.rng.integers(1, 4))):
            inner = w.pick(["", "p", "div", "h3", "h2", "span"])
            text = w.prose(1, most)
            drop(f"<{inner}>{text}</{inner}>" if inner else text + " ")
        drop(f"</{tag}>")

    def comments() -> None:
        tag = w.pick(["div", "section", "ol", "aside", "ul"])
        drop(f"<{tag}{w.name(_COMMENTS)}>")
        if w.chance(0.6):
            drop(f"<h3>{w.words(1, 4)}</h3>")
        for _ in range(int(w.rng.integers(1, 7))):
            inner = "li" if tag in ("ol", "ul") else w.pick(["div", "div", "article", "p"])
            drop(f"<{inner}{w.name(_COMMENTS) if w.chance(0.6) else ''}>")
            if w.chance(0.6):
                drop(f"<{w.pick(['b', 'span', 'cite', 'h4'])}>{w.words(1, 2)}</b>")
            drop(f"<p>{w.prose(2, 60)}</p></{inner}>")
        drop(f"</{tag}>")

    def form() -> None:
        drop(f"<form{w.name(_FORM) if w.chance(0.7) else ''}><label>{w.words(1, 4)}</label><input type=text>")
        if w.chance(0.5):
            drop(f"<p>{w.prose(2, 16)}</p>")
        drop(f"<button>{w.words(1, 2)}</button></form>")

    def extra() -> None:
        kind = w.pick(["ad", "ad", "ad", "notice", "notice", "form", "side", "share"])
        if kind == "ad":
            bland(_ADVERT, w.pick(["div", "div", "aside", "section", "p", "ins"]), w.pick([12, 12, 40]))
        elif kind == "notice":
            bland(_NOTICE, w.pick(["div", "div", "section", "p", "aside", "dialog"]), w.pick([20, 20, 40]))
        elif kind == "form":
            form()
        elif kind == "side":
            bland(_SIDE, w.pick(["aside", "aside", "div", "section"]))
        else:
            links(_SIDE, w.pick(["div", "ul", "section"]))

    def header() -> None:
        tag = w.pick(["header", "header", "div"])
        drop(f"<{tag}{w.name(_HEADER) if tag == 'div' or w.chance(0.4) else ''}>")
        drop(w.pick([f"<a href=/>{w.words(1, 3)}</a>", f"<h1>{w.words(1, 4)}</h1>", f"<p>{w.prose(1, 8)}</p>", f"<div>{w.words(1, 5)}</div>", f"<span>{w.words(1, 4)}</span>"]))
        if w.chance(0.4):
            drop(f"<p>{w.prose(1, 12)}</p>")
        if w.chance(0.4):
            links(_MENU, w.pick(["nav", "nav", "div", "ul"]))
        drop(f"</{tag}>")

    drop(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{w.words(1, 9)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>")
    if w.chance(0.3):
        extra()
    if w.chance(0.5):
        header()
    if w.chance(0.7):
        links(_MENU, w.pick(["nav", "nav", "nav", "div", "ul"]))
    for _ in range(int(w.rng.integers(0, 3))):
        extra()
    outer = w.chance(0.35)
    if outer:
        drop(f"<div{w.name(('wrapper', 'container', 'page', 'layout', 'row', 'grid', 'columns'))}>")
    if w.chance(0.15):
        bland(_SIDE, w.pick(["aside", "div"]))
    tag = w.pick(["article", "article", "article", "main", "div", "div", "section", "td"])
    drop("<table><tr>" if tag == "td" else "")
    drop(f"<{tag}{w.name(_MAIN) if tag in ('div', 'section') or w.chance(0.3) else ''}>")
    inner = w.chance(0.3)
    if inner:
        drop(f"<div{w.name(_MAIN)}>")
    title = w.words(2, 10)
    if w.chance(0.75):
        out.append((f"<h1>{title}</h1>", True))
    for k in range(int(w.rng.integers(1, 16))):
        kind = w.pick(["p"] * 12 + ["bold", "h2", "quote", "list", "pre", "table", "figure", "bare"])
        text = w.prose(1, w.pick([3, 12, 40, 40, 90]))
        if kind == "p":
            out.append((f"<p>{text}" + ("</p>" if w.chance(0.85) else ""), True))
        elif kind == "bold":
            out.append((f"<p><b>{text}<br>", True))
        elif kind == "h2":
            out.append((f"<{(h := w.pick(['h2', 'h3']))}>{w.words(1, 8)}</{h}>", True))
        elif kind == "quote":
            out.append((f"<blockquote><p>{text}</p></blockquote>", True))
        elif kind == "list":
            out.append(("<ul>" + "".join(f"<li>{w.prose(1, 20)}</li>" for _ in range(int(w.rng.integers(1, 5)))) + "</ul>", True))
        elif kind == "pre":
            out.append((f"<pre>{text}</pre>", True))
        elif kind == "table":
            out.append((f"<table><tr><td>{w.words(1, 4)}</td><td>{w.words(1, 4)}</td></tr></table>", True))
        elif kind == "figure":
            out.append((f"<figure><img src=x><figcaption>{w.prose(1, 15)}</figcaption></figure>", True))
        else:
            out.append((f"<div>{text}</div>", True))
        if w.chance(0.06):
            extra()
    if inner:
        drop("</div>")
    if w.chance(0.1):
        comments()
    drop(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))
    if w.chance(0.35):
        comments()
    for _ in range(int(w.rng.integers(0, 3))):
        extra()
    if outer:
        drop("</div>")
    if w.chance(0.75):
        bland(_FOOTER, w.pick(["footer", "footer", "div"]), 16)
    drop("</body></html>" if w.chance(0.9) else "")
    return out


#: A private-use character in front of each text of the article.
MARK = "\uf8ff"


def labelled_blocks(seed: int) -> tuple[list, np.ndarray]:
    """Blocks of a synthetic page, and which of them belong to its article."""
    marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)(?=<|\Z)", f">{MARK}\\1", text) if good else text for text, good in synthetic_page(seed))
    blocks = blocks_of(marked)
    labels = np.array([MARK in text for text, _, _ in blocks], np.float32)
    return [(text.replace(MARK, "") or "x", path, min(linked, len(text))) for text, path, linked in blocks], labels


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 100_000) -> Labeller:
    made = [labelled_blocks(seed + k) for k in range(pages)]
    model = Labeller()
    model.train([features(blocks) for blocks, _ in made], [labels for _, labels in made])
    return model


def main_text(page: Column, spark) -> Column:
    """The main text of each whole page, its blocks joined by line feeds."""
    shared = spark.sparkContext.broadcast(trained())

    @F.arrow_udf("string")
    @tidy
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            blocks = [blocks_of(page) if page else [] for page in batch.to_pylist()]
            kept = model.keep([features(own) for own in blocks])
            yield pa.array(["\n".join(b[0] for b, k in zip(own, keep) if k) for own, keep in zip(blocks, kept)], pa.string())

    return extract(page)


def op3_html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    prepare(spark)
    found = pages.select("page_id", "url", main_text(F.col("html"), spark).alias("text"))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
