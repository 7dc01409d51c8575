"""Main text of web pages by a recurrent block labeller.

A page is taken apart into leaf blocks: runs of text under one block element. Each block has
a vector of its hashed tag path (names, classes and ids of the open elements), its hashed
words and a few sizes. A bidirectional LSTM in numpy reads a page's blocks as a sequence
and says of each whether it belongs to the article, so what stands before and after counts.

There are no labels for pages. The network learns from a bounded sample (``SAMPLE`` pages)
of those that can teach: blocks inside an article element that no boilerplate element holds
are positive. Each sampled page is also learned in disguise, with other element names and
classes and with forms, side bars, notices and comments put in, so that the network does not
hang on one template. Where fewer than ``LEAST`` pages can teach, built-in ones are added.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pages that learning reads
SAMPLE = 300
#: taught pages that learning has at least; built-in ones make up for what the table lacks
LEAST = 100
PATH_SLOTS, WORD_SLOTS, SIZES = 192, 32, 6
HIDDEN, EPOCHS, TOGETHER, RATE = 24, 10, 16, 0.01
#: most pages labelled side by side, blocks of them with padding, and characters parsed at once;
#: a page of more blocks is labelled alone, in segments of as many
_BATCH, _STEPS, _CHARACTERS = 64, 8192, 4_000_000

_BLOCKS = frozenset(
    "address article aside blockquote body button caption dd details div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td template tfoot th thead "
    "title tr ul".split())
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: elements whose content is no markup, up to their end tag, and no text of the page
_RAW = "script|style|noscript|iframe|textarea"
#: blocks that do not end a paragraph
_CHOICES = frozenset("select optgroup option".split())
#: a start tag of the key ends an open element of the value's names, up to the bound
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
         "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}),
         "optgroup": ({"option", "optgroup"}, {"select"}), "select": ({"select"}, ())}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_POINT = re.compile(r"[.,;:!?]")

#: names, classes and ids of what is no article, and of what is one, for the teacher
NOT_ARTICLE = frozenset(
    "nav menu header footer aside sidebar form ad ads advert advertisement banner promo sponsor "
    "sponsored notice cookie consent newsletter subscribe comment comments respond reply related "
    "breadcrumb breadcrumbs share social login search popup modal widget toc pagination head "
    "copyright button legal".split())
#: elements, but not classes, of what is no article
NOT_ARTICLE_TAGS = frozenset("<title <select <template".split())
ARTICLE = frozenset("article main content story".split())


#: what a page must hold to have a word of ARTICLE in a path; white space is Python's
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
_MARK = rf"(?<![a-z])(?:{'|'.join(sorted(ARTICLE))})(?![a-z])"
_MARKED = (rf"(?i)<{_MARK}|(?:class|id|role){_SPACE}={_SPACE}"
           rf"(?:\"[^\"]*?{_MARK}|'[^']*?{_MARK}|[^\s>]*?{_MARK})")
_HASHES = 1 << 40


class Block:
    """A leaf: its text, the tokens of its path, and how much of it is in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[str], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


def path_tokens(name: str, attributes: str) -> list[str]:
    """An element's name, and the words of its class, id and role."""
    tokens = ["<" + name]
    if attributes:
        for match in _ATTRIBUTE.finditer(attributes):
            value = match[2] or match[3] or match[4] or ""
            tokens += ["." + w for w in _NAME.findall(value.lower())]
    return tokens


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; without text there is no block.

    Unclosed elements end with what holds them; a paragraph or a select ends at the next block
    element. Inline elements do not part blocks; a line break is white space.
    """
    page = page or ""
    stack: list[tuple[str, list[str]]] = []
    out: list[Block] = []
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, [t for _, own in stack for t in own], linked))
            pieces.clear()
        linked = 0

    def drop(to: int) -> None:
        nonlocal in_link
        if any(n in _BLOCKS for n, _ in stack[to:]):
            close()
        in_link -= sum(n == "a" for n, _ in stack[to:])
        del stack[to:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if in_link:
                linked += len(text)

    for match in _TOKEN.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        name = match[3]
        if name is None:
            continue
        name = name.lower()
        if match[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    drop(i)
                    break
            else:
                if name in _BLOCKS:
                    close()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in _BLOCKS:
            close()
            # inline elements left open do not reach into the next block
            for i in range(len(stack) - 1 if name not in _CHOICES else -1, -1, -1):
                if stack[i][0] in ("p", "select"):
                    drop(i)
                    break
                if stack[i][0] in _BLOCKS and stack[i][0] not in _CHOICES:
                    break
            ends, bound = _ENDS.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bound:
                    break
                if stack[i][0] in ends:
                    drop(i)
                    break
        if name not in _EMPTY and not match[4].endswith("/"):
            stack.append((name, path_tokens(name, match[4])))
            in_link += name == "a"
    add(page[at:])
    close()
    return out


# --- vectors ---


class Slots(dict):
    """Token -> slot of its hash."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        slot = self[token] = zlib.crc32(token.encode()) % self.n
        return slot


class Vectors:
    """Block vectors; the tag path's share is kept for paths seen before."""

    def __init__(self) -> None:
        self.path_slots, self.word_slots = Slots(PATH_SLOTS), Slots(WORD_SLOTS)
        self.paths: dict[tuple, np.ndarray] = {}

    def path(self, tokens: tuple) -> np.ndarray:
        found = self.paths.get(tokens)
        if found is None:
            if len(self.paths) > 4096:
                self.paths.clear()
            found = self.paths[tokens] = np.zeros(PATH_SLOTS, np.float32)
            found[[self.path_slots[t] for t in tokens]] = 1
        return found

    def of(self, blocks: list[Block], start: int = 0, total: int | None = None) -> np.ndarray:
        """Vectors of a page's blocks, or of those from ``start`` on of ``total``."""
        n = len(blocks)
        x = np.empty((n, PATH_SLOTS + WORD_SLOTS + SIZES), np.float32)
        slots, slot, n_words, sizes = [], self.word_slots.__getitem__, [], []
        for row, b in enumerate(blocks):
            x[row, :PATH_SLOTS] = self.path(tuple(b.path))
            words = _WORD.findall(b.text.lower())
            slots += map(slot, words)
            n_words.append(len(words))
            sizes.append((len(b.text), len(words), b.linked, len(_POINT.findall(b.text)),
                          len(b.path)))
        rows = np.repeat(np.arange(n), n_words)
        counts = np.bincount(rows * WORD_SLOTS + np.array(slots, np.int64), minlength=n * WORD_SLOTS)
        x[:, PATH_SLOTS:-SIZES] = np.log1p(counts.reshape(n, WORD_SLOTS)) / 4
        length, words, linked, points, depth = np.array(sizes, np.float32).T
        x[:, -SIZES:] = np.column_stack([
            np.log1p(length) / 6, np.log1p(words) / 4, linked / length, points / (words + 1),
            np.arange(start, start + n) / (total or n), depth / 20])
        return x


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = 1
    return x, mask


# --- the network: weights of two LSTMs and of the output ---


def new_network(inputs: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.RandomState(seed)
    net = {}
    for side in "fb":
        net["x" + side] = rng.randn(inputs, 4 * HIDDEN) / math.sqrt(inputs)
        net["h" + side] = rng.randn(HIDDEN, 4 * HIDDEN) / math.sqrt(HIDDEN)
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        net["b" + side] = bias
    net["out"] = rng.randn(2 * HIDDEN) / math.sqrt(2 * HIDDEN)
    net["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in net.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(net: dict, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States at each step and what the way back needs; padding leaves the state alone."""
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    given = x @ net["x" + side] + net["b" + side]
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    c = np.zeros_like(h)
    out, kept = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), []
    for t in steps:
        gates = given[t] + h @ net["h" + side]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = m * (f * c + i * g) + (1 - m) * c
        tanh_c = np.tanh(new_c)
        kept.append((t, h, c, i, f, o, g, tanh_c, m))
        h = m * (o * tanh_c) + (1 - m) * h
        c = new_c
        out[t] = h
    return out, kept


def _share(net: dict, side: str, x: np.ndarray, mask: np.ndarray, state: tuple | None) -> tuple:
    """What one direction adds to the blocks' scores, and its state behind them; no step is kept."""
    steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
    given, weights = x @ net["x" + side] + net["b" + side], net["h" + side]
    out = net["out"][:HIDDEN] if side == "f" else net["out"][HIDDEN:]
    h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
    share = np.zeros(mask.shape, given.dtype)
    for t in steps:
        gates = given[t] + h @ weights
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        m = mask[t][:, None]
        new_c = m * (f * c + i * np.tanh(gates[:, 3 * HIDDEN :])) + (1 - m) * c
        h = m * (o * np.tanh(new_c)) + (1 - m) * h
        c = new_c
        share[t] = h @ out
    return share, (h, c)


def segment_scores(net: dict, segment: Callable[[int], tuple], n: int) -> np.ndarray:
    """Scores of the blocks in ``n`` segments of vectors and mask, which follow each other.

    Each direction carries its state from segment to segment, so the cuts change nothing.
    """
    shares: list = [0] * n
    for side in "fb":
        state = None
        for k in range(n) if side == "f" else reversed(range(n)):
            x, mask = segment(k)
            share, state = _share(net, side, x, mask, state)
            shares[k] = shares[k] + share
    return _sigmoid(np.concatenate(shares) + net["bias"])


def label_scores(net: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return segment_scores(net, lambda _: (x, mask), 1)


def gradients(net: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross entropy over a batch's blocks."""
    sides = {s: _lstm(net, s, x, mask) for s in "fb"}
    states = np.concatenate([sides[s][0] for s in "fb"], axis=2)
    error = (_sigmoid(states @ net["out"] + net["bias"]) - y) * mask / mask.sum()
    grad = {"out": np.einsum("tb,tbh->h", error, states), "bias": np.array([error.sum()])}
    for k, side in enumerate("fb"):
        own = error[:, :, None] * net["out"][k * HIDDEN : (k + 1) * HIDDEN]
        d_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        d_wh = np.zeros_like(net["h" + side])
        dh = np.zeros(own.shape[1:], np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, g, tanh_c, m in reversed(sides[side][1]):
            dh = dh + own[t]
            through, d_state = m * dh, dc + m * dh * o * (1 - tanh_c**2)
            live = m * d_state
            d = np.concatenate([
                live * g * i * (1 - i), live * c * f * (1 - f),
                through * tanh_c * o * (1 - o), live * i * (1 - g**2)], axis=1)
            d_gates[t] = d
            d_wh += h.T @ d
            dh = d @ net["h" + side].T + (1 - m) * dh
            dc = live * f + (1 - m) * d_state
        grad["x" + side] = np.einsum("tbi,tbo->io", x, d_gates, optimize=True)
        grad["h" + side], grad["b" + side] = d_wh, d_gates.sum(axis=(0, 1))
    return grad


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> dict:
    """Fit by Adam, pages of like length side by side."""
    net = new_network(PATH_SLOTS + WORD_SLOTS + SIZES)
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    pages = sorted(pages, key=lambda p: len(p[1]))
    batches = [pages[i : i + TOGETHER] for i in range(0, len(pages), TOGETHER)]
    order, step = random.Random(0), 0
    for epoch in range(epochs):
        order.shuffle(batches)
        for batch in batches:
            x, mask = _padded([p for p, _ in batch])
            y = _padded([labels[:, None] for _, labels in batch])[0][:, :, 0]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, g in gradients(net, x, mask, y).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net[k] = (net[k] - rate * (mean[k] / (1 - 0.9**step)) / (
                    np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


# --- the teacher ---


def taught_labels(blocks: list[Block]) -> list[int] | None:
    """1 for blocks of the article; None where no element says that it is one."""
    plain = [[t[1:] for t in b.path] for b in blocks]
    inside = [any(t in ARTICLE for t in p) for p in plain]
    if not any(inside):
        return None
    return [int(i and not any(t in NOT_ARTICLE for t in p)
                and NOT_ARTICLE_TAGS.isdisjoint(b.path))
            for b, i, p in zip(blocks, inside, plain)]


_DISGUISES = {
    "<article": [["<article"], ["<main"], ["<div", ".content"], ["<div", ".article", ".body"],
                 ["<section", ".story"], ["<div", ".post", ".content"], ["<main", "<article"],
                 ["<div", ".entry", ".content"], ["<div", ".main", ".text"]],
    "<nav": [["<nav"], ["<div", ".menu"], ["<header", "<nav"], ["<div", ".nav"],
             ["<ul", ".breadcrumbs"], ["<div", ".toc"]],
    "<footer": [["<footer"], ["<div", ".footer"], ["<div", ".copyright"], ["<section", ".legal"]],
    ".ad": [[".ad"], [".advert"], [".banner"], [".sponsored"], [".promo", ".box"],
            [".advertisement"]],
}
_INTRUDERS = [
    ["<aside"], ["<div", ".sidebar"], ["<aside", ".related", "<ul", "<li", "<a"],
    ["<form", "<label"], ["<form", ".newsletter", "<p"], ["<form", ".search", "<button"],
    ["<div", ".cookie", ".notice", "<p"], ["<div", ".notice"], ["<div", ".alert", ".notice", "<p"],
    ["<section", ".comments", "<p"], ["<div", ".comments", "<div", ".comment", "<p"],
    ["<ol", ".comment", ".list", "<li", "<p"], ["<div", ".share", ".social", "<a"],
    ["<header"], ["<header", "<h1"], ["<header", ".site", "<p"], ["<div", ".header", "<p"],
    ["<div", ".banner"], ["<div", ".advertisement", "<p"], ["<div", ".ads"],
    ["<div", ".subscribe", "<p"],
    ["<form", "<select", "<option"], ["<select", "<option"], ["<svg", "<title"], ["<template", "<p"],
]
#: intruders that also stand inside articles
_INNER = [k for k in _INTRUDERS if k[0] != "<header"]


def disguised(blocks: list[Block], labels: list[int], pool: list[str], rng: random.Random) -> tuple:
    """The page with other names and with intruders, which are negative."""
    chosen = {k: rng.choice(v) for k, v in _DISGUISES.items()}
    out, y, article = [], [], None
    for b, label in zip(blocks, labels):
        path = [t for token in b.path for t in chosen.get(token, [token])]
        out.append(Block(b.text, path, b.linked))
        y.append(label)
        if label and article is None:
            article = path[:-1]
    for _ in range(rng.randrange(5)):
        text = rng.choice(pool)
        words = text.split()
        text = " ".join(words[: rng.choice([3, 8, 20, 60, 200])])
        kind = rng.choice(_INTRUDERS)
        around = ["<html", "<body"]
        if article and rng.random() < 0.4:
            kind, around = rng.choice(_INNER), article
            spots = [i for i, label in enumerate(y) if label]
            at = rng.choice(spots) + rng.randrange(2) if spots else 0
        else:
            at = rng.choice([0, len(out), rng.randrange(len(out) + 1)])
            if 0 < at < len(out) and y[at - 1] and y[at]:
                at = len(out)
        for _ in range(rng.choice([1, 1, 2, 4])):
            linked = len(text) if "<a" in kind else 0
            out.insert(at, Block(text, [*around, *kind], linked))
            y.insert(at, 0)
    return out, y


#: where a built-in page has its article, and its links
_PLACES = [*_DISGUISES["<article"], ["<div"], ["<div", "<div"], ["<div", ".post"], ["<section"],
           ["<div", ".page"], ["<table", "<tr", "<td"], ["<div", ".text"], ["<center"]]
_LINKS = [*_DISGUISES["<nav"], ["<div"], ["<table", "<tr", "<td"], ["<div", ".links"], ["<ul"],
          ["<div", "<ul"], ["<div", ".top"]]
_ENDINGS = [*_DISGUISES["<footer"], ["<div"], ["<div", "<p"], ["<div", ".bottom"], ["<center"]]
_OUTER = [[], [], ["<div"], ["<div", ".wrapper"], ["<div", ".page", "<div"], ["<div", ".container"]]


def built_in(rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page as many are built, of invented words, and its labels."""
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10)))
             for _ in range(200)]
    blocks, labels = [], []
    body = ["<html", "<body", *rng.choice(_OUTER)]

    def put(label: int, path: list[str], low: int, high: int, links: bool = False) -> None:
        mark = 0 if links or high < 12 else rng.choice([0, 0.1, 0.2])
        text = " ".join(rng.choice(words) + ("." if rng.random() < mark else "")
                        for _ in range(rng.randrange(low, high)))
        blocks.append(Block(text, path, len(text) if links else 0))
        labels.append(label)

    def links() -> None:
        path = [*body, *rng.choice(_LINKS)]
        if path[-1] == "<ul" or rng.random() < 0.5:
            path += ["<li"] if path[-1] == "<ul" else ["<ul", "<li"]
            for _ in range(rng.randrange(3, 12)):
                put(0, path, 1, 4, links=True)
        else:
            put(0, path, 3, 15, links=True)

    put(0, ["<html", "<head", "<title"], 1, 9)
    for _ in range(rng.randrange(3)):
        links()
    if rng.random() < 0.5:
        put(0, [*body, "<div", rng.choice([".ad", ".banner", ".promo"])], 3, 12)
    article = [*body, *rng.choice(_PLACES)]
    if rng.random() < 0.8:
        put(1, [*article, rng.choice(["<h1", "<h2"])], 1, 12)
    for _ in range(rng.randrange(1, 9)):
        own = rng.choice([["<p"]] * 6 + [[], ["<h2"], ["<ul", "<li"], ["<blockquote", "<p"], ["<pre"]])
        put(1, [*article, *own], *((1, 10) if own == ["<h2"] else (5, 90)))
    if rng.random() < 0.4:
        links()
    if rng.random() < 0.8:
        put(0, [*body, *rng.choice(_ENDINGS)], 2, 12)
    return blocks, labels


def _taught_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages whose article has text, each once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for part in range(0, batch.num_rows, _BATCH):
            found = []
            for page in batch.column(0).slice(part, _BATCH).to_pylist():
                key = hash(page)
                if key in seen:
                    continue
                if len(seen) > 1 << 16:
                    seen.clear()
                seen.add(key)
                if any(taught_labels(leaf_blocks(page)) or ()):
                    found.append(page)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["html"])


def teachable(pages: DataFrame, sample: int = SAMPLE) -> list[str]:
    """``sample`` different pages whose article has text; all of them where there are fewer.

    They are those of the least hashes. The bound on the hash is set for the pages that hold
    the markup at all, and raised until enough of the pages below it can teach.
    """
    marked = pages.select(F.col("html").cast("string").alias("html")).where(
        F.col("html").rlike(_MARKED))
    hashed = F.pmod(F.xxhash64("html"), F.lit(_HASHES))
    bound = round(min(1.0, 1.2 * sample / max(1, marked.count())) * _HASHES)
    while True:
        drawn = (
            marked.where(hashed < bound).mapInArrow(_taught_pages, "html string")
            .dropDuplicates(["html"]).orderBy(hashed, "html").limit(sample)
        )
        found = [r["html"] for r in drawn.collect()]  # at most `sample` pages
        if len(found) >= sample or bound >= _HASHES:
            return found
        bound = min(_HASHES, round(bound * max(2, min(64, 1.5 * sample / max(1, len(found))))))


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """A network fitted to ``sample`` pages that can teach.

    Each is learned as it is and in two disguises. Built-in pages are added, also to no page
    at all, where the table has fewer than ``LEAST`` that can teach.
    """
    rng, vectors, examples = random.Random(0), Vectors(), []
    taught = []
    for page in teachable(pages, sample):
        blocks = leaf_blocks(page)
        taught.append((blocks, taught_labels(blocks)))
    taught += [built_in(rng) for _ in range(min(LEAST, sample) - len(taught))]
    pool = [b.text for blocks, _ in taught for b in blocks]
    for blocks, labels in taught:
        made = [(blocks, labels), *(disguised(blocks, labels, pool, rng) for _ in range(2))]
        examples += [(vectors.of(b), np.array(y, np.float32)) for b, y in made]
    return train(examples)


def page_texts(pages: list[str | None], net: dict, vectors: Vectors) -> list[str]:
    """The article of each page."""
    blocks = [leaf_blocks(p) for p in pages]
    texts = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    while order:
        # the longest first, and as many of the next ones as fit beside it
        longest = len(blocks[order[-1]])
        together = min(_BATCH, max(1, _STEPS // longest))
        chosen, order = order[-together:], order[:-together]

        def segment(k: int, chosen: list[int] = chosen) -> tuple[np.ndarray, np.ndarray]:
            start = k * _STEPS
            return _padded([vectors.of(blocks[i][start : start + _STEPS], start, len(blocks[i]))
                            for i in chosen])

        n = -(-longest // _STEPS)
        scores = segment_scores(net, segment, n) if n > 1 else label_scores(net, *segment(0))
        for k, i in enumerate(chosen):
            texts[i] = "\n\n".join(
                b.text for b, s in zip(blocks[i], scores[:, k].tolist()) if s >= 0.5)
    return texts


def _portions(pages: list[str | None]) -> Iterator[list[str | None]]:
    """Pages in their order, a bounded number of characters or one page at a time."""
    portion, size = [], 0
    for page in pages:
        if portion and size + len(page or "") > _CHARACTERS:
            yield portion
            portion, size = [], 0
        portion.append(page)
        size += len(page or "")
    if portion:
        yield portion


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    ``text`` has the article's blocks, white space inside each as one space, joined by
    two line ends; it is empty where there are none. A null page is empty, repeated rows give
    a row each, an empty table gives an empty result, and other columns are not read.
    """
    net = learn(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for part in range(0, batch.num_rows, 8 * _BATCH):
                cut = batch.slice(part, 8 * _BATCH)
                texts = [t for portion in _portions(cut.column(2).to_pylist())
                         for t in page_texts(portion, net, vectors)]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
