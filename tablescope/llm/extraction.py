"""Main text by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector of its hashed tag path
and a vector of its hashed words; a bidirectional LSTM in numpy reads the whole
sequence and says for every block whether it belongs to the article. Pages are
labelled one by one in many tasks; the network is trained on the driver.

Its examples are pages composed here: layouts of many kinds, whose blocks' labels are
known, filled with text of a bounded sample of the given pages.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.blocks import Block, leaf_blocks
from tablescope.llm.frames import few_by_hash, quoted, text_or_empty

PATH_SIZE, WORD_SIZE, SHAPE_SIZE = 96, 48, 4
INPUT = PATH_SIZE + WORD_SIZE + SHAPE_SIZE
HIDDEN = 20
#: Pages that example texts are taken from, at most, and characters taken of each.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 4_000
EXAMPLES = 2_000
EPOCHS = 10
BATCH = 30
SEED = 11
#: Pages labelled side by side.
TOGETHER = 256


@lru_cache(200_000)
def _slot(name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h >> 16 & 1 else -1.0


@lru_cache(20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """The nearest tags count most."""
    x = np.zeros(PATH_SIZE, np.float32)
    for back, name in enumerate(reversed(path)):
        at, sign = _slot(name, PATH_SIZE)
        x[at] += sign * max(0.4, 1.0 - 0.1 * back)
    return x


def vectors(blocks: list[Block]) -> np.ndarray:
    """For each block its hashed path, its hashed words and its shape."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    for k, block in enumerate(blocks):
        words = block.text.lower().split()
        slots = [_slot(w, WORD_SIZE) for w in words]
        x[k, :PATH_SIZE] = _path_vector(block.path)
        counts = np.bincount([at for at, _ in slots], [sign for _, sign in slots], WORD_SIZE)
        x[k, PATH_SIZE:-SHAPE_SIZE] = counts / max(np.sqrt(counts @ counts), 2.0)
        x[k, -SHAPE_SIZE:] = (min(len(words), 50) / 25, block.links / len(block.text),
                              block.text[-1] in ".!?:;…", len(block.path) < 3)
    return x


# the network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of two LSTMs (forward and backward) and of the output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def matrix(a: int, b: int) -> np.ndarray:
            return rng.normal(0, (1 / a) ** 0.5, (a, b)).astype(np.float32)

        self.weights = {}
        for side in ("f", "b"):
            self.weights |= {side + "x": matrix(INPUT, 4 * HIDDEN), side + "h": matrix(HIDDEN, 4 * HIDDEN),
                             side + "c": np.zeros(4 * HIDDEN, np.float32)}
            self.weights[side + "c"][HIDDEN:2 * HIDDEN] = 1.0  # remember at first
        self.weights |= {"o": matrix(2 * HIDDEN, 1), "oc": np.zeros(1, np.float32)}

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States of one direction: x is time x pages x INPUT; past a page's end its state stays."""
        w = self.weights
        steps, pages = mask.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        given = x @ w[side + "x"] + w[side + "c"]
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ w[side + "h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            s = np.tanh(new)
            m = mask[t][:, None]
            kept.append((t, h, c, i, f, o, g, s, m))
            h, c = np.where(m, o * s, h), np.where(m, new, c)
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        runs = {side: self._run(side, x, mask) for side in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        return _sigmoid((both @ self.weights["o"])[..., 0] + self.weights["oc"]), both, runs

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, both, runs = self.forward(x, mask)
        w, n = self.weights, mask.sum()
        loss = -float((np.log(np.where(truth, p, 1 - p) + 1e-7) * mask).sum() / n)
        d = ((p - truth) * mask / n).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["o"] = np.einsum("tpk,tp->k", both, d)[:, None]
        grad["oc"][:] = d.sum()
        for at, side in enumerate(("f", "b")):
            back = d[..., None] * w["o"][at * HIDDEN:(at + 1) * HIDDEN, 0]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            for t, h, c, i, f, o, g, s, m in reversed(runs[side][1]):
                dh = dh + back[t]
                inner = np.where(m, dh, 0)
                ds = np.where(m, dc, 0) + inner * o * (1 - s * s)
                dz = np.concatenate([ds * g * i * (1 - i), ds * c * f * (1 - f), inner * s * o * (1 - o), ds * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                grad[side + "h"] += h.T @ dz
                dh = np.where(m, 0, dh) + dz @ w[side + "h"].T
                dc = np.where(m, ds * f, dc)
            grad[side + "x"] = np.einsum("tpi,tpz->iz", x, dz_all, optimize=True)
            grad[side + "c"] = dz_all.sum(axis=(0, 1))
        return loss, grad

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Of each block, that it belongs to the article."""
        result: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):  # pages of like length together, long ones in smaller numbers
            some = order[start:start + max(1, min(TOGETHER, 20_000 // len(pages[order[start]])))]
            x, mask = padded([vectors(pages[k]) for k in some])
            p = self.forward(x, mask)[0]
            for column, k in enumerate(some):
                result[k] = p[:len(pages[k]), column]
            start += len(some)
        return result


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[:len(page), k], mask[:len(page), k] = page, True
    return x, mask


def train(pages: list[tuple[list[Block], list[bool]]], seed: int = SEED) -> Labeller:
    """Adam on batches of pages of like length; the same pages give the same weights."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    ordered = sorted(((b, y) for b, y in pages if b), key=lambda p: len(p[0]))
    batches = []
    for start in range(0, len(ordered), BATCH):
        some = ordered[start:start + BATCH]
        x, mask = padded([vectors(blocks) for blocks, _ in some])
        truth = np.zeros(mask.shape, bool)
        for k, (_, labels) in enumerate(some):
            truth[:len(labels), k] = labels
        batches.append((x, mask, truth))
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(batches)).tolist():
            _, grad = model.gradients(*batches[k])
            norm = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
            step += 1
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            for name, g in grad.items():
                g = g * min(1.0, 2.0 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.weights[name] -= rate * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)
    return model


# example pages

#: How layouts name their parts.
MAIN = ["<article>", "<main><article>", "<main>", '<div class="content">', '<div id="content"><article>', '<div class="post">',
        '<div class="entry-content">', '<section class="story">', '<div id="main"><div class="article-body">', '<main role="main">',
        '<div class="page"><div class="text">', '<article class="post">']
FIXED = {
    "nav": ["<nav>", '<div class="nav">', '<div class="menu">', "<header><nav>", '<nav class="navbar">', '<div id="navigation">'],
    "top": ["<header>", '<div class="header">', '<div id="top">', '<div class="banner">', '<header class="site-header">'],
    "foot": ["<footer>", '<div class="footer">', '<footer class="site-footer">', '<div id="footer">', '<div class="copyright">'],
    "side": ["<aside>", '<div class="sidebar">', '<div class="related">', '<aside class="widget">', '<div id="sidebar">', '<section class="related">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<aside class="promo">', '<div class="sponsored">', '<div id="ad">'],
    "notice": ['<div class="cookie">', '<div class="notice">', '<div class="cookie-banner">', '<div class="alert">', '<div class="newsletter">', '<div class="subscribe">'],
    "form": ["<form>", '<form class="search">', '<div class="login"><form>', '<form id="signup">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment">', '<section class="replies">', '<div id="disqus">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="breadcrumbs">', '<div class="meta">', '<div class="tags">'],
}
WORDS = ["Home", "About", "Contact", "Login", "Privacy", "Terms", "Search", "Subscribe", "Share", "Next", "Previous", "Menu", "News",
         "Comments", "Reply", "Cookies", "Accept", "Advertisement", "Related", "All rights reserved", "&copy;", "&middot;"]


def _closing(opened: str) -> str:
    return "".join(f"</{t.split()[0].strip('<>')}>" for t in reversed(opened.replace("><", ">\n<").split("\n")))


def compose(rng, texts: list[str]) -> tuple[str, list[str]]:
    """A page and its article's blocks."""
    good: list[str] = []

    def sentence(most: int) -> str:
        words = texts[rng.integers(len(texts))].split()
        start = int(rng.integers(max(len(words) - most, 1)))
        return " ".join(words[start:start + int(rng.integers(1, most + 1))]) or "text"

    def marked(text: str) -> str:
        text = text.replace("&", "&amp;").replace("<", "&lt;")
        kind = rng.integers(6)
        if kind == 0:
            words = text.split(" ")
            k = int(rng.integers(len(words)))
            words[k] = f'<a href="/x">{words[k]}</a>' if rng.random() < 0.5 else f"<em>{words[k]}</em>"
            return " ".join(words)
        return "<b>" + text if kind == 1 and rng.random() < 0.5 else text

    def article() -> str:
        out = []
        if rng.random() < 0.9:
            out.append(paragraph("h1", 12, True))
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.08:
                out.append(paragraph("h2", 8, True))
            elif kind < 0.14:
                out.append("<ul>" + "".join(paragraph("li", 14, True) for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.18:
                out.append("<blockquote>" + paragraph("p", 30, True) + "</blockquote>")
            elif kind < 0.24:
                out.append(extra(("ad", "share", "notice", "side")[rng.integers(4)]))
            else:
                out.append(paragraph("p", int(rng.choice([4, 20, 60, 120])), True))
        return "".join(out)

    def paragraph(tag: str, most: int, wanted: bool) -> str:
        text = sentence(most)
        if wanted:
            good.append(text)
        end = "<br>" if rng.random() < 0.1 and tag == "p" else f"</{tag}>"
        return f"<{tag}>{marked(text)}{end}"

    def extra(kind: str) -> str:
        opened = FIXED[kind][rng.integers(len(FIXED[kind]))]
        if kind in ("nav", "share", "form") and rng.random() < 0.8:
            items = [sentence(2) if rng.random() < 0.5 else WORDS[rng.integers(len(WORDS))] for _ in range(int(rng.integers(1, 8)))]
            tag = ("li", "p", "div")[rng.integers(3)]
            inner = "".join(f'<{tag}><a href="/{i}">{t}</a></{tag}>' for i, t in enumerate(items))
            inner = f"<ul>{inner}</ul>" if tag == "li" else inner
        else:
            n = int(rng.integers(1, 5)) if kind in ("comments", "side", "foot") else 1
            plain = rng.random() < 0.4 and n == 1
            inner = marked(sentence(30)) if plain else "".join(
                paragraph("p" if rng.random() < 0.7 else "h3", 40, False) for _ in range(n))
            if kind == "foot" and rng.random() < 0.5:
                inner = "&copy; site.example &middot; " + inner
        return opened + inner + _closing(opened)

    def some(kinds: list[str]) -> str:
        return "".join(extra(k) for k in kinds if rng.random() < 0.5)

    opened = MAIN[rng.integers(len(MAIN))]
    before = some(["top", "nav", "notice", "ad", "share", "side"])
    inside = article()
    if rng.random() < 0.25:
        inside += extra("comments")
    after = some(["comments", "side", "ad", "notice", "form", "foot"])
    if rng.random() < 0.5:
        after += extra("foot")
    end = _closing(opened) if rng.random() < 0.9 else ""
    return f"<html><head><title>t</title></head><body>{before}{opened}{inside}{end}{after}</body></html>", good


def examples(texts: list[str], n: int = EXAMPLES, seed: int = SEED) -> list[tuple[list[Block], list[bool]]]:
    """Composed pages as blocks with labels."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t.strip()] or ["A short text that stands for any other."]
    pages = []
    for _ in range(n):
        page, good = compose(rng, texts)
        blocks, labels, k = leaf_blocks(page), [], 0
        wanted = [" ".join(g.split()) for g in good]
        for b in blocks:
            hit = k < len(wanted) and b.text == wanted[k]
            k += hit
            labels.append(hit)
        if k == len(wanted):
            pages.append((blocks, labels))
    return pages


def fit(pages: DataFrame, column: str = "html") -> Labeller:
    """A labeller whose examples are filled with the texts of SAMPLE_PAGES pages, those with the smallest hashes."""
    filled = pages.select(quoted(column).cast("string").alias("html")).where("html IS NOT NULL")
    rows = few_by_hash(filled, ["html"], SAMPLE_PAGES, filled.count()).collect()
    return train(examples([b.text[:SAMPLE_CHARS] for r in rows for b in leaf_blocks(r["html"]) if len(b.text) > 40]))


def main_text(model: Labeller, pages: list[str]) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(blocks, model.probabilities(blocks))]


def extract(pages: DataFrame, model: Labeller, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text as ``out``, which replaces a column of that name; empty for null or empty pages."""

    @F.pandas_udf(T.StringType())
    def text(html: pd.Series) -> pd.Series:
        done: list[str] = []
        for start in range(0, len(html), TOGETHER):
            done += main_text(model, html.iloc[start:start + TOGETHER].tolist())
        return pd.Series(done, dtype=object)

    return pages.withColumn(out, text(text_or_empty(column)))


def extraction_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; repeated rows get the same text each."""
    return extract(pages.select("page_id", "url", "html"), fit(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
