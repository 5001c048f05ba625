"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text between block-level borders). Each block has features of
its ancestors (tags, words of class and id) and of its text; the chain of labels (text or
boilerplate) is decoded by Viterbi. The weights are learnt by maximum likelihood (forward-backward
gradients) on labelled pages: ``training_pages(n)`` makes ``n`` of them, of many
layouts, with known labels; the number is a parameter and bounds the fitting on the driver.

Defined results: null or empty html gives an empty text; a page without markup is one block;
repeated rows are extracted each; other columns are kept (``text`` and ``n_chars`` are
replaced); very long pages are parsed in one pass.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*\"?true", re.I)
PART = re.compile(r"[A-Za-z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"button", "label", "option", "body", "html", "head"}
LABELS = 2  # 0: boilerplate, 1: text


class Block:
    __slots__ = ("text", "linked", "path")

    def __init__(self, text: str, linked: int, path: tuple):
        self.text, self.linked, self.path = text, linked, path


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks in page order; white space inside is one space."""
    stack: list[tuple[str, tuple]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, tuple(stack)))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(page or ""):
        tag = m.group(3)
        if tag is None:
            piece = m.group(0)
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if links:
                    linked += len(piece)
            continue
        tag, closing = tag.lower(), m.group(2)
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        attributes = m.group(4)
        names = [f"c={w.lower()}" for found in NAMED.findall(attributes) for w in PART.findall(" ".join(found))] if attributes else []
        if attributes and HIDDEN.search(attributes):
            names.append("hidden")
        stack.append((tag, tuple(names)))
    flush()
    return out


def features(block: Block) -> list[str]:
    found = {"bias"}
    for tag, names in block.path:
        found.add("in=" + tag)
        found.update(names)
    found.add("tag=" + (block.path[-1][0] if block.path else "none"))
    text, n = block.text, block.text.count(" ") + 1
    found.add("n=" + ("1" if n < 2 else "3" if n < 4 else "9" if n < 10 else "24" if n < 25 else "many"))
    share = block.linked / len(text)
    found.add("links=" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
    found.add("end=" + (text[-1] if text[-1] in ".!?:;,…»" else "other"))
    if "©" in text or "(c)" in text.lower():
        found.add("copyright")
    if "@" in text:
        found.add("at")
    if "|" in text or "·" in text or "›" in text:
        found.add("separator")
    return sorted(found)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Weights per feature and label, and per pair of neighbouring labels."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, chain: list[list[str]]) -> np.ndarray:
        find = self.index.get
        out = np.zeros((len(chain), LABELS))
        for i, names in enumerate(chain):
            ids = [k for k in map(find, names) if k is not None]
            if ids:
                out[i] = self.weights[ids].sum(axis=0)
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        if not len(scores):
            return []
        best, back = scores[0], []
        for s in scores[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label and move expectations and the log of the normaliser (forward-backward)."""
        n = len(scores)
        ahead, behind = np.zeros((n, LABELS)), np.zeros((n, LABELS))
        ahead[0] = scores[0]
        for i in range(1, n):
            ahead[i] = _log_sum(ahead[i - 1][:, None] + self.moves, 0) + scores[i]
        for i in range(n - 2, -1, -1):
            behind[i] = _log_sum(self.moves + (scores[i + 1] + behind[i + 1])[None, :], 1)
        norm = float(_log_sum(ahead[-1], 0))
        labels = np.exp(ahead + behind - norm)
        moves = np.zeros((LABELS, LABELS))
        for i in range(1, n):
            moves += np.exp(ahead[i - 1][:, None] + self.moves + (scores[i] + behind[i])[None, :] - norm)
        return labels, moves, norm


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 25, rate: float = 0.3, decay: float = 0.003) -> Crf:
    """Maximum likelihood with a quadratic penalty by adaptive gradient steps over the pages."""
    index: dict[str, int] = {}
    for chain, _ in pages:
        for names in chain:
            for name in names:
                index.setdefault(name, len(index))
    model = Crf(index, np.zeros((len(index), LABELS)), np.zeros((LABELS, LABELS)))
    coded = [([np.array([index[n] for n in names]) for names in chain], np.array(labels)) for chain, labels in pages if chain]
    seen_w, seen_m = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(coded)
        for chain, labels in coded:
            scores = np.array([model.weights[ids].sum(axis=0) for ids in chain])
            got, moves, _ = model.expected(scores)
            wanted = np.eye(LABELS)[labels]
            used = np.concatenate(chain)
            gradient = np.zeros_like(model.weights)
            np.add.at(gradient, used, np.repeat(wanted - got, [len(c) for c in chain], axis=0))
            rows = np.unique(used)
            g = gradient[rows] - decay * model.weights[rows]
            seen_w[rows] += g * g
            model.weights[rows] += rate * g / np.sqrt(seen_w[rows])
            true_moves = np.zeros((LABELS, LABELS))
            np.add.at(true_moves, (labels[:-1], labels[1:]), 1)
            g = true_moves - moves - decay * model.moves
            seen_m += g * g
            model.moves += rate * g / np.sqrt(seen_m)
    return model


#: layouts of the labelled pages: where boilerplate and text of a page stand, tag and attribute names
CHROME = {
    "nav": ["nav", "nav class=menu", "div class=navbar", "ul id=menu", "div class=breadcrumb", "div class=topnav", "div role=navigation", "div class=pagination"],
    "header": ["header", "div id=header", "div class=site-header", "div class=masthead", "header class=top", "div role=banner"],
    "footer": ["footer", "div id=footer", "div class=site-footer", "div class=copyright", "footer class=bottom", "div role=contentinfo"],
    "aside": ["aside", "div class=sidebar", "div id=sidebar", "aside class=related", "div class=widget", "div class=recommended", "section class=more-stories", "div role=complementary", "section class=related-posts", "div class=trending", "div class=author-bio", "div class=tags", "div class=share", "div class=social"],
    "notice": ["div class=cookie", "div class=cookie-notice", "div id=notice", "div class=banner", "div class=alert", "div class=consent", "div class=popup", "div class=modal", "p class=notice", "div class=gdpr", "div class=newsletter", "div class=subscribe", "div class=paywall", "div class=disclaimer", "dialog", "div role=alert", "div role=dialog", "div class=privacy"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "div id=ad-1", "div class=sponsored", "div class=promo", "aside class=advertisement", "div class=banner-ad", "p class=ad", "section class=ads", "div class=promotion"],
    "form": ["form", "form class=search", "form id=login", "div class=form", "form class=subscribe"],
    "comments": ["div class=comments", "section id=comments", "ol class=commentlist", "div class=comment", "section class=comments", "div id=respond", "div class=discussion", "div class=replies", "div class=user-comment", "article class=comment", "ul class=comments"],
}
BODIES = ["article", "main", "div class=content", "div id=content", "div class=post", "section class=entry-content", "div class=article-body", "main role=main", "div id=main", "div class=story", "div", "body", "article class=post", "div class=text"]


def training_pages(n: int, seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """``n`` pages with features and true labels per block. Words are random letters: they carry no label."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuvéäñ") for _ in range(rnd.randint(1, 9)))

    def prose(lo: int, hi: int) -> str:
        words = [word() for _ in range(rnd.randint(lo, hi))]
        return " ".join(words).capitalize() + rnd.choice([".", ".", ".", "!", "?", "", ","])

    def opened(spec: str) -> tuple[str, str]:
        tag, *rest = spec.split(" ", 1)
        attribute = f' {rest[0].split("=")[0]}="{rest[0].split("=")[1]}"' if rest else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def text(parts: list, depth: int = 0) -> None:
        for i in range(rnd.randint(1, 9)):
            kind = rnd.random()
            if kind < 0.12:
                parts.append((f"<h{rnd.randint(1, 4)}>", prose(1, 9), 1))
            elif kind < 0.75:
                lead = rnd.choice(["<p>", "<p>", "<p>", "<p><b>", "<p class=lead>", "<p><a href=x>link</a> "])
                parts.append((lead, prose(1, rnd.choice([3, 20, 60])), 1))
            elif kind < 0.85:
                parts.append(("<ul>", None, 1))
                parts.extend(("<li>", prose(1, 14), 1) for _ in range(rnd.randint(1, 4)))
                parts.append(("</ul>", None, 1))
            elif kind < 0.9:
                parts.append(("<blockquote>", prose(5, 30), 1))
                parts.append(("</blockquote>", None, 1))
            elif kind < 0.94:
                parts.append(("<table><tr><td>", prose(1, 6), 1))
                parts.append(("</td><td>", prose(1, 6), 1))
                parts.append(("</td></tr></table>", None, 1))
            elif kind < 0.97:
                parts.append(("<pre>", prose(3, 20), 1))
                parts.append(("</pre>", None, 1))
            elif depth == 0:
                parts.append(("<div>", prose(5, 40), 1))
                parts.append(("</div>", None, 1))
            if depth == 0 and rnd.random() < 0.12:
                chrome(parts, rnd.choice(["ad", "aside", "notice", "form"]))

    def chrome(parts: list, kind: str) -> None:
        start, end = opened(rnd.choice(CHROME[kind]))
        parts.append((start, None, 0))
        for _ in range(rnd.randint(1, 6 if kind in ("nav", "aside", "comments") else 2)):
            if kind in ("nav", "aside") and rnd.random() < 0.7:
                parts.append((rnd.choice(["<li><a href=x>", "<a href=x>", "<p><a href=x>"]), prose(1, 4) + "</a>", 0))
            elif kind == "form" and rnd.random() < 0.7:
                parts.append((rnd.choice(["<label>", "<button>", "<p>"]), prose(1, 4), 0))
            elif kind == "footer" and rnd.random() < 0.6:
                parts.append((rnd.choice(["", "<p>"]), "© " + prose(1, 6) + rnd.choice([" · ", " | "]) + prose(1, 8), 0))
            else:
                parts.append((rnd.choice(["", "<p>", "<div>", "<h3>", "<span>"]), prose(1, rnd.choice([6, 40])), 0))
        parts.append(("</p></div></h3>" if rnd.random() < 0.2 else "", None, 0))
        parts.append((end, None, 0))

    out = []
    for _ in range(n):
        parts: list[tuple[str, str | None, int]] = [("<html><body>", None, 0)]
        for kind in ("notice", "header", "nav", "ad", "form", "aside"):
            if rnd.random() < 0.5:
                chrome(parts, kind)
        start, end = opened(rnd.choice(BODIES))
        if rnd.random() < 0.8:
            parts.append((start, None, 0))
            if rnd.random() < 0.7:
                parts.append(("<h1>", prose(2, 10), 1))
                parts.append(("</h1>", None, 1))
            text(parts)
            parts.append((end, None, 0))
        else:
            text(parts)
        for kind in ("aside", "comments", "ad", "form", "footer"):
            if rnd.random() < 0.5:
                chrome(parts, kind)
        # labels are told by marks in the text, which are taken out again
        page = "".join(a + (f"⟦{label}{b}" if b is not None else "") for a, b, label in parts)
        chain, labels = [], []
        for block in leaf_blocks(page):
            marks = re.findall("⟦(.)", block.text)
            block.text = re.sub("⟦.", "", block.text)
            if marks and block.text and len(set(marks)) == 1:
                chain.append(features(block))
                labels.append(int(marks[0]))
        out.append((chain, labels))
    return out


_MODEL: dict[tuple[int, int], Crf] = {}


def model_of(pages: int = 300, rounds: int = 12) -> Crf:
    key = (pages, rounds)
    if key not in _MODEL:
        _MODEL[key] = train(training_pages(pages), rounds)
    return _MODEL[key]


def main_text(model: Crf, page: str | None) -> str:
    blocks = leaf_blocks(page)
    labels = model.viterbi(model.scores([features(b) for b in blocks]))
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(df: DataFrame, html: str = "html", model: Crf | None = None) -> DataFrame:
    """Replace column ``html`` by ``text`` and ``n_chars``."""
    sent = df.sparkSession.sparkContext.broadcast(model or model_of())
    rest = [f for f in df.schema if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in rest]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string, n_chars long"])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [main_text(sent.value, p.as_py()) for p in part.column(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*names, "text", "n_chars"],
                )

    return df.select(*names, html).mapInArrow(run, fields)
