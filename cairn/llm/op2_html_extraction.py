"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags) with
their ancestors.  Features are ancestor tags, words of ancestors' classes and
ids, and properties of the text.  The field has two labels, text of the
article and the rest; it is trained on labelled pages, which a generator with
a fixed seed makes in many layouts (TRAINING_PAGES), and decoded by Viterbi.

Edge cases: a null or empty page has an empty text; unclosed and stray tags
are repaired as browsers do; scripts, styles, comments and what isn't shown
are never blocks; pages of any length are read whole, in time in proportion to it;
repeated rows and other columns don't matter; an empty table gives an empty result.
"""
from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bound_batches, read_table

TRAINING_PAGES = 600

#: HTML element categories.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title textarea datalist audio video canvas map".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; any other start tag, and text, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
STOPS = frozenset("ul ol dl table body div section article".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
#: Distinct tags, and words of ancestors' classes and ids, that a path has at most; texts have no such bound.
PATH_WORDS = 512

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
NAMING = frozenset(("class", "id", "role", "aria-label"))
WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def read_attributes(page: str, at: int) -> tuple[int, list[tuple[str, str]], bool]:
    """Where the tag ends whose attributes begin at this place, the attributes, and whether it ends by '/>'.

    Quotes count at the start of a value only.  A quote that nothing closes ends with the tag.
    """
    found, n = [], len(page)
    while True:
        at = BETWEEN.match(page, at).end()
        if at >= n:
            return n, found, False
        if page[at] == ">":
            return at + 1, found, page[at - 1] == "/"
        name = ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(page, at):
            at = equals.end()
            if page[at : at + 1] in ('"', "'") and at < n:
                end = page.find(page[at], at + 1)
                close = end if end >= 0 else page.find(">", at + 1)
                close = close if close >= 0 else n
                value, at = page[at + 1 : close], close + (end >= 0)
            else:
                plain = UNQUOTED.match(page, at)
                value, at = plain[0], plain.end()
        found.append((name[0].lower(), value))


def markup(page: str):
    """(text before, kind, tag, attributes, self-closing) of each piece of markup in page order; kind is 'start', 'end', 'raw' or ''.

    One pass: every piece begins where the last one ended.
    """
    begin = at = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            yield page[begin:], "", "", (), False
            return
        text, follows = page[begin:at], page[at + 1 : at + 2]
        if follows in ("!", "?"):
            comment = page.startswith("!--", at + 1)
            end = page.find("-->" if comment else ">", at + (2 if comment else 1))
            end = len(page) if end < 0 else end + (3 if comment else 1)
            yield text, "", "", (), False
        elif name := TAG_NAME.match(page, at + 1 + (follows == "/")):
            tag = name[0].lower()
            end, attributes, closed = read_attributes(page, name.end())
            kind = "end" if follows == "/" else "start"
            if kind == "start" and tag in RAW:
                kind = "raw"
                stop = RAW_END[tag].search(page, end)
                end = read_attributes(page, stop.end())[0] if stop else len(page)
            yield text, kind, tag, attributes, closed
        elif follows == "/":
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield text, "", "", (), False
        else:
            at += 1
            continue
        begin = at = end


class OpenElements:
    """The stack of open elements, with counts that follow it."""

    def __init__(self):
        self.tags: list[str] = []
        self.paths: list[tuple[str, ...]] = []
        self.inner: list[str] = []
        self.count: dict[str, int] = {}
        self.hidden = self.foreign = 0

    def push(self, tag: str, attributes) -> None:
        path = self.paths[-1] if self.paths else ()
        words = ["<" + tag]
        for name, value in attributes:
            if name in NAMING:
                words += ["." + w.lower() for w in WORD.findall(value)]
        held = dict.fromkeys(path)
        new = [w for w in dict.fromkeys(words) if w not in held][: max(0, PATH_WORDS - len(path))]
        self.tags.append(tag)
        self.paths.append((*path, *new) if new else path)
        self.inner.append(tag if tag in BLOCKS else self.inner[-1] if self.inner else "")
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += tag in HIDDEN
        self.foreign += tag in ("svg", "math")

    def cut(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.count[tag] -= 1
            self.hidden -= tag in HIDDEN
            self.foreign -= tag in ("svg", "math")
        del self.tags[k:], self.paths[k:], self.inner[k:]

    def last(self, tag: str) -> int | None:
        if not self.count.get(tag):
            return None
        k = len(self.tags) - 1
        while self.tags[k] != tag:
            k -= 1
        return k

    def path(self) -> tuple[str, ...]:
        """Distinct tags and words of all open elements, and the innermost block."""
        if not self.tags:
            return ()
        return (*self.paths[-1], "in<" + self.inner[-1]) if self.inner[-1] else self.paths[-1]


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, linked characters) of each leaf block, in page order; a path has tags and words of class and id."""
    stack = OpenElements()
    blocks, held, linked = [], [], 0

    def close():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                blocks.append((stack.path(), text, min(linked, len(text))))
            held.clear()
        linked = 0

    def leave_head():
        k = stack.last("head")
        if k is not None and not any(tag in HIDDEN for tag in stack.tags[k + 1 :]):
            close()
            stack.cut(k)

    for text, kind, tag, attributes, closed in markup(page):
        if stack.hidden and stack.tags[-1] == "head" and text.strip() or kind == "raw" and tag not in HEAD:
            leave_head()
        if text and not stack.hidden:
            held.append(text)
            if stack.count.get("a"):
                linked += len(text)
        if kind == "end":
            if tag == "br":
                held.append(" ")
            k = stack.last(tag)
            if k is not None:
                if any(t in BLOCKS for t in stack.tags[k:]):
                    close()
                stack.cut(k)
        if kind != "start":
            continue
        if tag not in HEAD:
            leave_head()
        if tag in ("br", "wbr"):
            held.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            close()
            if tag not in ("button", "label", "option"):
                k = stack.last("p")
                if k is not None:
                    stack.cut(k)
            if any(stack.count.get(t) for t in CLOSES.get(tag, ())):
                for k in range(len(stack.tags) - 1, -1, -1):
                    if stack.tags[k] in CLOSES[tag]:
                        stack.cut(k)
                    elif stack.tags[k] in STOPS:
                        break
        if tag in VOID or closed and (tag not in BLOCKS or stack.foreign):
            continue
        stack.push(tag, attributes)
    close()
    return blocks


CALLS = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|sign (?:up|in)|log ?in|advert\w*|sponsored|share|tweet|repl(?:y|ies)|comments?|copyright|all rights reserved|privacy|terms|read more|related|search|menu|home|contact|accept|posted by|previous|next)\b|[©®]")


def text_features(text: str, linked: int) -> list[str]:
    n, words = len(text), text.count(" ") + 1
    share = linked / n
    out = [f"words{min(words.bit_length(), 8)}", "linked" + ("0" if share < 0.05 else "1" if share < 0.5 else "2" if share < 0.95 else "3"), "ends" if text[-1] in ".!?:;\"”" else "open"]
    if words < 40 and CALLS.search(text):
        out.append("calls")
    if "©" in text:
        out.append("copyright")
    if "·" in text or "|" in text:
        out.append("divided")
    return out


def block_features(path: tuple[str, ...], text: str, linked: int) -> list[str]:
    """Names of the features that hold."""
    return [*path, *text_features(text, linked)]


class Field:
    """Weights of the features for the label 1, and of the transitions from label to label."""

    def __init__(self, weights: dict[str, float], bias: float, start: list[float], move: list[list[float]]):
        self.weights, self.bias, self.start, self.move = weights, bias, start, move
        self.paths: dict[tuple[str, ...], float] = {}

    def unary(self, path: tuple[str, ...], text: str, linked: int) -> float:
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            known = self.bias + sum(self.weights.get(f, 0.0) for f in path)
            self.paths[path] = known
        return known + sum(self.weights.get(f, 0.0) for f in text_features(text, linked))

    def decode(self, blocks: list[tuple[tuple[str, ...], str, int]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move
        back, (a, b) = [], self.start
        for i, block in enumerate(blocks):
            u = self.unary(*block)
            if i:
                from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
                back.append((0 if from0 else 1, 0 if from1 else 1))
            b += u
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    """(page, [(block text, 1 for the article)]) in many layouts, from a generator with a fixed seed."""
    r = random.Random(seed)
    syllables = [c + v for c in ["", "b", "d", "k", "l", "m", "n", "r", "s", "st", "t", "th", "tr", "sch"] for v in ["a", "e", "i", "o", "en", "er", "ión", "eau"]]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def prose(low: int, high: int) -> str:
        kind, words = r.random(), [word() for _ in range(r.randint(low, high))]
        if kind < 0.08:
            return " ".join(w.upper() + "!!" for w in words)
        if kind < 0.14:
            return " ".join(w + r.choice(["$$$", "***", "%%%", "###"]) for w in words)
        if kind < 0.2:
            return " | ".join(words)
        for k in range(9, len(words), 10):
            words[k] += r.choice([".", ",", ".", "?"])
        return (" ".join(words)).capitalize() + ("." if r.random() < 0.85 else "")

    def boilerplate(kind: str) -> tuple[str, list[str]]:
        """HTML of an unwanted part, and the texts of its blocks."""
        plain = lambda: prose(2, 25)
        if kind in ("nav", "menu", "related", "share", "breadcrumb", "pager"):
            texts = [r.choice([word().title(), prose(1, 4).rstrip("."), "Home", "Contact"]) for _ in range(r.randint(2, 7))]
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(texts)) + "</ul>"
            if r.random() < 0.2:
                inner, texts = " ".join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts)), [" ".join(texts)]
            open_ = {"nav": r.choice(["nav", 'nav class="main-nav"', 'div class="nav"', 'div id="navigation" role="navigation"']), "menu": r.choice(['div class="menu"', 'ul class="menu top-menu"', 'menu', 'div id="menu"']), "related": r.choice(['div class="related"', 'section class="related-posts"', 'aside class="recommended"']), "share": r.choice(['div class="share"', 'div class="social-share"']), "breadcrumb": r.choice(['div class="breadcrumb"', 'nav aria-label="breadcrumb"', 'ol class="breadcrumbs"']), "pager": r.choice(['div class="pagination"', 'nav class="pager"'])}[kind]
        elif kind == "form":
            texts = [r.choice(["Email", "Name", "Search", word().title()]), r.choice(["Subscribe", "Send", "Sign up", "Search", word().title()])]
            inner, open_ = f"<label>{texts[0]}</label><input type=text name=q><button>{texts[1]}</button>", r.choice(["form", 'form class="newsletter"', 'form id="search" action="/s"', 'div class="form subscribe"'])
            if r.random() < 0.5:
                texts.insert(0, plain())
                inner = f"<p>{texts[0]}</p>" + inner
            if r.random() < 0.3:
                texts.append("A B")
                inner += "<select><option>A B</option></select>"
        elif kind == "comments":
            texts = [prose(3, 60) for _ in range(r.randint(1, 5))]
            open_ = r.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="discussion replies"', 'section id="reader-comments"', 'aside class="comments"'])
            who = [word().title() if r.random() < 0.4 else "" for _ in texts]
            inner = "".join((f'<h4>{w}</h4>' if w else "") + r.choice([f'<p>{t}</p>', f'<div class="comment"><p>{t}</p></div>', f'<article class="comment"><p>{t}</p></article>', f'<li class="comment">{t}</li>', f"<blockquote>{t}</blockquote>"]) for w, t in zip(who, texts))
            texts = [x for w, t in zip(who, texts) for x in ([w] if w else []) + [t]]
            if r.random() < 0.5:
                texts.insert(0, f"{len(texts)} comments")
                inner = f"<h3>{texts[0]}</h3>" + inner
        else:
            texts = [plain() for _ in range(r.randint(1, 3))]
            open_ = r.choice({
                "header": ["header", 'div class="header"', 'div id="header"', 'header class="site-header"', 'div id="masthead" role="banner"', 'div class="top-bar"'],
                "footer": ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer" role="contentinfo"', 'div class="bottom copyright"'],
                "sidebar": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="side right-rail"', 'div class="widget-area"'],
                "notice": ['div class="notice"', 'div class="cookie-banner"', 'div id="cookie-consent"', 'div class="alert" role="alert"', 'div class="notification"', 'div class="message warning"', 'div class="popup modal"', 'dialog', 'p class="notice"', 'div class="gdpr consent"', 'div class="disclaimer"'],
                "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'aside class="sponsored"', 'div id="banner-ad"', 'div class="promo"', 'div class="ad-slot"', 'section class="promotion sponsor"', 'p class="ad"', 'ins class="adsbygoogle"'],
            }[kind])
            if kind == "footer" and r.random() < 0.6:
                texts[0] = f"© {word()}.example · {texts[0]}"
            if open_.startswith(("p ", "ins")):
                texts = texts[:1]
                inner = texts[0]
            else:
                inner = texts[0] if len(texts) == 1 and r.random() < 0.6 else "".join(f"<{t}>{x}</{t}>" for x in texts for t in [r.choice(["p", "div", "p", "h3", "span"])])
                if "<span>" in inner:
                    inner = "".join(f"<p>{x}</p>" for x in texts)
            if kind == "ad" and r.random() < 0.3:
                inner = f'<a href="http://ads.example">{inner}</a>'
        return f"<{open_}>{inner}</{open_.split()[0]}>", texts

    kinds_out = ["nav", "menu", "related", "share", "breadcrumb", "pager", "form", "comments", "header", "footer", "sidebar", "notice", "ad"]
    pages = []
    for _ in range(n):
        rows: list[tuple[str, int]] = []
        parts: list[str] = []

        def put(kind: str) -> None:
            markup, texts = boilerplate(kind)
            parts.append(markup)
            rows.extend((t, 0) for t in texts)

        for kind in ("header", "nav", "notice", "ad", "breadcrumb", "menu", "form"):
            if r.random() < (0.5 if kind in ("header", "nav", "ad") else 0.25):
                put(kind)
        if r.random() < 0.12:
            put("sidebar")
        wrap = r.choice(["main", 'div class="wrapper"', 'div id="page"', ""])
        opened = r.choice(["article", "article", "article", 'article class="post"', "main", 'div class="content"', 'div class="article-body"', 'div class="post-content entry"', 'div id="content"', 'section class="story"', 'div itemprop="articleBody" class="text"', 'div class="main"', "div", "section"])
        parts.append((f"<{wrap}>" if wrap else "") + f"<{opened}>")
        if r.random() < 0.8:
            t = prose(2, 10)
            level = r.choice(["h1", "h1", "h1", "h2"])
            parts.append(r.choice([f"<{level}>{t}</{level}>", f"<{level}>{t}</{level}>", f'<header class="entry-header"><{level} class="title">{t}</{level}></header>']))
            rows.append((t, 1))
        for i in range(r.randint(1, 9)):
            t, k = prose(1, 80), r.random()
            if k < 0.7:
                extra = r.random()
                inner = f"<b>{t}" if extra < 0.1 else t.replace(" ", " <a href='/x'>", 1) + "</a>" if extra < 0.15 and " " in t else f"<em>{t}</em>" if extra < 0.2 else t
                parts.append(f"<p>{inner}" + ("</p>" if extra > 0.07 else "<br>"))
            elif k < 0.76:
                t = prose(1, 6)
                parts.append(f"<h2>{t}</h2>")
            elif k < 0.82:
                parts.append(f"<blockquote>{t}</blockquote>")
            elif k < 0.88:
                parts.append(f"<ul><li>{t}</li></ul>")
            elif k < 0.92:
                parts.append(f"<pre>{t}</pre>")
            elif k < 0.95:
                parts.append(f"<table><tr><td>{t}</td></tr></table>")
            else:
                parts.append(f"<div>{t}</div>")
            rows.append((t, 1))
            if r.random() < 0.08:
                put(r.choice(["ad", "share", "form", "related", "notice", "sidebar"]))
        if r.random() < 0.06:
            put("comments")
        parts.append(f"</{opened.split()[0]}>" + (f"</{wrap.split()[0]}>" if wrap and r.random() < 0.7 else ""))
        for kind in ("share", "comments", "sidebar", "related", "form", "ad", "pager", "notice", "footer"):
            if r.random() < (0.75 if kind == "footer" else 0.4 if kind in ("comments", "sidebar") else 0.22):
                put(kind)
        pages.append(("<html><body>" + "".join(parts) + "</body></html>", rows))
    return pages


def train_field(pages: list[tuple[str, list[tuple[str, int]]]] | None = None, steps: int = 150, rate: float = 0.1, decay: float = 0.5) -> Field:
    """Maximum penalised likelihood; forward and backward sums run over all pages at once."""
    pages = pages if pages is not None else labelled_pages()
    sequences, names = [], {}
    for page, rows in pages:
        blocks = leaf_blocks(page)
        if [b[1] for b in blocks] == [" ".join(t.split()) for t, _ in rows]:
            sequences.append(([[names.setdefault(f, len(names)) for f in block_features(*b)] for b in blocks], [y for _, y in rows]))
    sequences = [s for s in sequences if s[1]]
    most, k = max(len(y) for _, y in sequences), len(names)
    flat = np.zeros((sum(len(y) for _, y in sequences), k), np.float32)
    y, mask = np.zeros((len(sequences), most), int), np.zeros((len(sequences), most), bool)
    at = 0
    for i, (rows, labels) in enumerate(sequences):
        for row in rows:
            flat[at, row] = 1
            at += 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    w = np.zeros(k + 1 + 2 + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    both = mask[:, 1:] & mask[:, :-1]
    empirical = np.concatenate((flat.T @ y[mask].astype(np.float32), [(y * mask).sum()], [(y[:, 0] == c).sum() for c in (0, 1)], [((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for a in (0, 1) for b in (0, 1)]))
    for t in range(1, steps + 1):
        unary = np.zeros(y.shape)
        unary[mask] = flat @ w[:k].astype(np.float32) + w[k]
        score = np.stack((np.zeros_like(unary), unary), axis=2)
        move, start = w[k + 3 :].reshape(2, 2), w[k + 1 : k + 3]
        alpha, beta = np.zeros(score.shape), np.zeros(score.shape)
        alpha[:, 0] = start + score[:, 0]
        for j in range(1, most):
            alpha[:, j] = np.where(mask[:, j, None], np.logaddexp.reduce(alpha[:, j - 1, :, None] + move, axis=1) + score[:, j], alpha[:, j - 1])
        for j in range(most - 2, -1, -1):
            beta[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(move + (score[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        expected = np.concatenate((flat.T @ node[:, :, 1][mask].astype(np.float32), [node[:, :, 1].sum()], node[:, 0].sum(axis=0), edge.sum(axis=(0, 1)).ravel()))
        gradient = expected - empirical + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()}, float(w[k]), w[k + 1 : k + 3].tolist(), w[k + 3 :].reshape(2, 2).tolist())


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(text for (_, text, _), label in zip(blocks, field.decode(blocks)) if label)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = (field.weights, field.bias, field.start, field.move)

    def read(batches):
        own = Field(*weights)
        for batch in batches:
            texts = [main_text(page or "", own) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bound_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"), train_field())
