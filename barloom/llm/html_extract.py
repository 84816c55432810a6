"""Main text of web pages by a recurrent block labeller that learns from the pages themselves.

Nobody labels the pages, so the labeller learns from those whose markup says what is what: blocks in an ``article`` or
``main`` are main text unless a part named below encloses them, and all other blocks are not. From each such page's own
text further pages are laid out with other markup: bodies without ``article``, menus, notices, adverts, forms and reader
comments under the names that pages give them, within the body and around it. There the labels are known because the layout
is, and since comments and asides repeat sentences of the body, the words alone don't tell; the path and the neighbours do.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_labeller import from_bytes, initial, probabilities, to_bytes, train
from .common import col, per_text
from .html_blocks import Block, leaf_blocks

# Names that pages give to parts which are no main text, by kind.
PARTS = {
    "menu": ["<nav>", '<nav class="navbar">', '<div class="menu">', '<div id="nav">', '<ul class="navigation">', '<div role="navigation">', '<div class="breadcrumbs">', '<div class="pagination pager">', '<menu>', '<div class="tabs">'],
    "header": ["<header>", '<header class="site-header">', '<div id="header">', '<div class="masthead">', '<div class="top-bar">', '<div role="banner">', '<div class="site-title logo">'],
    "footer": ["<footer>", '<footer class="site-footer">', '<div id="footer">', '<div class="footer bottom">', '<div role="contentinfo">', '<div class="copyright legal">'],
    "aside": ["<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="side-column">', '<div class="related-posts">', '<div class="widget">', '<section class="recommended more-stories">', '<div class="popular trending">', '<div role="complementary">', '<div class="author-bio">', '<div class="tags">'],
    "notice": ['<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="consent gdpr">', '<div class="alert warning">', '<div class="notice">', "<dialog>", "<noscript>", '<div class="popup modal overlay">', '<div role="dialog">', '<div class="paywall">', '<div role="alert">', '<section class="cookies privacy">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="advertisement">', '<ins class="adsbygoogle">', '<div class="sponsored">', '<section class="promo promotion">', '<aside class="ad-slot">', '<div class="banner-ad">'],
    "form": ["<form>", '<form class="newsletter">', '<div class="subscribe signup">', '<form id="search">', '<form role="search">', "<fieldset>", '<div class="login">', '<section class="newsletter">'],
    "comments": ['<section id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div id="disqus-thread">', '<div class="responses replies">', '<section class="user-comments discussion">', '<div class="comment">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="share-buttons">', '<button>', '<div class="toolbar">', "<select>", "<svg>", '<div hidden>', '<div style="display:none">'],
}
BODIES = ["<article>", "<main>", "<main><article>", '<article class="post">', '<div class="content">', '<div id="content">', '<div class="post entry">', '<div class="article-body">', '<section class="story">', "<section>", "<div>", "<table><tr><td>", '<div role="main">', '<div class="container"><div class="row">', '<div itemprop="articleBody">', "<div><div>"]
#: Marks a body block in a layout; a private character that no page's text keeps.
_MARK = "\ue000"
_OUTSIDE_TAGS = frozenset("nav aside footer form dialog noscript menu fieldset button select svg ins".split())
_OUTSIDE_WORDS = frozenset(t for kinds in PARTS.values() for p in kinds for t in leaf_blocks(p + "x")[0].path if t[0] in ".?") - {".top", ".post", ".more", ".story", ".stories", ".section", ".side", ".user", ".slot", ".site", ".list", ".tags", ".title", ".thread"}


def is_outside(b: Block) -> bool:
    """Whether a part that holds no main text encloses the block, by its tags and names."""
    return any(t in _OUTSIDE_TAGS or t in _OUTSIDE_WORDS for t in b.path)


def labelled_by_markup(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its body, None of one that doesn't."""
    inside = np.array([any(t in ("article", "main", ".main") for t in b.path) for b in blocks], bool)
    return inside & ~np.array([is_outside(b) for b in blocks], bool) if inside.any() else None


def _close(opening: str) -> str:
    return "".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed(opening.split("<")[1:]))


def lay_out(body: list[str], rest: list[str], rnd: random.Random) -> str:
    """A page with this body, each of whose blocks begins with the mark, among parts filled with the rest and repeats of the body."""
    spare = [t for t in rest if t] or ["more"]
    e = html.escape
    some = lambda: e(rnd.choice(spare))
    bit = lambda: e(" ".join(rnd.choice(spare + body).split()[: rnd.randint(1, 12)]))
    link = lambda: f'<a href="/{rnd.randrange(99)}">{bit()}</a>'

    def part(kind: str) -> str:
        opening = rnd.choice(PARTS[kind])
        if kind in ("menu", "share") or kind == "aside" and rnd.random() < 0.5:
            inner = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(1, 8)))
            inner = rnd.choice([inner if opening.startswith(("<ul", "<menu")) else f"<ul>{inner}</ul>", " ".join(link() for _ in range(rnd.randint(1, 6))), bit()])
        elif kind == "comments":
            inner = "".join(rnd.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "<p>{}</p>"]).format(rnd.choice([f"<b>{bit()}</b>", ""]) + f"<p>{e(rnd.choice(body))}</p>") for _ in range(rnd.randint(1, 5)))
            inner = rnd.choice(["", f"<h3>{bit()}</h3>"]) + inner
        elif kind == "form":
            inner = f"<label>{bit()}</label><input><button>{bit()}</button>" + rnd.choice(["", f"<p>{some()}</p>"])
        else:
            inner = rnd.choice([some(), f"<p>{some()}</p>", f"<h3>{bit()}</h3><p>{some()}</p>", f"<p>{bit()}</p><p>{link()}</p>", e(rnd.choice(body))])
        return opening + inner + _close(opening)

    def block(t: str, first: bool) -> str:
        t = _MARK + e(t)
        if first and rnd.random() < 0.8:
            return rnd.choice([f"<h1>{t}</h1>", f"<h2>{t}</h2>", f"<header><h1>{t}</h1></header>"])
        return rnd.choice([f"<p>{t}</p>"] * 9 + [f"<p><b>{t}<br>", f"<p>{t}", f"<div>{t}</div>", f"<ul><li>{t}</li></ul>", f"<blockquote>{t}</blockquote>", f"<pre>{t}</pre>", f"<h2>{t}</h2>", f"<p><a href='#'>{t}</a></p>", f"<figure><figcaption>{t}</figcaption></figure>"])

    opening = rnd.choice(BODIES)
    inner = []
    for k, t in enumerate(body):
        inner.append(block(t, k == 0))
        if rnd.random() < 0.06:
            inner.append(part(rnd.choice(["advert", "share", "aside", "form", "notice"])))
    if rnd.random() < 0.15:
        inner.append(part(rnd.choice(["comments", "share", "aside"])))
    before = [part(k) for k in ("notice", "header", "menu", "advert", "form", "aside", "share") if rnd.random() < 0.45]
    after = [part(k) for k in ("share", "comments", "aside", "advert", "form", "notice", "footer", "menu") if rnd.random() < 0.45]
    rnd.shuffle(before)
    return "<html><body>" + "".join(before) + opening + "".join(inner) + _close(opening) + "".join(after) + "</body></html>"


def labelled_pages(pages: list[str], layouts: int) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and labels of the pages that mark their body, and of ``layouts`` further layouts, dealt evenly over these pages."""
    rnd = random.Random(0)
    found, labels = [], []
    cut = [leaf_blocks(page) for page in pages]
    marked = [(blocks, label) for blocks, label in zip(cut, map(labelled_by_markup, cut), strict=True) if label is not None and label.any()]
    for k, (blocks, label) in enumerate(marked):
        found.append(blocks)
        labels.append(label)
        body, rest = [b.text for b, y in zip(blocks, label, strict=True) if y], [b.text for b, y in zip(blocks, label, strict=True) if not y]
        for _ in range((k + 1) * layouts // len(marked) - k * layouts // len(marked)):
            again = leaf_blocks(lay_out(body, rest, rnd))
            found.append([b._replace(text=b.text.replace(_MARK, "") or "-") for b in again])
            labels.append(np.array([b.text.startswith(_MARK) for b in again], bool))
    return found, labels


def fit_block_labeller(pages: DataFrame, html_col: str = "html", sample: int = 400, longest: int = 200_000, layouts: int = 1200) -> bytes:
    """The labeller's weights, learnt in one task from at most ``sample`` distinct pages of at most ``longest`` characters, and ``layouts`` layouts of these.

    The pages are those of least hash among those that mark their body, so the sample depends neither on how often pages
    repeat nor on how they are dealt. Without such a page the weights are the initial ones.
    """
    texts = pages.select(col(html_col).cast("string").alias("html")).filter((F.length("html") <= longest) & F.col("html").rlike("(?i)<(article|main)"))
    chosen = texts.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(sample)
    bounded = texts.withColumn("h", F.xxhash64("html")).join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, t) for b in batches for h, t in zip(b.column("h").to_pylist(), b.column("html").to_pylist(), strict=True))
        if rows:
            yield pa.RecordBatch.from_pydict({"weights": [to_bytes(train(*labelled_pages([t for _, t in rows], layouts)))]})

    learnt = bounded.repartition(1).mapInArrow(learn, "weights binary").collect()
    return bytes(learnt[0][0]) if learnt else to_bytes(initial())


def extract_main_text(pages: DataFrame, weights: bytes, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), least: float = 0.5) -> DataFrame:
    """The columns ``carry``, ``text`` (the blocks of probability ``least`` or more, joined by line feeds), ``n_blocks`` and ``n_main``.

    Character references are decoded, white space in a block (that of Unicode) becomes one space, and its ends are trimmed;
    nothing else is dropped or cut. A null or empty page, or one without text, gives an empty text. Every row gives one
    row, repeated rows included; an empty table gives none. Other columns are not read, whatever their names.
    """

    def of_pages(texts: list[str | None]) -> list[pa.Array]:
        w = from_bytes(weights)
        blocks = [leaf_blocks(t) if t else [] for t in texts]
        kept = [[b.text for b, y in zip(page, p >= least, strict=True) if y] for page, p in zip(blocks, probabilities(w, blocks), strict=True)]
        return [pa.array(["\n".join(k) for k in kept], pa.string()), pa.array([len(b) for b in blocks], pa.int64()), pa.array([len(k) for k in kept], pa.int64())]

    rows = pages.select(*(col(c) for c in carry), col(html_col).cast("string").alias("_page"))
    return per_text(rows, "text string, n_blocks long, n_main long", of_pages)
