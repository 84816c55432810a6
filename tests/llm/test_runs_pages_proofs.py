"""Periodic runs, page extraction and the Merkle manifest against brute force, held-out layouts and the tables' own markup."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import block_labeller, html_extract, merkle_manifest, periodic_runs, queries
from barloom.llm.common import crc_mod
from barloom.llm.html_blocks import leaf_blocks

from ..conftest import DATA
from . import fixtures
from .test_operators import same


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- periodic runs ----------------------------------------------------------------------------------------------------


def naive_runs(words, least=6):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def naive_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(x for i, x in enumerate(words) if i not in gone)


@pytest.mark.parametrize("block", [200, periodic_runs.BLOCK])
def test_runs_brute_force(monkeypatch, block):
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(150):
        texts: list = [None, "", " \t "]
        for _ in range(rnd.randint(1, 5)):
            letters, words = rnd.choice([1, 2, 3, 40]), []
            for _ in range(rnd.randint(1, 5)):
                root = [f"W{rnd.randrange(letters)}" for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 13, 17, 33]))]
                words += rnd.choice([root, (root * 9)[: rnd.randint(3 * len(root), 9 * len(root))]])
            texts.append(" ".join(words * rnd.choice([1, 1, 4])))
        for t, (runs, kept) in zip(texts, periodic_runs.runs_of_texts(texts, 6), strict=True):
            words = (t or "").encode().split()
            assert runs == naive_runs(words)
            assert kept == naive_collapsed(words, runs)


def test_runs_of_long_texts():
    root = [f"w{i}" for i in range(5000)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 20_000:  # no exponent of 4 in these
        a, b = b, b + a
    (one, _), (two, kept), (three, _) = periodic_runs.runs_of_texts([" ".join(root * 5), "x " * 100_000, " ".join(b)], 6)
    assert one == [(0, 25_000, 5000)] and two == [(0, 100_000, 1)] and kept == b"x" and three == []


def test_runs_operator(spark):
    docs, rows = fixtures.corpus(spark), fixtures.rows(fixtures.corpus(spark))
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    want = [(i, tuple(naive_runs(w)), naive_collapsed(w, naive_runs(w)).decode()) for i, t, _ in rows for w in [(t or "").encode().split()] if len(w) < 400]
    found = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got.collect())
    assert not Counter(want) - found and sum(found.values()) == len(rows)
    assert periodic_runs.periodic_runs(fixtures.empty(docs)).count() == 0


def test_runs_query(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        elif n > 400:
            continue
        runs = naive_runs(words) if n <= 400 else naive_planted(words)
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *figures, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), hashlib.sha256(naive_collapsed(words, runs)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.op11_periodic_runs(spark, DATA).collect()}
    assert len(want) > 50 and {i: got[i] for i in want} == want
    assert any(v[0] for v in want.values())


def naive_planted(words):
    """Runs of a longer text, by comparing arrays period by period."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([codes[w] for w in words])
    if len(x) > 3000:
        return None
    out = []
    for q in range(1, len(x) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], x[:-q] == x[q:], [0])).astype(int)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + q - a >= max(6, 4 * q) and not any(np.array_equal(x[a : b + q - p], x[a + p : b + q]) for p in range(1, q)):
                out.append((a, b + q - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


# --- pages ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.fit_block_labeller(spark.read.parquet(f"{DATA}/pages.parquet"))


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>a<b>b<br>c<p>d</p>e") == ["ab c", "d", "e"]
    assert texts("a &amp b &am;lt; &lt;x&gt;<!-- no > --> t<!-->u") == ["a & b &am;lt; <x> tu"]
    assert texts("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>x<script>var a='</p>';</script>y<style>q") == ["1", "2", "3", "4", "xy"]
    assert texts("<a href='x>y'>li\n nk</a>&nbsp;z<img alt=it's><td>q</td") == ["li nk z", "q"]
    assert texts("< 5 and 3<4 <3") == ["< 5 and 3<4 <3"] and texts("") == [] and texts(" &nbsp;<p> </p>") == []
    assert leaf_blocks('<DIV class="cookieNotice top-bar" hidden>a</DIV>')[0].path == ("root", "div", ".cookie", ".notice", ".top", ".bar", "?hidden")
    assert leaf_blocks("<a href=x>four</a> six")[0].linked == pytest.approx(4 / 8)
    for hostile in ('<a "', "<b>", "<div>", "<!--", "<script>", "<ul><li>", "&", "<li><ul><div>", "<a ="):
        leaf_blocks(hostile * 50_000)


def test_gradients():
    pages = [r.html for r in _pages()[:3]]
    blocks, labels = html_extract.labelled_pages(pages, 3)
    w = block_labeller.initial(1)
    x, y = block_labeller.Inputs(blocks), np.concatenate(labels).astype(np.float64)
    grads = block_labeller._gradients(w, x, np.argsort(-x.sizes, kind="stable"), y)

    def loss(changed):
        p = np.concatenate(block_labeller.probabilities(changed, blocks)).astype(np.float64)
        return -np.mean(np.where(y > 0, np.log(p), np.log(1 - p)))

    for name, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        moved = []
        for d in (0.01, -0.01):
            v = {k: a.astype(np.float64) for k, a in w.items()}
            v[name][i] += d
            moved.append(loss(v))
        assert g[i] == pytest.approx((moved[0] - moved[1]) / 0.02, rel=0.02), name


def _pages():
    import pyarrow.parquet as pq

    return [type("Page", (), r) for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()]


def test_unseen_pages(spark, weights):
    """Held-out pages of other sizes' tables in unseen layouts: blocks nearly always right."""
    held = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id >= 150").collect()]
    blocks, labels = html_extract.labelled_pages(held, 2 * len(held))
    wrong = sum(int(((p >= 0.5) != y).sum()) for p, y in zip(block_labeller.probabilities(block_labeller.from_bytes(weights), blocks), labels, strict=True))
    assert wrong < 0.005 * sum(map(len, blocks))


HAND = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div class="cookie-consent"><p>We use cookies to improve this site.</p><button>OK</button></div>
<header class="site-header"><a href="/">Some site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<main><h1>A &lt;title&gt; &amp; more</h1><p>First   paragraph of the text,<br>with a <em>second</em> line.</p><div class="ad">Buy this now!</div><p>Second paragraph &eacute; has words, and more words.</p></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I liked the first paragraph of the text.</p></div></section>
<form class="newsletter"><label>Your address</label><input><button>Send</button></form><footer>&copy; Some site</footer><script>x("<p>no</p>")</script></body></html>"""


def test_extraction(spark, weights):
    cases = [(1, HAND, "u"), (1, HAND, "u"), (2, None, None), (3, "", ""), (4, "<script>x</script>", "u"), (None, "<nav><a href=x>Menu</a></nav>", "u")]
    df = spark.createDataFrame([(i, h, u, "x", 1.0) for i, h, u in cases], "page_id long, html string, url string, text string, n_main double")
    got = html_extract.extract_main_text(df, weights)
    assert got.columns == ["page_id", "url", "text", "n_blocks", "n_main"]
    main = "A <title> & more\nFirst paragraph of the text, with a second line.\nSecond paragraph é has words, and more words."
    same([(r.page_id, r.url, r.text) for r in got.collect()], [(1, "u", main), (1, "u", main), (2, None, ""), (3, "", ""), (4, "u", ""), (None, "u", "")])
    assert html_extract.extract_main_text(df.limit(0), weights).count() == 0
    assert html_extract.fit_block_labeller(df.limit(0)) == block_labeller.to_bytes(block_labeller.initial())


def test_copies_do_not_sway_the_sample(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(8)
    copies = pages.unionByName(pages.limit(1).crossJoin(spark.range(50)).drop("id"))
    assert html_extract.fit_block_labeller(pages, layouts=0) == html_extract.fit_block_labeller(copies, layouts=0)


def test_extraction_query(spark):
    """The tables' pages mark their body, so a plain reading of the markup gives each page's text."""
    want = []
    for p in _pages():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(x for x in parts if x)
        want.append((p.page_id, p.url, text, len(text)))
    got = queries.op12_html_extract(spark, DATA)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    same([tuple(r)[:4] for r in got.collect()], want)


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def naive_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def naive_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = nodes[at[i] // 8 * 8 :][:8]
            path.append(("".join(run[: at[i] % 8]), "".join(run[at[i] % 8 + 1 :])))
            at[i] //= 8
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def naive_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, naive_leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: naive_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = naive_tree([trees[g][0] for g in names])
    for g, above in zip(names, upper, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            crc = zlib.crc32(b"" if r[0] is None else str(r[0]).encode())
            lower = None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
            x = naive_leaf(*r[:4], lower) if crc % 3 == 0 else leaf
            for left, right in path + above:
                x = sha(left, x, right)
            yield r[0], leaf, trees[g][0], root, sha(*(a + b for a, b in path + above)), x, x == root


def mixed_rows():
    rnd = random.Random(3)
    ids = [None, -5, -1, 0, 3, 7, 2**40, -(2**62), 2**63 - 1, -(2**63), 77, 77]
    return [(rnd.choice([*ids, rnd.randrange(200_000), rnd.randrange(-100, 100)]), rnd.choice(["a", None]), rnd.choice([None, "", "en", "é", "zz", "en"]), rnd.choice([None, 1]), rnd.choice([None, "", "Ä B", "AbC é", str(rnd.randrange(50))])) for _ in range(3000)]


@pytest.mark.parametrize("rows", [[], [(5, None, None, None, None)], [(i, "s", "en", 3, "Abc") for i in range(9)], [(1, "s", "en", 3, "Abc")] * 5000 + [(2, "s", "en", 3, str(i)) for i in range(700)], mixed_rows(), [(i, "s", f"l{i}", 3, "Abc") for i in range(600)]], ids=["empty", "one", "nine", "copies", "mixed", "groups"])
def test_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos long, grp string, digest string").repartition(3)
    changed = {"text": F.when(crc_mod("doc_id", 3) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}
    got = merkle_manifest.merkle_manifest(docs, tampered=changed)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same([tuple(r) for r in got.collect()], naive_manifest(rows) if rows else [])
