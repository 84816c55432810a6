"""Each operator against brute force, on a corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import brown_lm, decontaminate, hashing, jaccard_join, language_id, line_dedup, packing, pii, queries, substring_dedup, token_counts, vector_topk
from barloom.llm.common import crc_mod

from ..conftest import DATA
from . import fixtures


@pytest.fixture(scope="module")
def docs(spark):
    df = fixtures.corpus(spark).persist()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def rows(docs):
    return fixtures.rows(docs)


def words(text):
    return (text or "").encode().lower().split()


def same(got, want):
    assert Counter(got) == Counter(want)


# --- PII --------------------------------------------------------------------------------------------------------------


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for kind, rx, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(rx, t):
            d = [int(x) for x in m[0] if x.isdigit()]
            if low <= len(d) <= high and (kind == "phone" or sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0):
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b@c.com x@y.z.", "@b.com a@.com a.b+c@d-e.f.g@h.i", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.0255", "4111 1111-1111 1111 4111111111111112 4111-1111-1111-1111", "+1 (269) 555-3296 4524132264652876", "++1 2345678 90 +12", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not GB00WEST12345698765432", "my SSN is 078-05-1120 but 078-05-1121 is " + "far " * 20 + "078-05-1122", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]


def test_pii_base(spark, docs, rows):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for df, data in ((docs, rows), (made, [(i, t, None) for i, t in enumerate(TRICKY)])):
        got = [(r.doc_id, r.base_sha256, r.n_card) for r in pii.span_digest(pii.detect_pii(df)).collect()]
        want = []
        for i, t, _ in data:
            s = base_spans(t or "")
            want.append((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(), sum(k == "card" for k, *_ in s)))
        same(got, want)


def test_pii_scored():
    kinds = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in pii.find_spans(t, 0.5) if not s["base"]]
    assert kinds(TRICKY[4]) == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    assert kinds(TRICKY[6]) == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert kinds(TRICKY[7]) == [("id", "078-05-1120"), ("id", "078-05-1121")]
    assert kinds(TRICKY[8]) == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert kinds("Clean words, 12 of them, and the year 1999-2004.") == []


@pytest.mark.parametrize("run", [1, 200_000])
def test_pii_linear(run):
    text = "1" * run + " " + "a" * run + " " + "1.1" * run + "+" * run + "@" * run
    assert pii.find_spans(text, 0.5) is not None


def test_pii_dense():
    # many spans of one kind, national numbers after and between international ones: none overlap, and it takes little time
    text = "call +1 269 555 3296 or phone (269) 555-3297, " * 8000
    found = pii.find_spans(text, 0.5)
    phones = sorted((s["start"], s["end"]) for s in found if s["kind"] == "phone")
    assert len(phones) >= 16_000 and all(a[1] <= b[0] for a, b in zip(phones, phones[1:], strict=False))


# --- language ---------------------------------------------------------------------------------------------------------


def test_language(spark, docs):
    model = language_id.fit_language_model(docs.filter(crc_mod("doc_id", 3) != 1))
    got = language_id.identify(docs, model, carry=("lang", "text")).toPandas()
    assert len(got) == docs.count()
    none = got["text"].map(lambda t: not language_id.has_letter(t))
    assert (got["lang_pred"][none] == "und").all() and (got["score"][none] == 0).all()
    held = got[~none & got["doc_id"].map(lambda i: i == i and i < 10_000 and zlib.crc32(str(int(i)).encode()) % 3 == 1)]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_empty(spark, docs):
    model = language_id.fit_language_model(fixtures.empty(docs))
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(fixtures.empty(docs), model).count() == 0


def test_language_sample_of_copies(spark):
    # few distinct texts among many copies and letterless rows: each language still yields all it can
    data = [("aa", "uno due tre")] * 5000 + [("aa", f"quattro cinque {i}") for i in range(29)] + [("aa", str(i)) for i in range(500)]
    data += [("bb", f"one two three {i}") for i in range(3000)] + [("cc", "eins zwei"), ("cc", "drei vier"), ("dd", "123")]
    rows = spark.createDataFrame(data, "lang string, text string")
    got = [(r.lang, r.text) for r in language_id.training_sample(rows, 20, 400).collect()]
    assert len(set(got)) == len(got) and Counter(k for k, _ in got) == {"aa": 20, "bb": 20, "cc": 2}
    more = rows.unionByName(rows.filter("text = 'uno due tre'"))
    same([(r.lang, r.text) for r in language_id.training_sample(more, 20, 400).collect()], got)
    assert language_id.fit_language_model(rows, per_class=20).languages == ["aa", "bb", "cc"]
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.fit_language_model(rows, max_classes=2)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    z = np.log(np.eye(3)[y] * 0.6 + 0.4 / 3)
    y = np.array([rng.choice(3, p=np.exp(r) / np.exp(r).sum()) for r in z])
    assert language_id.temperature(z * 5, y) == pytest.approx(5, rel=0.15)


# --- language model ---------------------------------------------------------------------------------------------------


def lm_fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def test_lm(docs, rows):
    got = brown_lm.score_texts(docs, crc_mod("doc_id", 10) != 0, vocabulary=300, n_classes=12, sweeps=3)
    c = Counter(w for i, t, _ in rows if lm_fold(i) for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    want = [(i, lm_fold(i) != 0, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b""]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), b""]), 6)) for i, t, _ in rows]
    out = got.collect()
    same([(r.doc_id, r.is_train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out], want)
    held = [r for r in out if not r.is_train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.perplexity > 1 for r in out)


def test_lm_scores_by_brute_force(docs, rows, monkeypatch):
    made = {}
    plain = brown_lm.class_vocabulary

    def keep(*args):
        known = plain(*args)
        made.update({r.word: (r.n, r.c) for r in known.collect()})
        return known

    monkeypatch.setattr(brown_lm, "class_vocabulary", keep)
    got = brown_lm.score_texts(docs, crc_mod("doc_id", 10) != 0, vocabulary=50, n_classes=8, sweeps=3, least_count=3).collect()
    rare, end, k = 8, 9, 10
    codes = lambda t: brown_lm._hashed(pa.array([(t or "").encode()], pa.binary()))[0].tolist() + [brown_lm.END]
    texts = [(i, codes(t)) for i, t, _ in rows]
    n = Counter(w for i, t in texts if lm_fold(i) for w in t)
    assert {w: x for w, (x, _) in made.items()} == n
    placed = [w for w, (x, c) in made.items() if c < rare]
    assert len(placed) > 60 and all(n[w] >= 3 for w in placed) and sum(c == rare for _, c in made.values()) == sum(x < 3 for x in n.values())
    cls = lambda w: made[w][1] if w in made else rare
    pairs = Counter((p, q) for i, t in texts if lm_fold(i) for p, q in zip([end, *map(cls, t)], map(cls, t), strict=False))
    after, members, tokens = Counter(), Counter(), Counter()
    for (p, _), x in pairs.items():
        after[p] += x
    for w, (x, c) in made.items():
        members[c] += 1
        tokens[c] += x
    step = lambda p, w: math.log10((pairs[p, cls(w)] + 0.1) / (after[p] + 0.1 * k)) + math.log10((n[w] + 0.1) / (tokens[cls(w)] + 0.1 * (members[cls(w)] + 1)))
    want = [(i, round(sum(step(p, w) for p, w in zip([end, *map(cls, t)], t, strict=False)), 6)) for i, t in texts]
    same([(r.doc_id, round(r.score, 6)) for r in got], want)


def test_lm_is_a_distribution():
    # the class model's probabilities over all words and one unseen word add up to 1 after any class
    joint, counts, classes = np.array([[3.0, 1], [2, 4]]), np.array([4.0, 2, 5]), np.array([0, 0, 1])
    trans = (joint + 0.1) / (joint.sum(axis=1, keepdims=True) + 0.2)
    total = np.array([counts[classes == k].sum() + 0.1 * ((classes == k).sum() + 1) for k in (0, 1)])
    emit = (counts + 0.1) / total[classes]
    unseen = 0.1 / total
    assert np.allclose([sum(trans[p, classes[w]] * emit[w] for w in range(3)) + (trans[p] * unseen).sum() for p in (0, 1)], 1)


def test_lm_without_training(docs):
    out = brown_lm.score_texts(docs, F.lit(False)).limit(20).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in out)


def test_exchange():
    # each sweep raises the likelihood; at the end no single move of any word does
    rng = np.random.default_rng(0)
    m = rng.integers(0, 3, (22, 22))
    m[:10, :10] += 20
    m[10:20, 10:20] += 20
    a, b = np.nonzero(m)
    e = brown_lm.Exchange(a, b, m[a, b], 20, 3)

    def fit(classes):
        j = np.array([[m[np.ix_(classes == x, classes == y)].sum() for y in range(5)] for x in range(5)], float)
        return brown_lm._xlogx(j).sum() - brown_lm._xlogx(j.sum(0)).sum() - brown_lm._xlogx(j.sum(1)).sum()

    assert e.likelihood() == pytest.approx(fit(e.classes))
    was, moved = e.likelihood(), 1
    while moved:
        moved = e.sweep()
        assert e.likelihood() == pytest.approx(fit(e.classes)) and e.likelihood() >= was - 1e-6
        was = e.likelihood()
    for w in range(20):
        for k in range(3):
            other = e.classes.copy()
            other[w] = k
            assert fit(other) <= was + 1e-5
    assert len({(c,) for c in e.classes[:10]} & {(c,) for c in e.classes[10:20]}) == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(data, percent=75):
    sets = [shingles(t) for _, t, _ in data]
    inverted = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(k)
    groups = defaultdict(list)
    for k in range(len(data)):
        groups[find(k)].append(k)
    least = {k: min((data[j][0] for j in g if data[j][0] is not None), default=None) for g in groups.values() for k in g}
    return [(d[0], len(sets[k]), least[k]) for k, d in enumerate(data)], [[data[k] for k in g] for g in groups.values()]


@pytest.mark.parametrize("rounds", [0, 4])
def test_near_duplicates(docs, rows, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()]
    same(got, closure(rows)[0])


def test_near_duplicates_of_chains(spark):
    # each text differs from the next in few words, the ends differ a lot; a second family shares most of its words with the first
    base = [f"w{i}" for i in range(120)]
    made = [(i, " ".join(f"x{j}" if j < i * 2 else w for j, w in enumerate(base)), None) for i in range(25)]
    made += [(100 + i, " ".join(f"y{i}-{j}" if j % 17 == i % 17 else w for j, w in enumerate(base)), None) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    same([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()], closure(made)[0])


def test_keep_one(docs, rows):
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs.select("doc_id", "text", "source")).collect()]
    for group in closure(rows)[1]:
        members = {(i, t) for i, t, _ in group}
        if shingles(group[0][1]):
            assert sum(k in members for k in kept) == 1
        else:
            assert sum(k in members for k in kept) == len(group)


def test_empty_tables(docs):
    none = fixtures.empty(docs)
    assert jaccard_join.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.remove_repeated_chunks(none).count() == 0
    assert brown_lm.score_texts(none, F.lit(True)).count() == 0
    assert pii.detect_pii(none).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_contamination(spark, docs, rows):
    extra = [(900, None), (901, ""), (902, "One, two!"), (903, " ".join(rows[0][1].split()[:14]) if rows[0][1] else "x"), (903, "one two three"), (None, "edit1")]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    windows = defaultdict(set)
    for i, t in bench.collect():
        w = bench_words(t)
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            windows[tuple(w[k : k + min(13, len(w))])].add(i)
    sizes = {len(w) for w in windows}
    want = []
    for i, t, _ in rows:
        w, hit, items = bench_words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= found
        want.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in items if x is not None)), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(docs, bench).collect()
    same([(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in got], want)
    assert sum(x[-1] for x in want) > 3
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)


def test_no_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(fixtures.empty(docs), none).count() == 0


def test_proximity(spark):
    item = "the quick zebra jumps over seven lazy walruses near a frozen lake today"
    texts = [item, item.replace("jumps over", "jumps right over"), "zebra " + "pad " * 30 + "walruses", "nothing here"]
    docs = spark.createDataFrame([(i, t + " the the a a over") for i, t in enumerate(texts)], "doc_id long, text string")
    m = decontaminate.Matcher(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    of = {r.k1: r.doc_id for r in m.corpus.select("k1", "doc_id").collect()}
    assert {of[r.k1] for r in m.phrases().collect()} == {0}
    near = {of[r.k1] for r in m.near(4).collect()}
    assert 0 in near and not near & {2, 3}
    m.close()


# --- tokens -----------------------------------------------------------------------------------------------------------


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for i, x, _ in rows]
    for chunk, overlap in ((32_768, 512), (700, 40), (64, 36)):
        got = token_counts.count_tokens(docs, path, chunk_chars=chunk, overlap=overlap)
        same([(r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()], want)


def test_tokens_of_odd_texts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    t = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b" * 40, " " * 500, "x" * 2000, "\n\n  \t a b  c\r\n" * 60, "日本語のテキスト" * 60, "don't I'll we've 12 345,678.90 " * 30, "👩‍👩‍👧 é é " * 50, "<|endof", "\x1c\x1d\x1e\x1f\x85 a" * 30]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    want = [(i, len(t.encode(x, add_special_tokens=False))) for i, x in enumerate(odd)]
    for chunk in (100_000, 200, 90):
        same([(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, path, chunk_chars=chunk, overlap=48).collect()], want)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_plain_characters_split_alike():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    t = Tokenizer.from_file(path)
    for cp in range(0x250):
        c = chr(cp)
        if token_counts.PLAIN.fullmatch(c):
            for s in (f"a{c}b", f" {c} {c}{c}1", f"{c}\n{c} x", f"1{c}2 {c}'s"):
                assert token_counts.count_tokens_of([s], path) == [len(t.encode(s, add_special_tokens=False))], hex(cp)


# --- packing ----------------------------------------------------------------------------------------------------------


def check_packing(got, lengths, capacity, one_per_source):
    by_bin, total = defaultdict(list), Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        if r.bin >= 0:
            by_bin[r.shard, r.bin].append(r)
    assert total == Counter({i: max(0, n or 0) for i, n, *_ in lengths})
    attributes = {i: (s, c) for i, _, s, c in lengths}
    for items in by_bin.values():
        items.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in items:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= capacity
        for k in (1, 0) if one_per_source else (1,):
            values = [attributes[r.doc_id][k] for r in items if attributes[r.doc_id][k] is not None]
            assert len(values) == len(set(values))
    return by_bin


@pytest.mark.parametrize("one_per_source", [True, False])
def test_packing(spark, one_per_source):
    rng = np.random.default_rng(3)
    lengths = [(i, int(rng.integers(0, 300)) if i % 50 else None, None if i % 31 == 0 else f"s{i % 3 if i % 2 else 0}", None if i % 7 else f"c{i % 4}") for i in range(3000)] + [(5000, 2500, "s1", None), (5001, 1000, None, None), (5002, -4, "s1", "c1")]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long, source string, cluster string")
    by_bin = check_packing(packing.best_fit_pack(df, 1000, one_per_source=one_per_source).collect(), lengths, 1000, one_per_source)
    if not one_per_source:
        used = sum(r.n_tokens for b in by_bin.values() for r in b)
        assert used / (1000 * len(by_bin)) > 0.95
    assert packing.best_fit_pack(df.limit(0)).count() == 0


def test_tightest_compatible_bin():
    lengths, sources, clusters = np.array([700, 600, 300, 290, 100]), np.array([0, 1, 0, 2, 0]), np.array([-1, 0, -1, 0, -1])
    bins, offsets, n = packing.pack(lengths, sources, clusters, 1000, True)
    # 300 conflicts with the tightest bin's source and goes to the next; 290 conflicts there by cluster and goes back to the first
    assert bins.tolist() == [0, 1, 1, 0, 2] and offsets.tolist() == [0, 0, 600, 700, 0] and n == 3


# --- substrings -------------------------------------------------------------------------------------------------------


def removed(data, length):
    raw = [(t or "").encode() for _, t, _ in data]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(data, raw, strict=True):
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), kept))
    return out


@pytest.mark.parametrize("group", [4096, 2])
@pytest.mark.parametrize("length", [200, 70])
def test_substrings(docs, rows, length, group):
    got = substring_dedup.remove_repeats(docs, length=length, group=group).collect()
    same([(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in got], removed(rows, length))


def test_substrings_of_periods(spark):
    made = [(1, "ab" * 400, None), (2, "x" * 199 + "y" * 250, None), (3, "abc" * 66 + "ab", None), (4, "q" + "abc" * 67, None), (5, "z" * 199, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = substring_dedup.remove_repeats(df).collect()
    same([(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in got], removed(made, 200))


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    starts = lambda posts: [k for low, high, *_ in zip(*posts, strict=True) for k in range(low, high + 1)]
    monkeypatch.setattr(substring_dedup, "BATCH", 700)
    (whole, _, again), settled = substring_dedup.sample([text, b"short", text], 200)
    assert sorted(starts(whole)) == sorted(starts(again)) == list(range(4801)) and not any(len(x[0]) for x in settled)
    monkeypatch.setattr(substring_dedup, "BATCH", 1_000_000)
    (whole, _, again), settled = substring_dedup.sample([text, b"short", text], 200)
    assert sorted(starts(whole)) == list(range(4801)) and set(whole[5]) == {2} and not len(again[0])
    assert [list(zip(*x, strict=True)) for x in settled] == [[], [], [(0, 5000)]]


def test_periodic_text_posts_little():
    for text in (b"a" * 1_600_000, b"ab" * 800_000, bytes(range(97, 120)) * 70_000):
        (post,), _ = substring_dedup.sample([text], 200)
        assert len(post[0]) < 200


@pytest.mark.parametrize("letters", [2, 4])
def test_refinement(letters):
    # groups of contexts with common parts at changing places
    rng = np.random.default_rng(letters)
    parts = [bytes(rng.integers(97, 97 + letters, 60, dtype=np.uint8)) for _ in range(4)]
    contexts = [b"".join(parts[k] for k in rng.integers(0, 4, 3)) + bytes(rng.integers(97, 97 + letters, 5, dtype=np.uint8)) for _ in range(60)] + [b"z" * 150, b"z" * 90]
    groups = np.sort(rng.integers(1, 6, len(contexts)))
    got = substring_dedup.refine(contexts, groups, 80).tolist()
    begin = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    every = [(int(begin[i]) + k, (g, c[k : k + 80])) for i, (c, g) in enumerate(zip(contexts, groups.tolist(), strict=True)) for k in range(len(c) - 79)]
    n = Counter(s for _, s in every)
    assert got == [at for at, s in every if n[s] > 1] and got


# --- lines ------------------------------------------------------------------------------------------------------------


def cut_lines(data):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = lambda i, t: (i is not None, i if i is not None else 0)
    unique = {(i, t) for i, t, _ in data}
    chunks, first = {}, {}
    for i, t in unique:
        lines = (t or "").split("\n")
        h = [md5(x) for x in lines]
        ends = [k + 1 for k in range(len(lines)) if md5((h[k - 1] if k else "") + h[k])[0] in "0123"]
        ends = list(dict.fromkeys([*ends, len(lines)]))
        chunks[i, t] = list(zip([0, *ends], ends, strict=False))
    for (i, t), own in chunks.items():
        lines = (t or "").split("\n")
        for s, e in own:
            if e - s >= 2:
                p = "\n".join(lines[s:e])
                first[p] = min(first.get(p, (order(i, t), s)), (order(i, t), s))
    out = []
    for i, t, _ in data:
        lines = (t or "").split("\n")
        gone = [(s, e) for s, e in chunks[i, t] if e - s >= 2 and (order(i, t), s) > first["\n".join(lines[s:e])]]
        kept = [x for k, x in enumerate(lines) if not any(s <= k < e for s, e in gone)]
        out.append((i, t if not gone else "\n".join(kept), 0 if t is None else len(lines), sum(e - s for s, e in gone)))
    return out


def test_lines(docs, rows):
    got = line_dedup.remove_repeated_chunks(docs, carry=("source",))
    want = cut_lines(rows)
    same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], want)
    assert sum(x[-1] for x in want) > 20


def cut_passages(data, over=50):
    """All runs of lines of more than ``over`` words, by brute force."""
    order = lambda i, t: (i is not None, i if i is not None else 0)
    first, runs = {}, defaultdict(list)
    for i, t in {(i, t) for i, t, _ in data}:
        lines = (t or "").split("\n")
        if len(lines) > 200 or len(words(t)) <= over:
            continue
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                p = "\n".join(lines[a:b])
                if len(words(p)) > over and words(lines[a]) and words(lines[b - 1]):
                    runs[i, t].append((a, b, p))
                    first[p] = min(first.get(p, (order(i, t), t or "", a)), (order(i, t), t or "", a))
    out = []
    for i, t, _ in data:
        # of a run that overlaps its own first occurrence, only what lies behind that goes
        begin = lambda a, b, p: max(a, first[p][2] + b - a) if first[p][:2] == (order(i, t), t or "") else a  # noqa: B023, E731
        gone = {k for a, b, p in runs[i, t] if (order(i, t), t or "", a) > first[p] for k in range(begin(a, b, p), b)}
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)))
    return out


def test_passages(docs, rows):
    got = line_dedup.remove_repeated_passages(docs, carry=("source",)).collect()
    same([(r.doc_id, r.text, r.n_removed) for r in got], cut_passages(rows))
    assert all(sum(x.n for x in r.removed) == r.n_removed for r in got)


def test_planted_passages_go_whole(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    data, want = [], []
    for n in (1, 2, 3, 4, 5):
        passage = [line(f"p{n}x{k}w", 60 // n + 1) for k in range(n)]
        for copy in range(3):
            i = 10 * n + copy
            above, below = [line(f"a{i}w", 4), line(f"b{i}w", 30)], [line(f"c{i}w", 20)]
            data.append((i, "\n".join([*above, *passage, *below])))
            want.append((i, "\n".join([*above, *(passage if not copy else []), *below]), n if copy else 0))
    # fifty words are too few; a passage that overlaps its own repetition stays once
    data += [(100, line("s", 50)), (101, line("s", 50)), (102, "\n".join([line("q", 10)] * 20))]
    want += [(100, line("s", 50), 0), (101, line("s", 50), 0), (102, "\n".join([line("q", 10)] * 6), 14)]
    got = line_dedup.remove_repeated_passages(spark.createDataFrame(data, "doc_id long, text string"))
    same([(r.doc_id, r.text, r.n_removed) for r in got.collect()], want)


# --- vectors ----------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), rng.normal(size=40).astype(np.float32).tolist()) for i in range(900)]
    vectors += [(1000, vectors[5][1]), (1001, vectors[5][1]), (1002, None), (1003, [1.0, None] * 20), (1100, [float("nan")] * 40), (1200, [0.0] * 40), (1201, [float("inf")] * 40), (1300, [1.0] * 10), (None, [1.0] * 40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    good = {i: np.floor(1024 * np.array(v, np.float64)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    good = {i: np.pad(v, (0, 40 - len(v))) for i, v in good.items()}
    want = []
    for q in good:
        if q % 100 == 0:
            best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (4096, 3):
        same([(r.query_id, r.rank, r.vec_id, r.score) for r in vector_topk.top_k(df, query_block=block).collect()], want)
    assert vector_topk.top_k(df.limit(0)).count() == 0
    few = vector_topk.top_k(df.filter("vec_id in (100, 101, 102)")).collect()
    assert len(few) == 2


def test_batches_of_words_take_bounded_memory():
    """A large batch is counted, and cut into shingles, some texts at a time, with the same results."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 150)) for _ in range(8000)] + ["", "one", " "]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["text"])
    data, at = hashing.buffers(batch.column("text"))
    found = []
    tracemalloc.start()
    for work in (lambda: list(brown_lm._pre_aggregated(iter([batch]), lambda t: brown_lm._with_ends(*brown_lm._hashed(t), 0)[1:])), lambda: hashing.shingle_sets(data, at, 5)):
        tracemalloc.reset_peak()
        got, held = work(), tracemalloc.get_traced_memory()
        found.append((got, (held[1]) / len(data)))
    tracemalloc.stop()
    ((keys, n),), (tokens, ends) = found[0][0], found[1][0]
    assert n.sum() == sum(len(t.split()) + 1 for t in texts) and len(keys) == len({w for t in texts for w in t.split()}) + 1
    whole = hashing._shingle_sets(data, at, 5)
    assert (tokens == whole[0]).all() and (ends == whole[1]).all()
    print([share for _, share in found])
    assert found[0][1] < 4 and found[1][1] < 8


@pytest.mark.parametrize("last", ["b", "longer", "longer" + " " * 40, "x" * 70, "x" * 200])
def test_words_across_parts(last, monkeypatch):
    """Words hash alike wherever the ends of parts fall, in the last word and in blanks after it too."""
    monkeypatch.setattr(hashing, "_PART", 64)
    for n in range(60, 70):
        text = ("ab cde " * 20)[: n - 3] + " " + last
        data = np.frombuffer(text.encode(), np.uint8)
        got, first = hashing.word_hashes(data, np.array([0, len(data)]))
        alone = [hashing.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in text.split()]
        assert got.tolist() == alone and first.tolist() == [0, len(alone)]


def test_frequencies_of_a_range_take_bounded_memory():
    """A range's tokens are counted a part at a time: sums over all blocks as by brute force, in a small multiple of what comes in."""
    rng = np.random.default_rng(3)
    blocks = [np.unique(rng.integers(0, 1_500_000, 40_000)) * 90_001 for _ in range(40)] + [np.array([5 << 32]), np.array([7])]
    rows, want = [], Counter()
    for i, b in enumerate(blocks):
        n = rng.integers(1, 4, len(b)).astype(np.uint32)
        rows.append((0, i, b.astype(np.uint32).tobytes(), np.bincount(b >> 32, minlength=1).astype(np.uint32).tobytes(), n.tobytes()))
        want.update(dict(zip(b.tolist(), n.tolist(), strict=True)))
    names = ["range", "block", "low", "high", "n"]
    group = pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], names=names)
    tracemalloc.start()
    got = jaccard_join.frequencies(group)
    peak = tracemalloc.get_traced_memory()[1] / group.nbytes
    tracemalloc.stop()
    assert got["block"].to_pylist() == list(range(len(blocks))) and set(got["range"].to_pylist()) == {0}
    for b, df in zip(blocks, got["df"].to_pylist(), strict=True):
        assert np.frombuffer(df, np.uint32).tolist() == [want[t] for t in b.tolist()]
    assert peak < 3


def test_near_duplicates_in_many_blocks(docs, rows, monkeypatch):
    """The same classes when tasks have several blocks and ranges are counted in many parts."""
    for name, value in (("BLOCK", 2000), ("TASK", 9000), ("AT_ONCE", 64)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()]
    same(got, closure(rows)[0])
