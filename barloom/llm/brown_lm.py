"""Language-model scores from Brown's class-based bigrams.

A word's probability is that of its class after the previous word's class, times that of the word in its class:
p(w | v) = p(class(w) | class(v)) * p(w | class(w)), both smoothed by adding a constant. Classes come from the exchange
algorithm: the ``vocabulary`` most frequent words are taken one by one out of their class and put where the class log
likelihood of all bigrams is greatest, against the counts as they are then, until no move gains. Every other word that
training has at least ``least_count`` times goes, by its own counts of classes before and after it over the whole corpus,
to the class that gives these neighbours the greatest likelihood: its exchange gain to first order, as its counts are small
beside a class's. Words too rare for that share one more class, in which each keeps its own count. The end of a text is a
token with a class of its own, which also precedes its first word. The number of classes grows with the vocabulary.

Words are 64-bit hashes. No table of all words is ever broadcast or collected: documents are dealt into blocks of about
``BLOCK`` bytes; each block's distinct words fetch counts and classes by a join and meet their texts again in one cogroup,
which leaves each text as a sequence of classes. Transitions are counted over these, and scores read from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import col, discard, store

#: Bytes in a block of documents, and rows that a task holds before it passes them on.
BLOCK, FLUSH = 24_000_000, 1_000_000
#: Hash of the end token.
END = 0


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of a column of texts as signed hashes other than END, and the number of each text's first, with the end."""
    words, first = hashing.word_hashes(*hashing.buffers(texts))
    return np.where(words == END, np.uint64(1), words).view(np.int64), first


def _with_ends(words: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The words, one ``end`` before all and one after each text."""
    out = np.full(len(words) + len(first), end, words.dtype)
    out[np.arange(len(words)) + np.repeat(np.arange(1, len(first)), np.diff(first))] = words
    return out


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(sums), minlength=len(key)).astype(np.int64)


def _pre_aggregated(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Keys of each batch of texts, counted over as many batches as leave FLUSH keys."""
    keys, sums, held = [], [], 0
    for b in chain.from_iterable(map(hashing.slices, batches)):
        key, n = np.unique(keys_of(b.column("text")), return_counts=True)
        keys.append(key)
        sums.append(n)
        held += len(key)
        if held > FLUSH:
            key, n = _summed(keys, sums)
            keys, sums, held = [key], [n], len(key)
            if held > FLUSH // 2:
                yield key, n
                keys, sums, held = [], [], 0
    if keys:
        yield _summed(keys, sums)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``n`` over the column ``text``: words, and one end token for each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _pre_aggregated(batches, lambda t: _with_ends(*_hashed(t), END)[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(words: np.ndarray, ids: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    """``values`` of the words that are among the ascending ``ids``, ``other`` for the rest."""
    if not len(ids):
        return np.full(len(words), other, np.int64)
    at = np.minimum(np.searchsorted(ids, words), len(ids) - 1)
    return np.where(ids[at] == words, values[at], other)


def head_bigrams(texts: DataFrame, head: np.ndarray) -> DataFrame:
    """``a``, ``b``, ``n``: how often word number b follows a. Numbers are places in the ascending ``head``; the rest is len(head), the end len(head) + 1."""
    rare, end = len(head), len(head) + 1
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def pairs(t: pa.Array) -> np.ndarray:
        words, first = _hashed(t)
        code = _with_ends(_numbers(words, shared.value, np.arange(rare), rare), first, end)
        return code[:-1] * (end + 1) + code[1:]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _pre_aggregated(batches, pairs):
            yield pa.RecordBatch.from_arrays([pa.array((key // (end + 1)).astype(np.int32)), pa.array((key % (end + 1)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    return texts.select("text").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


class Exchange:
    """Exchange clustering of ``n_words`` words into ``n_classes``; further word numbers have classes of their own, which stay.

    ``joint[i, j]`` counts bigrams of a word of class i and one of class j.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, n_words: int, n_classes: int, fixed: int = 2):
        self.n_words, self.n_classes, total = n_words, n_classes, n_words + fixed
        self.classes = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(fixed)])
        n = n.astype(np.float64)
        apart = a != b
        self.own = np.bincount(a[~apart], weights=n[~apart], minlength=total)
        a, b, n = a[apart], b[apart], n[apart]
        self.right, self.left = self._lists(a, b, n, total), self._lists(b, a, n, total)
        size = n_classes + fixed
        self.joint = np.bincount(self.classes[a] * size + self.classes[b], weights=n, minlength=size * size).reshape(size, size)
        self.joint += np.diag(np.bincount(self.classes, weights=self.own, minlength=size))

    @staticmethod
    def _lists(of: np.ndarray, other: np.ndarray, n: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        order = np.argsort(of, kind="stable")
        return other[order], n[order], np.searchsorted(of[order], np.arange(total + 1)).tolist()

    def _neighbours(self, lists: tuple, w: int) -> np.ndarray:
        other, n, at = lists
        return np.bincount(self.classes[other[at[w] : at[w + 1]]], weights=n[at[w] : at[w + 1]], minlength=len(self.joint))

    def likelihood(self) -> float:
        return float(_xlogx(self.joint).sum() - _xlogx(self.joint.sum(axis=0)).sum() - _xlogx(self.joint.sum(axis=1)).sum())

    def _put(self, k: int, r: np.ndarray, l: np.ndarray, own: float, sign: int) -> None:  # noqa: E741
        self.joint[k] += sign * r
        self.joint[:, k] += sign * l
        self.joint[k, k] += sign * own

    def gains(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the likelihood gains where each class takes the word, which is in none; and its neighbours' classes."""
        r, l, own = self._neighbours(self.right, w), self._neighbours(self.left, w), self.own[w]  # noqa: E741
        self._put(self.classes[w], r, l, own, -1)
        j, c = self.joint, np.arange(self.n_classes)
        row = (_xlogx(j[c] + r) - _xlogx(j[c])).sum(axis=1)
        column = (_xlogx(j[:, c] + l[:, None]) - _xlogx(j[:, c])).sum(axis=0)
        at = j[c, c]
        corner = _xlogx(at + r[c] + l[c] + own) - _xlogx(at + r[c]) - _xlogx(at + l[c]) + _xlogx(at)
        # rows of what stands before the word, and columns of what stands after it, keep their sums wherever it goes
        b, a = j.sum(axis=1)[c] + l[c], j.sum(axis=0)[c] + r[c]
        sums = _xlogx(b + r.sum() + own) - _xlogx(b) + _xlogx(a + l.sum() + own) - _xlogx(a)
        return row + column + corner - sums, r, l

    def sweep(self) -> int:
        """Offers every word to all classes, one after the other; how many moved."""
        moved = 0
        for w in range(self.n_words):
            gain, r, l = self.gains(w)  # noqa: E741
            k = int(gain.argmax())
            if gain[k] > gain[self.classes[w]] + 1e-6:
                self.classes[w] = k
                moved += 1
            self._put(self.classes[w], r, l, self.own[w], 1)
        return moved


def exchange_classes(bigrams: DataFrame, n_words: int, n_classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word number, and counts of adjacent classes; sweeps end where no word moves, at ``sweeps`` at the latest.

    One task holds the bigrams of the head, at most (n_words + 2)**2 numbers whatever the corpus.
    """

    def cluster(rows: pa.Table) -> pa.Table:
        e = Exchange(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["n"].to_numpy(), n_words, n_classes)
        for _ in range(sweeps):
            if not e.sweep():
                break
        return pa.table([pa.array([e.classes.astype(np.int32)], pa.list_(pa.int32())), pa.array([e.joint.ravel()], pa.list_(pa.float64()))], names=["classes", "joint"])

    size = n_classes + 2
    found = bigrams.groupBy().applyInArrow(cluster, "classes array<int>, joint array<double>").toArrow()
    if not len(found):
        return np.concatenate([np.arange(n_words) % n_classes, [n_classes, n_classes + 1]]), np.zeros((size, size))
    return found["classes"][0].values.to_numpy().astype(np.int64), found["joint"][0].values.to_numpy().reshape(size, size)


def tail_classes(texts: DataFrame, head: np.ndarray, classes: np.ndarray, joint: np.ndarray, least_count: int) -> DataFrame:
    """``word``, ``c`` for each word outside ``head`` that stands ``least_count`` times or more.

    Every task sends one row for a word it has: how often which class stands before and after it. Rows meet by word; a word
    has at most one from every FLUSH of a task.
    """
    size = len(joint)
    rare, end = size - 2, size - 1
    smooth = joint + 0.1
    # log likelihood of a class after, and before, each class that could take the word
    after = np.log(smooth[:rare] / smooth[:rare].sum(axis=1, keepdims=True))
    before = np.log(smooth[:, :rare] / smooth[:, :rare].sum(axis=0, keepdims=True)).T
    table = np.concatenate([after, before], axis=1).T
    shared = texts.sparkSession.sparkContext.broadcast((head, classes[: len(head)], table))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, class_of, _ = shared.value
        words, slots, held = [], [], 0

        def flush() -> pa.RecordBatch:
            w, s = np.concatenate(words), np.concatenate(slots)
            order = np.lexsort((s, w))
            w, s = w[order], s[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(w)))
            w, s = w[at], s[at]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else at
            packed = ((s.astype(np.uint64) << np.uint64(20)) | np.minimum(n, (1 << 20) - 1).astype(np.uint64)).astype(np.uint32)
            ends = np.append(first, len(w)).astype(np.int32) * 4
            return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(packed)])], names=["word", "slots"])

        for b in chain.from_iterable(map(hashing.slices, batches)):
            w, first = _hashed(b.column("text"))
            code = _with_ends(_numbers(w, ids, class_of, rare), first, end)
            tail = np.flatnonzero(code == rare)
            word = _with_ends(w, first, END)[tail]
            words += [word, word]
            slots += [code[tail + 1].astype(np.int16), (size + code[tail - 1]).astype(np.int16)]
            held += 2 * len(word)
            if held > 2 * FLUSH:
                yield flush()
                words, slots, held = [], [], 0
        if held:
            yield flush()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, by_class = shared.value
        kept: pa.Table | None = None

        def settle(rows: pa.Table) -> pa.RecordBatch:
            w = rows["word"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            data, at = hashing.buffers(rows["slots"])
            packed = np.frombuffer(data.tobytes(), np.uint32)
            number = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w)))), np.diff(at) // 4)
            slot, n = (packed >> np.uint32(20)).astype(np.int64), (packed & np.uint32((1 << 20) - 1)).astype(np.float64)
            total = np.bincount(number, weights=n, minlength=len(first)) / 2
            out = np.zeros(len(first), np.int32)
            for s in range(0, len(first), 2000):
                i, j = np.searchsorted(number, [s, s + 2000])
                rows_of = min(2000, len(first) - s)
                m = np.bincount((number[i:j] - s) * (2 * size) + slot[i:j], weights=n[i:j], minlength=rows_of * 2 * size).reshape(rows_of, 2 * size)
                out[s : s + rows_of] = (m @ by_class).argmax(axis=1)
            much = total >= least_count
            return pa.RecordBatch.from_arrays([pa.array(w[first][much]), pa.array(out[much])], names=["word", "c"])

        for b in batches:
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])]).combine_chunks()
            w = rows["word"].to_numpy()
            cut = int(np.searchsorted(w, w[-1])) if len(w) else 0
            if cut:
                yield settle(rows.slice(0, cut).combine_chunks())
            kept = rows.slice(cut)
        if kept is not None and len(kept):
            yield settle(kept.combine_chunks())

    sent = texts.select("text").mapInArrow(neighbours, "word long, slots binary")
    return sent.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word long, c int")


def class_vocabulary(learn: DataFrame, counts: DataFrame, v_train: int, vocabulary: int, n_classes: int, sweeps: int, least_count: int) -> DataFrame:
    """``word``, ``n``, ``c`` for every training word: the last class but one is that of words too rare, the last that of the end."""
    spark = learn.sparkSession
    top = counts.filter(F.col("word") != END).orderBy(F.desc("n"), "word").limit(vocabulary).select("word").toArrow()["word"].to_numpy()
    head = np.sort(top)
    bigrams = store(head_bigrams(learn, head), "bigrams")
    classes, joint = exchange_classes(bigrams, len(head), n_classes, sweeps)
    discard(bigrams)
    of_head = F.broadcast(spark.createDataFrame([(int(w), int(c)) for w, c in zip(head, classes, strict=False)], "word long, head_c int"))
    found = tail_classes(learn, head, classes, joint, least_count).withColumnRenamed("c", "tail_c")
    named = counts.join(of_head, "word", "left").join(found, "word", "left")
    return store(named.select("word", "n", F.when(F.col("word") == END, n_classes + 1).otherwise(F.coalesce("head_c", "tail_c", F.lit(n_classes))).alias("c")), "classes")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 2048, n_classes: int | None = None, sweeps: int = 12, least_count: int = 4, smoothing: float = 0.1) -> DataFrame:
    """Score every text under a class bigram model and a word unigram model of the rows for which ``train`` holds.

    Returns ``doc_id``, ``is_train``, ``n_tokens``, ``n_known`` (tokens that training has), ``train_tokens``,
    ``base_score`` (unigram log10 probability, add-0.1), ``score`` (the class model's) and ``perplexity`` (10 to
    -score / n_tokens); one row per input row, repeated ones included. A null text is empty: its end token alone. Without
    training rows all tokens are unknown. Ties among the most frequent words go by the hash. Other columns are not read.
    ``vocabulary`` words are exchanged one by one, all others of ``least_count`` are placed by their neighbours;
    ``n_classes`` is by default the cube root of the number of distinct words, 16 to 256.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("is_train"), col(text_col).cast("string").cast("binary").alias("text"))
    learn = rows.filter("is_train").select("text")
    counts = store(word_counts(learn), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = int(totals["n"]), int(totals["v"])
    n_classes = n_classes or min(256, max(16, round(v_train ** (1 / 3))))
    known = class_vocabulary(learn, counts, v_train, vocabulary, n_classes, sweeps, least_count)
    discard(counts)
    rare, end, k = n_classes, n_classes + 1, n_classes + 2
    sums = {r["c"]: (r["n"], r["v"]) for r in known.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    in_class = np.array([sums.get(c, (0, 0)) for c in range(k)], np.float64)
    # one more word than seen stands for all unseen ones of the class
    emission_total = np.log10(in_class[:, 0] + smoothing * (in_class[:, 1] + 1))
    base_total = float(np.log10(n_train + 0.1 * (v_train + 1)))
    end_count = int(sums.get(end, (0, 0))[0])

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words of a block may come several times: the cogroup takes the union
        seen: dict[int, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in seen.items():
                w = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block, np.int32)), pa.array(w)], names=["block", "word"])

        for b in chain.from_iterable(map(hashing.slices, batches)):
            blocks = b.column("block").to_numpy()
            words, first = _hashed(b.column("text"))
            of = np.repeat(blocks, np.diff(first))
            for block in np.unique(blocks).tolist():
                own = np.unique(words[of == block])
                seen.setdefault(block, []).append(own)
                held += len(own)
            if held > 3 * FLUSH:
                merged = {block: [np.unique(np.concatenate(parts))] for block, parts in seen.items()}
                seen, held = merged, sum(len(p[0]) for p in merged.values())
                if held > 2 * FLUSH:
                    yield from flush()
                    seen, held = {}, 0
        yield from flush()

    wanted = dealt.select("block", "text").mapInArrow(distinct, "block int, word long")
    found = wanted.join(known, "word").select("block", "word", "n", "c")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def code(texts: pa.Table, vocab: pa.Table) -> pa.Table:
        order = np.argsort(vocab["word"].to_numpy(), kind="stable")
        ids, n, c = (vocab[x].to_numpy()[order] for x in ("word", "n", "c"))
        # one more place for a word that training lacks, and one for the end
        n, c = np.concatenate([n, [0, end_count]]), np.concatenate([c, [rare, end]])
        base = np.log10(n + 0.1) - base_total
        emit = np.log10(n + smoothing) - emission_total[c]
        out = []
        for s in range(0, len(texts), hashing.ROWS_AT_ONCE):
            words, first = _hashed(texts["text"].slice(s, hashing.ROWS_AT_ONCE))
            place = _numbers(words, ids, np.arange(len(ids)), len(ids))
            at = _with_ends(place, first, len(n) - 1)[1:]
            begin = first[:-1] + np.arange(len(first) - 1)
            sums_of = lambda x: np.add.reduceat(x, begin) if len(begin) else np.zeros(0)
            cls = c[at].astype(np.uint16)
            ends = (np.append(begin, len(at)) * 2).astype(np.int32)
            classes = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(cls)])
            out.append(pa.table([pa.array(np.diff(np.append(begin, len(at))), pa.int64()), pa.array(sums_of((n[at] > 0).astype(np.int64)), pa.int64()), pa.array(sums_of(base[at]), pa.float64()), pa.array(sums_of(emit[at]), pa.float64()), classes], names=["n_tokens", "n_known", "base_score", "emission", "classes"]))
        if not out:
            return pa.table([texts["doc_id"], texts["is_train"], *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))], names=names)
        coded = pa.concat_tables(out)
        return pa.table([texts["doc_id"], texts["is_train"], *coded.columns], names=names)

    names = ["doc_id", "is_train", "n_tokens", "n_known", "base_score", "emission", "classes"]
    coded = store(dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(code, f"doc_id {kind}, is_train boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"), "coded")
    discard(known)

    def sequence(classes: pa.Array) -> np.ndarray:
        return np.frombuffer(hashing.buffers(classes)[0].tobytes(), np.uint16).astype(np.int64)

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            c = np.append(end, sequence(b.column("classes")))  # every text ends with the class that precedes the next one
            total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    seen = coded.filter("is_train").select("classes").mapInArrow(transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros(k * k)
    joint[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    joint = joint.reshape(k, k)
    shared = spark.sparkContext.broadcast(np.log10((joint + smoothing) / (joint.sum(axis=1, keepdims=True) + smoothing * k)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            if not len(n):
                continue
            c = np.append(end, sequence(b.column("classes")))
            sums = np.add.reduceat(shared.value[c[:-1], c[1:]], np.cumsum(n) - n) + b.column("emission").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "is_train", "n_tokens", "n_known", "base_score")), pa.array(sums)], names=["doc_id", "is_train", "n_tokens", "n_known", "base_score", "score"])

    scored = coded.mapInArrow(score, f"doc_id {kind}, is_train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "is_train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
