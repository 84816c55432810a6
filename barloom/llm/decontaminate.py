"""Benchmark decontamination over a distributed positional inverted index.

The index stores, for each rare term of the benchmark, the documents and positions where it stands. Every window of an
item is looked up by its two rarest terms: their posting lists are shifted by the terms' places in the item and
intersected, which leaves the alignments (document, item, shift) at which both stand in the right distance. Alignments
are then compared word by word for exact phrases; lists that meet within a slop are proximity matches. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, col, discard, row_keys, store

WINDOW = 13
#: Characters between words: ASCII other than letters and digits. Lower-case text is split here.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark terms that may be broadcast (about 20 MB); beyond that, joins shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP, -1), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def worded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (hashes that name the row; equal for rows equal in id and text), ``words``."""
    text = col(text_col).cast("string")
    return docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), words(text).alias("words"))


def windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``item`` (a hash that names the item's words), ``words``, ``start``, ``len``, ``terms``: one row per window."""
    items = benchmark.select(col(id_col).alias("item_id"), words(col(text_col)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("item_id", "words")).withColumn("len", F.least(F.lit(WINDOW), F.size("words")))
    starts = items.select("item_id", "item", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("start"))
    return starts.select("item_id", "item", "words", "start", "len", F.slice("words", F.col("start") + 1, F.col("len")).alias("terms")).dropDuplicates(["item_id", "item", "start"])


def build_index(corpus: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings ``term``, ``k1``, ``k2``, ``positions`` of the given terms; ``corpus`` has k1, k2 and words."""
    tokens = corpus.select("k1", "k2", F.posexplode("words").alias("pos", "term"))
    return tokens.join(_small(terms.select("term"), n_terms), "term").groupBy("k1", "k2", "term").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def rarest(wins: DataFrame, frequency: DataFrame) -> DataFrame:
    """The windows all of whose terms the corpus has, with ``anchors``: (term, place in the item) of the two rarest terms."""
    placed = wins.select("item_id", "item", "start", "len", F.posexplode("terms").alias("i", "term"))
    known = placed.join(frequency, "term", "left").groupBy("item_id", "item", "start", "len").agg(
        F.count("n").alias("found"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "term"))).alias("by_rarity"),
    )
    anchor = F.transform(F.slice("by_rarity", 1, 2), lambda t: F.struct(t["term"].alias("term"), (t["i"] + F.col("start")).alias("at")))
    return known.filter(F.col("found") == F.col("len")).select("item_id", "item", "start", "len", anchor.alias("anchors"))


def alignments(index: DataFrame, anchored: DataFrame, n_rows: int) -> DataFrame:
    """``k1``, ``k2``, ``item_id``, ``item``, ``shift``, ``at``: anchors found, as places in the item, by where the item would begin."""
    anchors = anchored.select("item_id", "item", F.explode("anchors").alias("a")).select("item_id", "item", "a.term", "a.at").distinct()
    hits = index.join(_small(anchors, n_rows), "term")
    return hits.select("k1", "k2", "item_id", "item", F.explode("positions").alias("pos"), "at").withColumn("shift", F.col("pos") - F.col("at")).groupBy("k1", "k2", "item_id", "item", "shift").agg(F.collect_set("at").alias("at"))


class Matcher:
    """Looks benchmark items up in a corpus. ``corpus`` and the index are stored tables; close() deletes them."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"):
        self.corpus = store(worded(docs, id_col, text_col), "corpus")
        self.windows = store(windows(benchmark, item_col, item_text_col), "windows")
        terms = store(self.windows.select(F.explode("terms").alias("term")).distinct(), "terms")
        n_terms = terms.count()
        tokens = self.corpus.select(F.explode("words").alias("term")).join(_small(terms, n_terms), "term")
        self.frequency = store(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequency")
        self.anchored = store(rarest(self.windows, self.frequency), "anchored")
        anchor_terms = store(self.anchored.select(F.explode("anchors.term").alias("term")).distinct(), "anchor_terms")
        self.n_windows = self.anchored.count()
        self.index = store(build_index(self.corpus, anchor_terms, n_terms), "index")
        self.aligned = alignments(self.index, self.anchored, 2 * self.n_windows)
        discard(terms, anchor_terms)
        self.stored = [self.corpus, self.windows, self.frequency, self.anchored, self.index]

    def close(self) -> None:
        discard(*self.stored)

    def phrases(self) -> DataFrame:
        """``k1``, ``k2``, ``item_id``, ``start`` (word of the document), ``len``: every occurrence of every window, once for each equal row."""
        by_item = self.anchored.groupBy("item_id", "item").agg(F.collect_list(F.struct("start", "len", F.col("anchors.at").alias("at"))).alias("windows"))
        items = self.windows.select("item_id", "item", F.col("words").alias("item_words")).dropDuplicates(["item_id", "item"]).join(by_item, self._same_item(by_item)).select(self.windows["item_id"], self.windows["item"], "item_words", "windows")
        a = self.aligned
        met = a.join(_small(items, self.n_windows), a["item_id"].eqNullSafe(items["item_id"]) & (a["item"] == items["item"])).select("k1", "k2", a["item_id"], "shift", "item_words", F.filter("windows", lambda w: F.size(F.array_except(w["at"], F.col("at"))) == 0).alias("windows")).filter(F.size("windows") > 0)
        met = store(met, "met")
        self.stored.append(met)
        n_docs = met.select("k1", "k2").distinct().count()
        texts = self.corpus.select("k1", "k2", "words")
        if n_docs <= BROADCAST_ROWS:
            # keys of documents that are met: only their words are shuffled
            texts = texts.join(F.broadcast(met.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
        placed = texts.join(met, ["k1", "k2"])
        same = F.filter("windows", lambda w: (F.col("shift") + w["start"] >= 0) & (F.slice("words", F.greatest(F.col("shift") + w["start"], F.lit(0)) + 1, w["len"]) == F.slice("item_words", w["start"] + 1, w["len"])))
        return placed.select("k1", "k2", "item_id", "shift", F.explode(same).alias("w")).select("k1", "k2", "item_id", (F.col("shift") + F.col("w.start")).alias("start"), F.col("w.len").alias("len"))

    def _same_item(self, other: DataFrame) -> Column:
        return self.windows["item_id"].eqNullSafe(other["item_id"]) & (self.windows["item"] == other["item"])

    def near(self, slop: int = 4) -> DataFrame:
        """``k1``, ``k2``, ``item_id``: documents in which a window's two rarest terms stand within ``slop`` words of their distance."""
        # two shifts at most slop apart share a cell of that width, or their neighbouring cells do
        cell = F.floor(F.col("shift") / F.lit(slop + 1))
        spread = self.aligned.select("k1", "k2", "item_id", "item", "shift", F.explode("at").alias("at"))
        spread = spread.select("*", F.explode(F.array(cell, cell + 1)).alias("cell"))
        pairs = self.anchored.filter(F.size("anchors") == 2).select("item_id", "item", F.col("anchors")[0]["at"].alias("at_1"), F.col("anchors")[1]["at"].alias("at_2")).distinct()
        grouped = spread.groupBy("k1", "k2", "item_id", "item", "cell").agg(F.collect_set(F.struct("at", "shift")).alias("seen"))
        met = grouped.join(pairs, grouped["item_id"].eqNullSafe(pairs["item_id"]) & (grouped["item"] == pairs["item"]))
        close = F.exists("seen", lambda x: (x["at"] == F.col("at_1")) & F.exists("seen", lambda y: (y["at"] == F.col("at_2")) & (F.abs(x["shift"] - y["shift"]) <= slop)))
        return met.filter(close).select("k1", "k2", grouped["item_id"]).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (row_keys()), ``n_words``, ``n_hit``, ``item_ids``, ``contaminated``: how much of each document stands in benchmark items.

    A window is 13 consecutive words of an item, or the whole of a shorter one; a word inside any occurrence is hit;
    ``item_ids`` are the distinct ids, as sorted strings, whose windows occur. ``contaminated``: n_hit > 0 and
    share * n_hit >= n_words. One row per input row; rows equal in id and text share their result. Null and empty texts
    have no words; empty and null items, no windows; items without id are found but not listed. Either table may be
    empty. Texts are read whole; other columns are not read.
    """
    found = Matcher(docs, benchmark, id_col, text_col, item_col, item_text_col)
    hits = store(found.phrases(), "hits")
    before = Window.partitionBy("k1", "k2").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("k1", "k2", "start", "len").distinct().withColumn("end", F.col("start") + F.col("len")).withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))).cast("long").alias("n_hit"))
    items = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    rows = found.corpus.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"))
    out = rows.join(n_hit, ["k1", "k2"], "left").join(items, ["k1", "k2"], "left")
    out = out.select("doc_id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **of_contamination) -> DataFrame:
    """The rows of ``docs``, columns as they are, that contamination() doesn't call contaminated."""
    bad = contamination(docs, benchmark, id_col, text_col, **of_contamination).filter("contaminated").select(F.col("k1").alias("bad_1"), F.col("k2").alias("bad_2")).distinct()
    k1, k2 = row_keys(id_col, text_col)
    return docs.join(bad, (k1 == F.col("bad_1")) & (k2 == F.col("bad_2")), "left_anti")
