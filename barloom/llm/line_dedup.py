"""Removal of repeated passages of several lines, in content-defined chunks.

Lines are hashed, and a rolling hash over each line's and its predecessor's hash decides, by its first hexadecimal digit,
whether a chunk ends after the line. So boundaries depend on the text near them alone and fall alike in all copies of a
passage, whatever stands before it. A chunk of two lines or more whose hash occurs again is compared byte by byte, and
every equal occurrence but the first is removed. remove_repeated_passages() takes whole passages by their words instead,
wherever chunks end. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, row_keys

#: Fixed value: first digits of the rolling hash after which a chunk ends (one line in four on average).
CUTS = "0123"
#: Lines that make a passage.
LEAST = 2


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``lines``, ``chunks``: array of (start, n) over the lines, in order."""
    text = col(text_col).cast("string")
    rows = docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    hashed = rows.withColumn("hashes", F.transform("lines", F.md5))
    before = F.concat(F.array(F.lit("")), F.col("hashes"))
    rolling = F.zip_with(F.slice(before, F.lit(1), F.size("hashes")), F.col("hashes"), lambda p, h: F.substring(F.md5(F.concat(p, h)), 1, 1).isin(*CUTS))
    # the places after which a chunk ends; the last line always ends one
    ends = F.filter(F.transform(rolling, lambda cut, i: F.when(cut, i + 1)), lambda e: e.isNotNull())
    cut = hashed.withColumn("ends", F.array_distinct(F.concat(ends, F.array(F.size("hashes"))))).drop("hashes")
    starts = F.concat(F.array(F.lit(0)), F.col("ends"))
    chunks = F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), F.col("ends"), lambda s, e: F.struct(s.alias("start"), (e - s).alias("n")))
    return cut.select("doc_id", "k1", "k2", "lines", chunks.alias("chunks"))


def _text_of(chunk: Column) -> Column:
    return F.array_join(F.slice("lines", chunk["start"] + 1, chunk["n"]), "\n")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text``, ``n_lines``, ``n_removed`` (lines), ``removed`` (array of start line and number of lines), ``carry``.

    Of each chunk of two lines or more, the occurrence in the least id (then at the first line) stays, the others go; a
    text whose lines all go becomes empty. One row per input row. Rows equal in id and text count as one document and
    get the same result. A null text stays null, with 0 lines; an empty text has one empty line, which never goes. A null
    id comes before all others. An empty table gives no rows. Of the other
    columns only those named in ``carry`` are read and passed on.

    Only hashes of chunks are shuffled to find repeats; texts of chunks only where the hash occurs again.
    """
    cut = chunked(docs, id_col, text_col)
    several = F.filter("chunks", lambda c: c["n"] >= LEAST)
    placed = cut.select("k1", "k2", "lines", "chunks", F.explode(several).alias("chunk")).select("k1", "k2", F.col("chunk.start").alias("start"), F.col("chunk.n").alias("n"), F.xxhash64(_text_of(F.col("chunk"))).alias("hash"))
    repeated = placed.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("hash")
    asked = placed.join(repeated, "hash").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "hash")).alias("asked"))
    # one exchange of the texts by row serves both joins
    text = col(text_col).cast("string")
    whole = docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), text.alias("text"), *map(col, carry))
    met = whole.select("doc_id", "k1", "k2", "text").join(asked, ["k1", "k2"]).select("doc_id", "k1", "k2", "asked", F.split("text", "\n", -1).alias("lines"))
    passages = met.select("doc_id", "k1", "k2", "lines", F.explode("asked").alias("chunk")).select("doc_id", "k1", "k2", "chunk.start", "chunk.n", "chunk.hash", _text_of(F.col("chunk")).alias("passage"))
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "k1", "k2", "start")
    # grouping by the passage itself is the comparison of bytes
    first = passages.groupBy("hash", "passage").agg(F.min(order).alias("first"))
    gone = passages.join(first, ["hash", "passage"]).filter(order > F.col("first")).select("k1", "k2", "start", "n").distinct()
    by_doc = gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("removed"))
    whole = whole.join(by_doc, ["k1", "k2"], "left")
    none = F.array().cast("array<struct<start:int,n:int>>")
    own = ["doc_id", "text", *carry]
    lines = whole.select(*own, F.coalesce("removed", none).alias("removed"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    kept = _without("lines", "removed")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return lines.select("doc_id", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), n_lines.alias("n_lines"), F.aggregate("removed", F.lit(0), lambda n, r: n + r["n"]).cast("long").alias("n_removed"), "removed", *map(col, carry))


def _without(lines: str, removed: str) -> Column:
    """The lines outside the removed stretches: what lies between one stretch's end and the next one's start."""
    ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["start"] + r["n"]))
    starts = F.concat(F.transform(removed, lambda r: r["start"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(lines, e + 1, s - e)))


def _windows(counts: str, over: int) -> Column:
    """For each place the least number of entries from there on that have more than ``over`` words together; 0 where too few are left. Every entry has a word."""
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    add = lambda s, w: F.when(s["words"] > over, s).otherwise(F.struct((s["words"] + w).alias("words"), (s["n"] + 1).alias("n")))
    end = lambda s: F.when(s["words"] > over, s["n"]).otherwise(0)
    # by place: slice() would copy the whole array for every line
    return F.transform(F.col(counts), lambda _, i: F.aggregate(F.sequence(i, F.least(i + over, F.size(counts) - 1)), none, lambda s, k: add(s, F.get(counts, k)), end))


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), over: int = 50) -> DataFrame:
    """Remove every run of lines of more than ``over`` words that stands earlier already: columns as of remove_repeated_chunks().

    A run begins and ends with a line that has a word. The windows tried are, from each such line on, the shortest that
    has more than ``over`` words, and, back from each, the shortest. A repeated run is covered by its own windows of both
    kinds, each of which is repeated with it, so whole runs go: one long line, heads, tails and what lies between. A
    window's first occurrence (least id, then first line) stays, also where a later one in the same document overlaps it.
    Windows are compared by SHA-256 of their text. Null and repeated rows as in remove_repeated_chunks().
    """
    text = col(text_col).cast("string")
    split = lambda t: F.split(F.coalesce(t, F.lit("")), "\n", -1)
    rows = docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), split(text).alias("lines"))
    # places and word counts of lines with a word; each array is read twice below, so Spark doesn't compute it anew per line
    counted = rows.withColumn("counts", F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))))
    full = counted.withColumn("at", F.filter(F.transform("counts", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())).withColumn("counts", F.filter("counts", lambda n: n > 0))
    both = full.filter(F.aggregate("counts", F.lit(0), lambda s, n: s + n) > over).withColumn("back", F.reverse("counts"))
    sized = both.withColumn("ahead", _windows("counts", over)).withColumn("behind", F.reverse(_windows("back", over)))
    # start and number of lines in one long: array_distinct() compares structs pair by pair, longs by a hash set
    place = lambda a, b: F.get("at", a).cast("long") * (1 << 31) + F.get("at", b) - F.get("at", a) + 1
    forth = F.transform("ahead", lambda n, i: F.when(n > 0, place(i, i + n - 1)))
    back = F.transform("behind", lambda n, i: F.when(n > 0, place(i - n + 1, i)))
    tried = sized.withColumn("windows", F.array_distinct(F.filter(F.concat(forth, back), lambda w: w.isNotNull())))
    passage = lambda a, n: F.array_join(F.transform(F.sequence(a, a + n - 1), lambda k: F.get("lines", k)), "\n")
    start, size = lambda w: F.shiftright(w, 31).cast("int"), lambda w: w.bitwiseAND((1 << 31) - 1).cast("int")
    hashed = F.transform("windows", lambda w: F.struct(start(w).alias("start"), size(w).alias("n"), F.unhex(F.sha2(passage(start(w), size(w)), 256)).alias("digest")))
    # without the lines, which would be copied for every window; of inline() Spark infers a filter that computes all arrays anew per place
    placed = tried.select("doc_id", "k1", "k2", hashed.alias("hashed")).select("doc_id", "k1", "k2", F.inline_outer("hashed")).filter("digest is not null")
    order = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "k1", "k2", "start")
    first = placed.groupBy("digest").agg(F.min(order).alias("first"), F.min(order) != F.max(order)).toDF("digest", "first", "again").filter("again").drop("again")
    later = placed.join(first, "digest").filter(order > F.col("first"))
    own = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    begin = F.when(own, F.greatest("start", F.col("first.start") + F.col("n"))).otherwise(F.col("start"))
    cuts = later.select("k1", "k2", begin.alias("begin"), (F.col("start") + F.col("n")).alias("end")).filter("begin < end").distinct()
    by_doc = cuts.groupBy("k1", "k2").agg(F.collect_list(F.sequence("begin", F.col("end") - 1)).alias("cuts")).select("k1", "k2", F.array_sort(F.array_distinct(F.flatten("cuts"))).alias("gone"))
    whole = docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), text.alias("text"), *map(col, carry)).join(by_doc, ["k1", "k2"], "left")
    read = whole.select("doc_id", "text", *map(col, carry), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), split(F.col("text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    after = F.transform("gone", lambda i: i + 1)
    runs = F.zip_with(F.array_except("gone", after), F.array_except(after, F.col("gone")), lambda s, e: F.struct(s.alias("start"), (e - s).alias("n")))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return read.select("doc_id", kept.alias("text"), n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), runs.alias("removed"), *map(col, carry))
