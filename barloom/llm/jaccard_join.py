"""Near-duplicate classes by an exact Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``WIDTH`` words. Tokens are ordered by document frequency (then by hash),
rarest first. If two sets reach the threshold, the first |x| - ceil(t |x|) + l tokens of both share at least l tokens, for
any l. Each document chooses its own l: a longer prefix scans more postings but, as more matches are asked for, verifies
fewer candidates; the l of least estimated cost wins, and a pair has to share as many prefix tokens as the smaller of its
two l. Only then are the sets compared in full.

Frequencies cover all documents without a row for each token: documents are dealt into blocks; each block sends its token
hashes, packed, to reducers by hash range, and they send the exact frequencies back packed alike. They are counted by the
upper 48 bits of a token; tokens alike in those only share a place in the order. Tokens of frequency 1 can't match and are
never posted.

Copies collapse first (equal sets are one node). Then, instead of all pairs of a posting list, its members are compared to
one centre: at first the one with the fewest tokens that stand nowhere else; linked ones become a component, and the next
rounds compare only across components. A member that can reach the threshold with no member of another component, by the
tokens that the list's place leaves open and the least size there, leaves the list. What is left after ``ROUNDS`` rounds is
compared in full, in cells of bounded size, so no link between components is lost, and pairs within one are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import col, discard, row_keys, store

WIDTH = 5
#: Bytes of text in a block, and for each task and each range of hashes; tokens that a range counts at once.
BLOCK, TASK, AT_ONCE = 4_000_000, 16_000_000, 1 << 18
#: Rounds of comparisons to centres, the longest extension of a prefix, and members of a cell.
ROUNDS, LONGEST, CELL = 3, 4, 256
#: Bits in which a set's tokens leave their parity, by hash: two sets differ in at least as many tokens as they do in bits.
PARITY = 512
#: Cost of verifying one token of a set, where scanning one posting costs 1.
VERIFY = 0.02


def prefix_length(size: np.ndarray | int, match: int, percent: int) -> np.ndarray | int:
    return size - (percent * size + 99) // 100 + match


def choose_prefix(df: np.ndarray, percent: int) -> tuple[int, int]:
    """Matches asked for, and the prefix length for them; ``df`` are the set's frequencies in token order."""
    n = len(df)
    others = np.cumsum(df.astype(np.int64) - 1)
    best = None
    for match in range(1, LONGEST + 1):
        length = min(n, prefix_length(n, match, percent))
        if match > 1 and length < prefix_length(n, match, percent):
            break
        scanned = float(others[length - 1])
        cost = scanned + scanned / match * VERIFY * n
        if best is None or cost < best[0]:
            best = cost, match, length
    return best[1], best[2]


class Block:
    """The sets of a block's texts: ``tokens`` ascending within each, ``at`` where they begin, ``ids`` that name them, ``firsts`` the rows that are the first with their set."""

    def __init__(self, texts: pa.ChunkedArray):
        self.tokens, self.at = hashing.shingle_sets(*hashing.buffers(texts), WIDTH)
        self.ids = [xxhash.xxh3_128_digest(self.of(i)) for i in range(len(self.at) - 1)]
        seen: dict[bytes, int] = {}
        for i, (s, size) in enumerate(zip(self.ids, np.diff(self.at).tolist(), strict=True)):
            if size:
                seen.setdefault(s, i)
        self.firsts = sorted(seen.values())

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.at[i] : self.at[i + 1]]

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Upper 48 bits of the first sets' tokens, ascending, and how many sets have each."""
        return np.unique(np.concatenate([self.of(i) for i in self.firsts] or [self.tokens[:0]]) >> np.uint64(16), return_counts=True)


def frequencies(group: pa.Table) -> pa.Table:
    """For every row of a range (``low``, ``high``: ascending tokens of a block; ``n``: how many sets have each) the sums over all rows."""
    low, at = hashing.buffers(group["low"])
    low, n = low.view(np.uint32), hashing.buffers(group["n"])[0].view(np.uint32)
    high, high_at = hashing.buffers(group["high"])
    high = high.view(np.uint32)
    # where each row's tokens with each value of the upper bits begin: a few of these values are counted at a time
    begins = [np.concatenate([[0], np.cumsum(high[i:j], dtype=np.int64)]) + first for i, j, first in zip(high_at[:-1] // 4, high_at[1:] // 4, at[:-1] // 4, strict=True)]
    width = max(map(len, begins)) - 1
    df = np.zeros(len(low), np.uint32)
    edges = np.unique(np.linspace(0, width, 2 + len(low) // AT_ONCE).astype(np.int64)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = [x[a : b + 1] for x in begins if len(x) > a + 1]
        upper = np.concatenate([np.repeat(np.arange(len(x) - 1, dtype=np.int64), np.diff(x)) for x in own])
        of = lambda values: np.concatenate([values[x[0] : x[-1]] for x in own])  # noqa: B023, E731
        _, which = np.unique((upper << 32) | of(low), return_inverse=True)
        found = np.bincount(which, weights=of(n)).astype(np.uint32)[which]
        done = 0
        for x in own:
            df[x[0] : x[-1]] = found[done : done + x[-1] - x[0]]
            done += x[-1] - x[0]
    replies = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(df)])
    return pa.table([group["block"], group["range"], replies], names=["block", "range", "df"])


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per document: ``doc_id``, ``k1``, ``k2``, ``set_id``, ``n``; for the first of a set in its block that has prefix tokens
    of frequency 2 or more also ``match``, ``prefix`` (those tokens in order), ``shared`` (how many of the set's tokens have
    frequency 2 or more), ``parity`` (PARITY bits) and ``tokens`` (the whole set, packed)."""
    rows = docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), col(text_col).cast("string").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_tasks = max(1, -(-size // BLOCK)), max(1, -(-size // TASK))
    ranges = min(n_tasks, 1 << 16)
    # a task has several blocks, and holds what is made of one at a time
    dealt = rows.withColumn("block", F.pmod("k1", F.lit(n_blocks)).cast("int")).repartition(n_tasks, "block")
    edges = np.array([(1 << 48) * r // ranges for r in range(ranges + 1)], np.uint64)

    def pack(block: pa.Table) -> pa.Table:
        bucket, n = Block(block["text"]).buckets()
        cuts = np.searchsorted(bucket, edges)
        out = []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            b = bucket[cuts[r] : cuts[r + 1]] - edges[r]
            high = np.bincount((b >> np.uint64(32)).astype(np.int64), minlength=1).astype(np.uint32)
            out.append((r, b.astype(np.uint32).tobytes(), high.tobytes(), n[cuts[r] : cuts[r + 1]].astype(np.uint32).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        number = block["block"][0].as_py() if len(block) else 0
        return pa.table([pa.array(cols[0], pa.int32()), pa.array([number] * len(out), pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["range", "block", "low", "high", "n"])

    def prefixes(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(texts["text"])
        bucket, _ = block.buckets()
        df = np.frombuffer(b"".join(r for _, r in sorted(zip(replies["range"].to_pylist(), replies["df"].to_pylist(), strict=True))), np.uint32)
        match, prefix, common, parity, tokens = ([None] * len(block.ids) for _ in range(5))
        for i in block.firsts:
            s = block.of(i)
            f = df[np.searchsorted(bucket, s >> np.uint64(16))]
            n_shared = int((f > 1).sum())
            # tokens of frequency 1 come first: none of the prefix is shared where they fill it
            if n_shared <= len(s) - min(len(s), prefix_length(len(s), LONGEST, percent)):
                continue
            order = np.lexsort((s, f))
            m, length = choose_prefix(f[order], percent)
            shared = order[:length][f[order[:length]] > 1]
            if len(shared) >= m:
                match[i], prefix[i], common[i], tokens[i] = m, s[shared].view(np.int64), n_shared, s.tobytes()
                odd = np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                parity[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
        return pa.table([texts["doc_id"], texts["k1"], texts["k2"], pa.array(block.ids, pa.binary()), pa.array(np.diff(block.at), pa.int64()), pa.array(match, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(common, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(tokens, pa.binary())], names=["doc_id", "k1", "k2", "set_id", "n", "match", "prefix", "shared", "parity", "tokens"])

    packed = dealt.groupBy("block").applyInArrow(pack, "range int, block int, low binary, high binary, n binary")
    replies = packed.groupBy("range").applyInArrow(frequencies, "block int, range int, df binary")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return store(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(prefixes, f"doc_id {kind}, k1 long, k2 long, set_id binary, n long, match int, prefix array<long>, shared long, parity array<long>, tokens binary"), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that share enough prefix tokens and then reach the threshold."""
    a = nodes.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("match").alias("m_a"), F.col("prefix").alias("p_a"))
    b = nodes.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("match").alias("m_b"), F.col("prefix").alias("p_b"))
    fit = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.size(F.array_intersect("p_a", "p_b")) >= F.least("m_a", "m_b"))
    likely = pairs.join(a, "a").join(b, "b").filter(fit).select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            (a, at_a), (b, at_b) = hashing.buffers(batch.column("t_a")), hashing.buffers(batch.column("t_b"))
            for i in range(batch.num_rows):
                x, y = a[at_a[i] : at_a[i + 1]].view(np.uint64), b[at_b[i] : at_b[i + 1]].view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    t = nodes.select("set_id", "tokens")
    with_sets = likely.join(t.select(F.col("set_id").alias("a"), F.col("tokens").alias("t_a")), "a").join(t.select(F.col("set_id").alias("b"), F.col("tokens").alias("t_b")), "b")
    return with_sets.select("a", "b", "t_a", "t_b").mapInArrow(verify, "a binary, b binary")


def _may_link(n: Column, other_n: Column, before: Column, other_before: Column, after: Column, other_after: Column, percent: int) -> Column:
    """Whether two sets can reach the threshold that meet at a token with so many shared tokens before and after it.

    At most the lesser number of tokens before, and of those after, can be common too.
    """
    most = F.least(before, other_before) + 1 + F.least(after, other_after)
    return (100 + percent) * most >= percent * (n + other_n)


def _worth(percent: int) -> Column:
    """Whether a posting and another one ``o`` of its token lie in different classes, may link, and don't share the token before.

    A pair that shares the token before has met there already.
    """
    met = F.coalesce(F.col("previous") == F.col("o.previous"), F.lit(False))
    return (F.col("label") != F.col("o.label")) & _may_link(F.col("n"), F.col("o.n"), F.col("before"), F.col("o.before"), F.col("after"), F.col("o.after"), percent) & ~met


def _open(posted: DataFrame, percent: int) -> DataFrame:
    """The postings that may link with another one of their list in a different class; lists of one class go."""
    most = lambda c: F.max(c).alias(f"most_{c}")
    classes = posted.groupBy("token", "label").agg(F.min("n").alias("n"), F.max("before").alias("before"), F.max("after").alias("after"))
    # the least size in the list, the class that has it, and the least size in any other class
    lists = classes.groupBy("token").agg(F.min(F.struct("n", "label")).alias("least"), F.count(F.lit(1)).alias("n_classes"), most("before"), most("after")).filter("n_classes > 1")
    second = classes.join(lists.select("token", "least"), "token").filter(F.col("label") != F.col("least.label")).groupBy("token").agg(F.min("n").alias("second"))
    bounds = lists.join(second, "token")
    # whichever is greater: the least size of another class, or what the threshold asks of a partner's size
    partner = F.greatest(F.when(F.col("label") == F.col("least.label"), F.col("second")).otherwise(F.col("least.n")), F.floor((percent * F.col("n") + 99) / 100))
    may = _may_link(F.col("n"), partner, F.col("before"), F.col("most_before"), F.col("after"), F.col("most_after"), percent)
    return posted.join(bounds, "token").filter(may).select(posted.columns)


def _all_pairs(posted: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link across classes, of every list, in cells of about CELL by CELL members."""
    sizes = posted.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("token", F.ceil(F.col("members") / CELL).cast("int").alias("parts"))
    dealt = posted.join(sizes, "token").join(nodes.select("set_id", "parity"), "set_id").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    side = F.struct("label", "set_id", "n", "previous", "before", "after", "parity")
    left = dealt.withColumn("with", F.explode(F.sequence("part", F.col("parts") - 1)))
    right = dealt.select(F.col("token").alias("o_token"), side.alias("o"), F.col("part").alias("o_with"), F.explode(F.sequence(F.lit(0), "part")).alias("o_part"))
    once = (F.col("part") < F.col("with")) | (F.col("set_id") < F.col("o.set_id"))
    # parities bound the tokens in common too
    differ = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("o.parity", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    both = F.col("n") + F.col("o.n")
    near = (100 + percent) * (both - differ) >= 2 * percent * both
    found = left.join(right, (left["token"] == right["o_token"]) & (left["part"] == right["o_part"]) & (left["with"] == right["o_with"]) & once & _worth(percent) & near)
    return found.select(F.least("set_id", "o.set_id").alias("a"), F.greatest("set_id", "o.set_id").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node that edges (a, b) connect to it, for the nodes of any edge.

    Each pass hands every node the least label around it and then follows labels of labels, so chains shorten by half.
    """
    both = store(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = store(lower.join(jump, F.col("next") == F.col("via"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "was"), "labels")
        done = moved.filter("label <> was").isEmpty()
        discard(labels)
        labels = moved.select("node", "label")
        labels.barloom_path = moved.barloom_path
        if done:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (row_keys()), ``n_shingles``, ``component_id``, ``label`` (of the class): the classes of documents that links connect.

    Two documents link when 100 * |x and y| >= percent * |x or y|, over distinct 5-word shingles; ``component_id`` is the
    least id of the class. One row per input row: repeated rows and ids are nodes of equal sets. A null, empty or blank
    text has no shingle, links with nothing and is its own class; an empty table gives no rows. Ties don't matter: the
    result is the exact set of links' closure. Texts of any length are read whole; other columns are not read.
    """
    stored = shingle_sets(docs, id_col, text_col, percent)
    sets = store(stored.select("doc_id", "k1", "k2", "set_id", "n"), "ids")
    nodes = store(stored.filter("tokens is not null").drop("doc_id", "k1", "k2").dropDuplicates(["set_id"]), "nodes")
    discard(stored)
    # a posting knows what its token leaves open: tokens of frequency 2 or more before and after it, and the one before
    at = nodes.select("set_id", "n", "shared", "prefix", F.posexplode("prefix").alias("before", "token"))
    postings = at.select("set_id", "n", "token", F.when(F.col("before") > 0, F.get("prefix", F.col("before") - 1)).alias("previous"), "before", (F.col("shared") - F.col("before") - 1).alias("after"))
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("lists")).filter("lists > 1").select("token")
    postings = store(postings.join(common, "token"), "postings")
    tested: list[DataFrame] = []
    labels = None
    for r in range(ROUNDS + 1):
        if labels is None:
            posted = postings.withColumn("label", F.col("set_id"))
        else:
            posted = postings.join(labels, F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "set_id")).drop("node")
            posted = store(_open(posted, percent), "postings")
            discard(postings)
            postings = posted.drop("label")
            postings.barloom_path = posted.barloom_path
        side = F.struct("label", "set_id", "n", "previous", "before", "after")
        if r == ROUNDS:
            found = _all_pairs(posted, nodes, percent)
        else:
            if r == 0:
                # the member with the fewest tokens of its own: what the others are edited copies of, if that is among them
                own = F.col("n") - F.col("before") - F.col("after")
                others = posted.groupBy("token").agg(F.min_by(side, F.struct(own, "n", "set_id")).alias("o"))
            else:
                # then any member of a list's largest class, another one in each list: who links with it at all soon meets one
                by_label = posted.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.min_by(side, F.xxhash64("set_id", "token", F.lit(r))).alias("o"))
                others = by_label.groupBy("token").agg(F.max_by("o", F.struct("c", "label")).alias("o"))
            found = posted.join(others, (posted["token"] == others["token"]) & _worth(percent)).select(F.least("set_id", "o.set_id").alias("a"), F.greatest("set_id", "o.set_id").alias("b"))
        pairs = found.distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = store(pairs, "pairs")
        linked = store(_verified(pairs, nodes, percent), "linked")
        tested.append(pairs)
        # what was connected before is one star for each class
        edges = linked if labels is None else linked.unionByName(labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        before, labels = labels, components(edges)
        discard(linked, *([before] if before is not None else []))
    discard(postings, nodes, *tested)
    found = labels.select(F.col("node").alias("set_id"), "label")
    classes = sets.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "set_id").join(found, "set_id", "left").select("doc_id", "k1", "k2", "n_shingles", F.coalesce("label", "set_id").alias("label"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = classes.filter("n_shingles > 0").join(least, "label")
    return full.unionByName(classes.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs``, columns as they are, that are the first of their class: least id, then least hashes.

    Rows without shingles all stay; of rows equal in id and text that have shingles, one stays.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    first = found.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("one")).select(F.col("one.k1").alias("one_1"), F.col("one.k2").alias("one_2"))
    bare = found.filter("n_shingles = 0").select(F.col("k1").alias("one_1"), F.col("k2").alias("one_2")).distinct()
    k1, k2 = row_keys(id_col, text_col)
    keyed = docs.select("*", k1.alias("row_1"), k2.alias("row_2"))
    stay = keyed.join(first, (F.col("row_1") == F.col("one_1")) & (F.col("row_2") == F.col("one_2")), "left_semi").dropDuplicates(["row_1", "row_2"])
    also = keyed.join(bare, (F.col("row_1") == F.col("one_1")) & (F.col("row_2") == F.col("one_2")), "left_semi")
    return stay.unionByName(also).drop("row_1", "row_2")
