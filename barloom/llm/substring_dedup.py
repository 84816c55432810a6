"""Removal of long repeated byte strings by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Suffixes are sampled at content
defined anchors: the first of the smallest q-gram identifiers in each window of ``length - Q + 1`` q-grams. Any repeated
string has its anchor at the same offset in all its places, so only suffixes in equal q-gram buckets need refining. An
anchor stands for the strings that have it as their anchor, [low, high]; anchors whose whole stretch has equal identifiers
(with the bucket's, 128 bits) are one class, and a class of two or more members is repeated throughout. Members of a class
inside one batch of texts are settled there, so that copies and periodic texts post one anchor for many.

In a bucket with several classes one member of each is refined, however many the class has: its positions are put into
buckets by q-gram, and buckets of two or more are split by sorting on the bucket identifiers of later offsets: depth 2 Q by
those Q bytes later, 4 Q by those of 2 Q, ``length`` by those of what is missing; each level sorts only what still ties, and
serves the next as identifier of the position itself and of the later one. What ties at the end is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import col, discard, row_keys, store

#: Bytes of the initial buckets.
Q = 32
#: Bytes of texts that are sampled or refined at once.
BATCH = 1_000_000
#: Rows of anchors (about 20 MB) that may be broadcast.
BROADCAST_ROWS = 200_000
_SEED = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = hashing.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _SEED)


def grams(data: np.ndarray, depths: tuple[int, ...]) -> list[np.ndarray]:
    """Identifiers of data[i : i + d] for all i where that exists, for each depth d; at most 2**20 bytes."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[data] * hashing._POWERS[: len(data)], dtype=np.uint64)])
    return [hashing.mix((sums[d:] - sums[:-d]) * hashing._INVERSES[: max(len(data) - d + 1, 0)]) if len(data) >= d else sums[:0] for d in depths]


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of x[i : i + width] for each i, by the upper 40 bits; x has at most 2**24 values.

    The place is put into the lower bits, and the minimum is that of a suffix and a prefix of blocks of the width.
    """
    n = len(x) - width + 1
    keyed = (x & ~np.uint64(0xFFFFFF)) | np.arange(len(x), dtype=np.uint64)
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([keyed, pad]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Text number, low, high, place, bucket and stretch identifier of each anchor; none in texts shorter than ``length``.

    The texts are taken together; strings that cross an end are left out.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    bucket, whole = grams(data, (Q, length))
    at = sliding_argmin(bucket, length - Q + 1)
    # starts whose string stays inside its text
    inside = np.ones(len(at), bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none, none
    at, whole = at[starts], whole[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    place, low, high = at[first], starts[first], starts[last]
    # the stretch is settled by its strings in order and where the anchor lies
    turned = hashing.mix(whole * _SEED + np.uint64(7))
    between = np.add.reduceat(turned, first)
    stretch = hashing.mix(hashing.mix(whole[first] * _SEED + whole[last]) + between * _SEED + (place - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (high - low).astype(np.uint64))
    text = np.searchsorted(ends, low, side="right")
    base = (ends - sizes)[text]
    return text, low - base, high - base, place - base, bucket[place].view(np.int64), stretch.view(np.int64)


def _cuts(numbers: np.ndarray, n: int) -> list[int]:
    return np.searchsorted(numbers, np.arange(n + 1)).tolist()


def sample(texts: list[bytes], length: int) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[np.ndarray, ...]]]:
    """For each text its posts (low, high, place, bucket, stretch, members) and spans (start, end) that are settled.

    Texts go in batches of bounded size, very long ones in pieces that take over the last length - 1 bytes of the one
    before, so each string lies in exactly one. Of a class with several members in a batch the first is posted.
    """
    posts: list[list[tuple]] = [[] for _ in texts]
    spans: list[list[tuple]] = [[] for _ in texts]
    batch: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal batch, held
        number, low, high, place, bucket, stretch = anchors([p for *_, p in batch], length)
        _, one, same, n = np.unique(hashing.mix(bucket.view(np.uint64) * _SEED + stretch.view(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
        posted = np.zeros(len(low), bool)
        posted[one] = True
        # the others are repeated; spans of one text that touch are one
        start, end, owner = low[~posted], high[~posted] + length, number[~posted]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (start[1:] > end[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(fresh)
        start, end, owner = start[begin], end[np.append(begin[1:], len(end)) - 1] if len(begin) else end, owner[begin]
        members = n[same]
        number, low, high, place, bucket, stretch, members = (x[posted] for x in (number, low, high, place, bucket, stretch, members))
        at, settled = _cuts(number, len(batch)), _cuts(owner, len(batch))
        for k, (i, shift, _) in enumerate(batch):
            s, e = at[k], at[k + 1]
            if e > s:
                posts[i].append((low[s:e] + shift, high[s:e] + shift, place[s:e] + shift, bucket[s:e], stretch[s:e], members[s:e]))
            s, e = settled[k], settled[k + 1]
            if e > s:
                spans[i].append((start[s:e] + shift, end[s:e] + shift))
        batch, held = [], 0

    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), BATCH - length + 1):
            part = t[s : s + BATCH]
            if held + len(part) > BATCH and batch:
                flush()
            batch.append((i, s, part))
            held += len(part)
    if batch:
        flush()
    join = lambda parts, width: tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else tuple(np.zeros(0, np.int64) for _ in range(width))
    return [join(p, 6) for p in posts], [join(s, 2) for s in spans]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows of the keys, each below 2**32."""
    return np.unique((keys[0].astype(np.uint64) << np.uint64(32)) | keys[1].astype(np.uint64), return_inverse=True)[1]


def _tied(ranks: np.ndarray) -> np.ndarray:
    return np.bincount(ranks)[ranks] > 1


def refine(contexts: list[bytes], groups: np.ndarray, length: int) -> np.ndarray:
    """Places in the joined contexts where a string of ``length`` bytes begins that begins again in the same group; at most BATCH bytes, or one context."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    group = np.repeat(groups, sizes)
    # initial buckets: the group and the q-gram
    gram = np.unique(grams(data, (Q,))[0], return_inverse=True)[1]
    q = np.full(len(data), -1, np.int64)
    q[: len(gram)] = gram
    starts = np.concatenate([np.arange(e - n, e - length + 1) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    own = _ranks(group[starts], q[starts])
    starts = starts[_tied(own)]
    bucket, depth = q, Q
    while depth < length and len(starts):
        step = min(depth, length - depth)
        # positions whose next identifier the following levels ask for: those tied, and all later offsets from them
        asked, reach = starts, depth + step
        while reach < length:
            more = min(reach, length - reach)
            asked, reach = np.union1d(asked, asked + more), reach + more
        ids = _ranks(bucket[asked], bucket[asked + step])
        bucket = np.full(len(data), -1, np.int64)
        bucket[asked] = ids
        depth += step
        own = _ranks(group[starts], bucket[starts])
        starts = starts[_tied(own)]
    if not len(starts):
        return starts
    # what ties is compared byte by byte with the first of its bucket; runs of starts that follow each other at once
    own = _ranks(group[starts], bucket[starts])
    order = np.argsort(own, kind="stable")
    lead = np.zeros(own.max() + 1, np.int64)
    lead[own[order[::-1]]] = order[::-1]
    partner = starts[lead[own]]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] != starts[:-1] + 1) | (partner[1:] != partner[:-1] + 1)
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(starts))) + length - 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if np.array_equal(data[np.repeat(starts[begin], n) + at], data[np.repeat(partner[begin], n) + at]):
        return starts
    # two different strings shared an identifier: by their bytes then
    whole = data.tobytes()
    _, exact = np.unique(np.array([(int(group[s]).to_bytes(8, "big") + whole[s : s + length]).hex() for s in starts.tolist()]), return_inverse=True)
    return starts[_tied(exact)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] != starts[:-1] + 1
    begin = np.flatnonzero(fresh)
    return starts[begin], starts[np.append(begin[1:], len(starts)) - 1] if len(begin) else starts


_SPAN_ROWS = "k1 long, k2 long, start int, end int"


def refined_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the single members whose strings begin again in their bucket; rows come sorted by bucket."""
    held: list[pa.Table] = []
    size = 0

    def settle(rows: pa.Table) -> pa.RecordBatch:
        texts = rows["bytes"].to_pylist()
        bucket = rows["bucket"].to_numpy()
        new = np.ones(len(texts), np.int64)
        new[1:] = bucket[1:] != bucket[:-1]
        group = np.cumsum(new)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = refine(texts, group, length)
        # a context's last string begins ``length`` bytes before the next context, so runs stay inside one
        first, last = _runs(found)
        row = np.searchsorted(begin, first, side="right") - 1
        want = rows["single"].to_numpy()[row]
        shift = rows["low"].to_numpy()[row] - begin[row]
        start, end = first + shift, last + shift + length
        row = pa.array(row[want])
        return pa.RecordBatch.from_arrays([rows["k1"].combine_chunks().take(row), rows["k2"].combine_chunks().take(row), pa.array(start[want].astype(np.int32)), pa.array(end[want].astype(np.int32))], names=["k1", "k2", "start", "end"])

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        size += b.nbytes
        if size < BATCH // 4:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        # all but the last bucket are complete
        bucket = rows["bucket"].to_numpy()
        rest = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
        if rest:
            yield from _pieces(rows.slice(0, rest), settle)
        held, size = [rows.slice(rest)], rows.slice(rest).nbytes
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        if len(rows):
            yield from _pieces(rows, settle)


def _pieces(rows: pa.Table, settle) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Whole buckets of up to about half of BATCH bytes at once."""
    size = np.cumsum(np.array([len(t) for t in rows["bytes"].to_pylist()], np.int64))
    bucket = rows["bucket"].to_numpy()
    edges = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(rows))
    begin = 0
    while begin < len(rows):
        done = size[begin - 1] if begin else 0
        fit = edges[(edges > begin) & (size[edges - 1] - done <= BATCH // 2)]
        end = int(fit[-1]) if len(fit) else int(edges[edges > begin][0])
        yield settle(rows.slice(begin, end - begin).combine_chunks())
        begin = end


def _contexts(texts: DataFrame, asked: DataFrame, length: int, small: bool = False) -> DataFrame:
    """The rows of ``asked`` (few enough to broadcast, if ``small``) with ``bytes``: all that the strings of the anchor cover.

    Equal rows have equal contexts: one of them is enough.
    """
    fields = ["low", "high", "place", "bucket", "single"]
    by_doc = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    context = F.transform("asked", lambda a: F.struct(*(a[f].alias(f) for f in fields), F.substring(F.col("text"), a["low"] + 1, a["high"] - a["low"] + length).alias("bytes")))
    return texts.join(F.broadcast(by_doc) if small else by_doc, ["k1", "k2"]).select("k1", "k2", "doc_id", F.explode(context).alias("c")).select("k1", "k2", "doc_id", "c.*").dropDuplicates(["k1", "k2", "low"])


_CELL_ROWS = "k1 long, k2 long, low int, high int, place int, bucket long, single boolean, a int, b int, core long, whole long"
#: Widths of the intervals of offsets in which large buckets are refined, one after the other.
WIDTHS = (64, 16, 4, 1)


def cells(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Identifiers for each interval of a context's offsets: those [a, b] of its strings from the anchor back to their starts.

    ``core`` names the bytes that all strings with offsets in the interval have in common, ``whole`` those of all its own.
    """
    far = length - Q
    for batch in batches:
        texts = batch.column("bytes").to_pylist()
        for s in range(0, len(texts), 1000):
            part = batch.slice(s, 1000)
            begin = np.concatenate([[0], np.cumsum([len(t) for t in texts[s : s + 1000]])])
            data = np.frombuffer(b"".join(texts[s : s + 1000]), np.uint8)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[data] * hashing._POWERS[: len(data)], dtype=np.uint64)])
            low, high, place, least, most = (part.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "place", "least", "most"))
            least, most = np.maximum(least, place - high), np.minimum(most, place - low)
            n = np.maximum(most // width - least // width + 1, 0) * (most >= least)
            row = np.repeat(np.arange(len(low)), n)
            cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (least // width)[row]
            first, last = cell * width, np.minimum(cell * width + width - 1, far)
            a, b = np.maximum(first, least[row]), np.minimum(last, most[row])
            anchor = begin[:-1][row] + (place - low)[row]
            name = lambda i, j, *with_: hashing.mix(hashing.mix((sums[j] - sums[i]) * hashing._INVERSES[i]) * _SEED + sum((x.astype(np.uint64) << np.uint64(16 * k)) for k, x in enumerate(with_)))  # noqa: E731, B023
            core = name(anchor - first, anchor + length - last, first)
            whole = name(anchor - b, anchor + length - a, a, b)
            keys = [part.column(c).take(pa.array(row)) for c in ("k1", "k2", "low", "high", "place", "bucket", "single")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))], names=[f.split()[0] for f in _CELL_ROWS.split(", ")])


def large_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (``k1``, ``k2``, ``start``, ``end``) of the single contexts whose strings begin again in their bucket.

    Nothing is gathered: contexts are counted by what they have in common. Two contexts that share a string share the core
    of each interval of offsets that it is in. So where a core stands once, nothing in the interval is repeated; where all
    of it stands twice, everything is; else one context for each different one goes on to narrower intervals, down to
    single strings. Strings are compared by 128 bits.
    """
    live = contexts.withColumn("least", F.lit(0)).withColumn("most", F.lit(length - Q))
    spans = []
    for width in WIDTHS:
        found = live.mapInArrow(lambda batches, width=width: cells(batches, width, length), _CELL_ROWS)
        kinds = found.groupBy("bucket", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "low")).alias("one"))
        cores = kinds.groupBy("bucket", "core").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1")
        met = found.join(kinds.join(cores, ["bucket", "core"]), ["bucket", "core", "whole"])
        further = (F.col("kinds") > 1) & (F.col("one") == F.struct("k1", "k2", "low"))
        told = store(met.select("k1", "k2", "low", "place", "a", "b", (F.col("single") & (F.col("n") > 1)).alias("settled"), further.alias("further")).filter("settled or further"), "cells")
        spans.append(told.filter("settled").select("k1", "k2", (F.col("place") - F.col("b")).alias("start"), (F.col("place") - F.col("a") + length).alias("end")))
        live = contexts.join(told.filter("further").select("k1", "k2", "low", F.col("a").alias("least"), F.col("b").alias("most")), ["k1", "k2", "low"])
    return reduce(DataFrame.unionByName, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs, byte offsets, end exclusive), ``kept`` (remaining bytes).

    Every byte goes that lies in a string of ``length`` bytes which starts in a second place, in any document or in the
    same one, overlaps included; strings are those of the input. One row per input row; repeated rows are repeats of
    each other. A null or empty text has no bytes, spans or remains; an empty table gives no rows. Texts are read whole,
    the longest in pieces. Other columns are not read. ``group`` (and a quarter of a million bytes) bounds the classes of
    a bucket that one task refines; larger buckets are refined by counting, see large_buckets().
    """
    raw = col(text_col).cast("string").cast("binary")
    rows = docs.select(col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.coalesce(raw, F.lit(b"")).alias("text"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        of = lambda rows, k, kind: pa.array([r[k].astype(np.int32 if kind is ints else np.int64) for r in rows], kind)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                cut = b.slice(s, 2000)
                posts, spans = sample(cut.column("text").to_pylist(), length)
                yield pa.RecordBatch.from_arrays([cut.column("k1"), cut.column("k2"), of(posts, 0, ints), of(posts, 1, ints), of(posts, 2, ints), of(posts, 3, longs), of(posts, 4, longs), of(posts, 5, ints), of(spans, 0, ints), of(spans, 1, ints)], names=["k1", "k2", "low", "high", "place", "bucket", "stretch", "members", "start", "end"])

    long_enough = rows.filter(F.octet_length("text") >= length)
    sampled = store(long_enough.select("k1", "k2", "text").mapInArrow(post, "k1 long, k2 long, low array<int>, high array<int>, place array<int>, bucket array<long>, stretch array<long>, members array<int>, start array<int>, end array<int>"), "anchors")
    flat = sampled.select("k1", "k2", F.explode(F.arrays_zip("low", "high", "place", "bucket", "stretch", "members")).alias("a")).select("k1", "k2", "a.*")
    buckets = flat.groupBy("bucket").agg(F.sum("members").alias("all"), F.min("stretch").alias("least"), F.max("stretch").alias("most")).filter("all > 1")
    shared = store(flat.join(buckets.select("bucket", (F.col("least") < F.col("most")).alias("mixed")), "bucket"), "shared")

    mixed = shared.filter("mixed")
    classes = store(mixed.groupBy("bucket", "stretch").agg(F.sum("members").alias("members"), F.min(F.struct("k1", "k2", "low", "high", "place")).alias("one")), "classes")
    many = F.count(F.lit(1)) > min(group, max(1, BATCH // (4 * length)))
    asked = classes.join(classes.groupBy("bucket").agg(many.alias("large")), "bucket").select("bucket", "large", (F.col("members") == 1).alias("single"), "one.*")
    # with the id in it, one exchange of the texts serves the last join too
    texts = rows.select("k1", "k2", "text", "doc_id")
    ordered = _contexts(texts, asked.filter("not large"), length).select("k1", "k2", "doc_id", "low", "single", "bucket", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    refined = ordered.mapInArrow(lambda batches: refined_spans(batches, length), _SPAN_ROWS)
    # few texts have strings in large buckets, or they are shuffled once more
    n_large = asked.filter("large").count()
    late = None
    if n_large:
        late = large_buckets(store(_contexts(texts, asked.filter("large"), length, n_large <= BROADCAST_ROWS), "contexts"), length)

    full = shared.filter("not mixed").unionByName(mixed.join(classes.filter("members > 1").select("bucket", "stretch"), ["bucket", "stretch"]).select(*shared.columns))
    full = full.select("k1", "k2", F.col("low").alias("start"), (F.col("high") + length).cast("int").alias("end"))
    settled = sampled.filter(F.size("start") > 0).select("k1", "k2", F.explode(F.arrays_zip("start", "end")).alias("s")).select("k1", "k2", "s.*")
    spans = full.unionByName(settled).unionByName(refined)
    spans = (spans if late is None else spans.unionByName(late)).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, found = b.column("text").to_pylist(), b.column("found")
            at = np.append(0, np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
            flat_spans = found.flatten()
            starts, ends = (flat_spans.field(k).to_numpy() for k in (0, 1))
            all_spans, kept = [], []
            for i, text in enumerate(texts):
                s, e = starts[at[i] : at[i + 1]], np.maximum.accumulate(ends[at[i] : at[i + 1]]) if at[i + 1] > at[i] else ends[:0]
                fresh = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else s
                first, last = s[fresh].tolist(), e[np.append(fresh[1:], len(s)) - 1].tolist() if len(s) else []
                edges = [0, *(x for m in zip(first, last, strict=True) for x in m), len(text)]
                kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if first else text)
                all_spans.append([{"start": a, "end": z} for a, z in zip(first, last, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "found").mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
