"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Items are dealt by hash into shards of a bounded number of documents, and each shard is packed on its own, longest item
first. Its open bins stand in order of what they have left. An item goes to the tightest bin that it fits and whose
bitmaps show neither its source nor its duplicate cluster yet; from a bin that conflicts, the search goes on to the
successor, the next tightest. If none is compatible, a new bin opens. A document longer than a bin fills whole bins of
its own, and only its remainder is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

#: Documents of a shard, on average: it bounds a task's memory, and packs as tight as much larger ones.
SHARD = 1024


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, one_per_source: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin of each item and its offset there, and the number of bins; lengths are at most ``capacity``.

    ``sources`` and ``clusters`` are codes from 0; -1 conflicts with nothing. Items of length 0 are in bin -1.
    """
    bins, offsets = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
    left: list[tuple[int, int]] = []  # residual and bin, ascending: the successor is the next tightest
    held: list[tuple[int, int]] = []  # bitmaps of each bin: sources, clusters
    for i in np.lexsort((np.arange(len(lengths)), -lengths)):
        n = int(lengths[i])
        if n == 0:
            continue
        s = 1 << int(sources[i]) if one_per_source and sources[i] >= 0 else 0
        c = 1 << int(clusters[i]) if clusters[i] >= 0 else 0
        at = bisect_left(left, (n, -1))
        while at < len(left) and (held[left[at][1]][0] & s or held[left[at][1]][1] & c):
            at += 1
        if at < len(left):
            residual, b = left.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append((0, 0))
        bins[i], offsets[i] = b, capacity - residual
        held[b] = (held[b][0] | s, held[b][1] | c)
        if residual > n:
            insort(left, (residual - n, b))
    return bins, offsets, len(held)


def best_fit_pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster", one_per_source: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``n_tokens``, ``shard``, ``bin``, ``bin_offset``: where each piece of each document goes.

    Piece numbers start at 0; all but a document's last piece fill a bin. (shard, bin) names a sequence of ``capacity``
    tokens. In a bin no duplicate cluster stands twice, and with ``one_per_source`` no source. A null source or cluster
    conflicts with nothing. A document of null, 0 or negative length has one piece of 0 tokens in bin -1. Repeated rows
    are packed each; ties in length go by a hash of the id, source and cluster, so the packing is the same on every run. An empty table gives no rows. Other columns are not read.

    Shards are dealt by hash of the id and cluster, so that hot sources and clusters spread evenly over them; only ids,
    lengths and codes are shuffled, never texts.
    """
    ident = col(id_col)
    rows = docs.select(ident.alias("doc_id"), F.greatest(F.coalesce(col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"), col(source_col).cast("string").alias("s"), col(cluster_col).cast("string").alias("c"), F.xxhash64(ident, col(length_col)).alias("h"))
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)))

    def codes(values: pa.ChunkedArray) -> np.ndarray:
        return values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def pack_shard(p: pa.Table) -> pa.Table:
        p = p.sort_by([("n", "descending"), ("h", "ascending"), ("s", "ascending"), ("c", "ascending")])
        n = p["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        bins, offsets, opened = pack(rest, codes(p["s"]), codes(p["c"]), capacity, one_per_source)
        first = opened + np.cumsum(full) - full  # whole bins are numbered after the shared ones
        pieces = np.maximum(full + (rest > 0), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = piece < full[row]
        columns = [p["doc_id"].take(row), piece.astype(np.int32), np.where(whole, capacity, rest[row]), p["shard"].take(row), np.where(whole, first[row] + piece, bins[row]), np.where(whole, 0, offsets[row])]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=["doc_id", "piece", "n_tokens", "shard", "bin", "bin_offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("shard").applyInArrow(pack_shard, f"doc_id {kind}, piece int, n_tokens long, shard long, bin long, bin_offset long")
