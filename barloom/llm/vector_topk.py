"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, ``floor(scale * x)``. Queries and candidates are packed into blocks of a bounded size, laid out
vertically (one row per dimension), and every candidate block meets every query block: by a broadcast of the query blocks
where they are small, else by a join on (query block, group of candidate blocks). A pair of blocks adds up the products one
block of dimensions at a time. After each block a candidate's remainder is at most |rest of q| * |rest of c|; candidates
whose sum so far plus that bound stays under the query's k-th best score are compacted away. Nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col

#: Rows of a candidate block, and dimensions added up between two prunings.
CANDIDATES, DIMENSIONS = 4096, 16


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id``, ``v`` (array<long>); without null, empty-of-meaning (null or non-finite component) and id-less rows."""
    v = col(vec_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(col(id_col).cast("long").alias("vec_id"), v.alias("x"), odd.alias("odd")).filter("vec_id is not null and x is not null and not odd")
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def _best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


Best = list[tuple[np.ndarray, np.ndarray]]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, best: Best) -> None:
    """Bring ``best``, the best ``k`` candidates of each query so far, up to date by a block; ``q`` and ``c`` have one row per dimension."""
    width = min(len(q), len(c))  # the shorter vector is taken to go on with zeros
    edges = list(range(0, width, DIMENSIONS)) + [width]
    rest = lambda m: [np.sqrt((m[e:] ** 2).sum(axis=0)) for e in edges]
    q_rest, c_rest = rest(q[:width]), rest(c[:width])
    first = q[: edges[1]].T @ c[: edges[1]] if width else np.zeros((len(q_ids), len(ids)))
    for j, query in enumerate(q_ids):
        at = np.flatnonzero(ids != query)
        s = first[j, at]
        floor = best[j][1][-1] if len(best[j][0]) == k else -np.inf
        for e in range(1, len(edges)):
            # a hair above the exact bound, for rounding; equal scores stay, since the smaller id wins
            live = s + q_rest[e][j] * c_rest[e][at] * (1 + 1e-9) >= floor
            at, s = at[live], s[live]
            if e + 1 < len(edges) and len(at):
                s = s + q[edges[e] : edges[e + 1], j] @ c[edges[e] : edges[e + 1], at]
                if len(at) > 8 * k and floor == -np.inf:
                    # the k-th best lower bound so far is a floor for all
                    low = s - q_rest[e + 1][j] * c_rest[e + 1][at] * (1 + 1e-9)
                    floor = np.partition(low, -k)[-k]
        best[j] = _best_of(np.concatenate([best[j][0], ids[at]]), np.concatenate([best[j][1], s]), k)


_BLOCK = "ids binary, width int, data binary"


def _packed(ids: np.ndarray, vectors: list) -> list[pa.Array]:
    m = _matrix(vectors, max([1, *map(len, vectors)]))
    return [pa.array([ids.tobytes()], pa.binary()), pa.array([len(m)], pa.int32()), pa.array([m.tobytes()], pa.binary())]


def _unpacked(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(width, -1)


def top_k(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, every: int = 100, query_block: int = 4096, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: each query's ``k`` best inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those with the query's id. Fewer
    candidates than ``k``: all of them. Null vectors, and those with a null or non-finite component, take no part, nor do
    rows without id; a shorter vector counts as going on with zeros; an empty table gives no rows; a repeated row is a
    candidate each time, but a repeated query is answered once, from its first vector by value. Sums are exact while they
    stay below 2**53. Nothing but counts comes to the driver; query blocks are broadcast if they take at most ``broadcast_bytes``.
    """
    vectors = integer_vectors(rows, id_col, vec_col, scale)
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    n_blocks = max(1, -(-size["n"] // query_block))
    small = size["n"] * (size["width"] + 1) * 8 <= broadcast_bytes

    def pack_queries(block: pa.Table) -> pa.Table:
        number = pa.array([block["q_block"][0].as_py()], pa.int32())
        return pa.table([number, *_packed(block["vec_id"].to_numpy(), block["v"].to_pylist())], names=["q_block", "q_ids", "q_width", "q_data"])

    def pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CANDIDATES):
                part = b.slice(i, CANDIDATES)
                yield pa.RecordBatch.from_arrays(_packed(part.column("vec_id").to_numpy(), part.column("v").to_pylist()), names=["ids", "width", "data"])

    q_blocks = queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).groupBy("q_block").applyInArrow(pack_queries, "q_block int, q_ids binary, q_width int, q_data binary")
    c_blocks = vectors.mapInArrow(pack_candidates, _BLOCK).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if small:
        met = c_blocks.join(F.broadcast(q_blocks), "q_block")
    else:
        # a query block's candidates are dealt into groups, so that none has all of them
        groups = max(1, min(1 << 16, size["n"] * every // (64 * CANDIDATES)))
        dealt = c_blocks.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        met = dealt.join(q_blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), ["q_block", "group"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for q_ids, _, best in held.values():
                n = [len(ids) for ids, _ in best]
                found = [np.concatenate([b[i] for b in best] or [np.zeros(0)]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64))], names=["query_id", "vec_id", "score"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                number = row["q_block"]
                if number not in held:
                    if len(held) * query_block >= 1 << 17:
                        yield from flush()
                    q_ids, q = _unpacked(row["q_ids"], row["q_width"], row["q_data"])
                    held[number] = q_ids, q, [(np.zeros(0, np.int64), np.zeros(0)) for _ in q_ids]
                q_ids, q, best = held[number]
                search_block(q_ids, q, *_unpacked(row["ids"], row["width"], row["data"]), k, best)
        yield from flush()

    found = met.select("q_block", "q_ids", "q_width", "q_data", "ids", "width", "data").mapInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
