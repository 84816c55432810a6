"""Periodic runs of words, found through string synchronising sets at dyadic scales.

At scale t a position is *synchronising* if, of the hashes of the t-word strings that start at it and at the next t
positions, the first or the last is the least; strings that are themselves highly periodic (a period of at most t / 4)
take no part. Whether a position is chosen depends on the 2t words from it alone, so equal contexts are chosen alike.

A run of smallest period q, t < q <= 2t, and at least 4q words repeats its least-hashed string every q words. The first
two such places have equal contexts of 2t >= q words within the run, and no equal context lies between them, since words
q apart are equal and no shorter shift maps a primitive period to itself. So each run is proposed by two neighbouring
synchronising positions of equal context. Periods of at most 4, which highly periodic strings hide, are found directly.
Every proposal is compared word by word and extended as far as it goes; hashes only propose.

Texts are dealt with in blocks of about ``BLOCK`` words, longest first, so that one array operation serves many texts;
words of different texts never compare equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, per_text

#: Words of a block of texts; a longer text is a block of its own.
BLOCK = 1 << 17
#: Periods up to this are found directly; scales begin here.
SMALL = 4
_LAST = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal stretches of true."""
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _extend(w: np.ndarray, i: int, q: int, step: int) -> int:
    """From i on in direction ``step``, how many words equal those q places on; blocks double, so the work is of the order of the result."""
    done, size = 0, 64
    while True:
        if step > 0:
            a = w[i + done : i + done + size]
            b = w[i + done + q : i + done + q + size]
        else:
            low = max(0, i - done - size + 1)
            a, b = w[low : i - done + 1][::-1], w[low + q : i - done + 1 + q][::-1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        if len(differ):
            return done + int(differ[0])
        done += n
        if n < size:
            return done
        size *= 2


def _primes(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*found, q] if q > 1 else found


def _primitive(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether no proper divisor of q is a period too. (Of at least 2q words, a smaller period with q as another divides it.)"""
    return not any(np.array_equal(w[start : end - q // r], w[start + q // r : end]) for r in _primes(q))


def find_runs(w: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All (start, end, q) of ``w`` with smallest period q and end - start >= 4q, maximal; ``longest`` bounds a run's length."""
    n, runs = len(w), []
    for q in range(1, min(SMALL, longest // 4) + 1):
        starts, ends = _stretches(w[: n - q] == w[q:]) if n > q else ((), ())
        for a, b in zip(starts, ends, strict=True):
            if b - a >= 3 * q and _primitive(w, int(a), int(b) + q, q):
                runs.append((int(a), int(b) + q, q))
    h = _mix(w.astype(np.uint64))
    t = 1
    while 4 * (t + 1) <= longest and 2 * t < n:
        # here h[i] names the t words from i; the strings of 2t words are those of this scale's contexts
        context = _mix(h[:-t] * np.uint64(3) + _mix(h[t:]))
        if t >= SMALL:
            runs += _at_scale(w, h, context, t, runs)
        h, t = context, 2 * t
    return runs


def _at_scale(w: np.ndarray, h: np.ndarray, context: np.ndarray, t: int, shorter: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs of period t + 1 to 2t, given those of shorter periods."""
    order = np.minimum(h, _LAST - np.uint64(1))
    for a, b, p in shorter:
        if 4 * p <= t <= b - a:
            order[a : b - t + 1] = _LAST
    least, width = order, 1
    while width < t:  # the least of ever wider windows
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], least[1:])  # of t + 1 places
    m = min(len(least), len(context))
    low = least[:m]
    chosen = np.flatnonzero((low != _LAST) & ((order[:m] == low) | (order[t : t + m] == low)))
    names = context[chosen]
    by = np.argsort(names, kind="stable")
    at, names = chosen[by], names[by]
    gap = at[1:] - at[:-1]
    near = np.flatnonzero((names[1:] == names[:-1]) & (gap > t) & (gap <= 2 * t))
    found: dict[int, list[tuple[int, int]]] = {}
    result = []
    for k in near[np.argsort(at[near], kind="stable")]:
        i, q = int(at[k]), int(gap[k])
        known = found.setdefault(q, [])
        if known and known[-1][0] <= i < known[-1][1] - q:
            continue
        a, b = i - _extend(w, i, q, -1) + 1, i + _extend(w, i, q, 1) + q
        if i < a:  # the hashes agree, the words don't
            continue
        known.append((a, b))
        if b - a >= 4 * q and _primitive(w, a, b, q):
            result.append((a, b, q))
    return result


def _blocks(sizes: list[int]) -> list[list[int]]:
    """Texts in blocks of about BLOCK words, longest first."""
    blocks, filled = [], BLOCK + 1
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if filled + sizes[i] > BLOCK:
            blocks.append([])
            filled = 0
        blocks[-1].append(i)
        filled += sizes[i] + 1
    return blocks


def runs_of_texts(texts: list[str | None], least_length: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Of each text its runs (start, length, period) in order, and the words that are kept, joined by spaces."""
    words = [t.encode().split() if t else [] for t in texts]  # bytes split at the space and U+0009 to U+000D alone
    out: list = [([], b"")] * len(texts)
    for block in _blocks([len(x) for x in words]):
        codes: dict = {}
        ids, begins = [], []
        for i in block:
            begins.append(len(ids))
            ids += [codes.setdefault(x, len(codes)) for x in words[i]]
            codes.clear()
            ids.append(-1)
        w = np.array(ids, np.int64)
        ends = np.array([*begins[1:], len(w)]) - 1
        # a number is a word of one text only, and what parts two texts equals nothing
        w += np.repeat(np.array(begins), ends - begins + 1)
        w[ends] = len(w) + np.arange(len(ends))
        runs: list[list] = [[] for _ in block]
        for a, b, q in find_runs(w, len(words[block[0]])):
            if b - a >= least_length:
                k = int(np.searchsorted(begins, a, side="right")) - 1
                runs[k].append((a - begins[k], b - a, q))
        for k, i in enumerate(block):
            kept = words[i]
            if runs[k]:
                runs[k].sort(key=lambda r: (r[0], r[2]))
                gone = np.zeros(len(kept) + 1, np.int64)
                for a, n, q in runs[k]:
                    gone[a + q] += 1
                    gone[a + n] -= 1
                kept = [x for x, g in zip(kept, np.cumsum(gone).tolist(), strict=False) if not g]
            out[i] = (runs[k], b" ".join(kept))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6) -> DataFrame:
    """``doc_id``, ``runs`` (array of ``start``, ``length``, ``period``, by start and period) and ``collapsed`` of every text.

    A run is a stretch of words ``[^\\x20\\x09-\\x0D]+`` with smallest period q and at least ``max(least_length, 4q)`` words that no
    neighbouring word extends; words are numbered from 0 and compared as they stand. ``collapsed`` holds the words outside
    all runs and each run's first q words, joined by one space; a word that any run drops is dropped.

    A null or empty text has no runs and an empty ``collapsed``. Every row gives one row, repeated rows and null ids
    included; an empty table gives none. Other columns are not read. One scan and no shuffle; a task holds one batch.
    """

    def of_texts(texts: list[str | None]) -> list[pa.Array]:
        found = runs_of_texts(texts, least_length)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r, _ in found]))).astype(np.int32)
        flat = np.array([x for r, _ in found for x in r], np.int64).reshape(-1, 3)
        fields = [pa.field(name, pa.int64()) for name in ("start", "length", "period")]
        parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=fields)
        return [pa.ListArray.from_arrays(offsets, parts), pa.array([kept.decode() for _, kept in found], pa.string())]

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return per_text(rows, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", of_texts)
