"""Words and shingles of whole Arrow batches as 64-bit hashes, without a Python object for each word.

A word is a maximal run of bytes other than space and U+0009 to U+000D; A-Z count as a-z. Its hash is a polynomial in the
bytes, modulo 2**64, then mixed. Two of V different words share a hash with a probability of about V**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once.
_PART = 1 << 20
#: Rows of a batch that are taken at once.
ROWS_AT_ONCE = 1000

_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _byte_codes() -> np.ndarray:
    folded = np.arange(256, dtype=np.uint64)
    folded[65:91] += np.uint64(32)
    codes = mix((folded + np.uint64(1)) * _MULTIPLIER)
    codes[~_INSIDE] = 0
    return codes


def _powers(base: int) -> np.ndarray:
    out = np.full(_PART + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_CODES, _POWERS, _INVERSES = _byte_codes(), _powers(_BASE), _powers(_INVERSE)


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each text starts in them, with the end; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the first word of each text, with the end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a text's end ends its last word
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.append(np.flatnonzero(start), len(data))  # with the end of the last word
    out = np.zeros(len(starts) - 1, np.uint64)
    i = 0
    while i < len(out):
        # the words that end within a part, one at least
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _PART, side="right")) - 1)
        begin, end = int(starts[i]), int(starts[j])
        if end - begin <= _PART:
            own = starts[i:j] - begin
            out[i:j] = np.add.reduceat(_CODES[data[begin:end]] * _POWERS[: end - begin], own) * _INVERSES[own]
        else:  # one word, or blanks, longer than a part
            h, shift = 0, 1
            for s in range(begin, end, _PART):
                code = _CODES[data[s : min(end, s + _PART)]]
                h = (h + int((code * _POWERS[: len(code)]).sum(dtype=np.uint64)) * shift) % (1 << 64)
                shift = shift * int(_POWERS[_PART]) % (1 << 64)
            out[i] = h
        i = j
    return mix(out * _MULTIPLIER + np.uint64(1)), np.searchsorted(starts, at)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some at a time: what is made of each word is in memory for these only."""
    for s in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(s, ROWS_AT_ONCE)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending within it, and where each text's begin, with the end.

    A text of fewer words than ``width`` is one shingle, one without words has none. Texts of about _PART bytes are taken at once.
    """
    cuts = np.unique(np.append(np.searchsorted(at, np.arange(0, len(data), _PART)), len(at) - 1))
    if cuts[0] > 0:
        cuts = np.append(0, cuts)
    found = [_shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(ends) for _, ends in found])
    return np.concatenate([tokens for tokens, _ in found]), np.concatenate([[0], np.cumsum(sizes)])


def _shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, first = word_hashes(data, at)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    # place of each shingle's first word: places in the text, shifted to where its words begin
    place = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    h = size.astype(np.uint64)
    for k in range(width):
        far = np.minimum(place + k, max(len(words) - 1, 0))
        nxt = mix(h * _MULTIPLIER + words[far]) if len(words) else h
        h = np.where(size > k, nxt, h)
    for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if e - s > 1:
            h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return h[new], kept[begin]
