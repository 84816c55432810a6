"""A bidirectional LSTM in numpy that labels every block of a page as main text or not, reading the whole page.

A block enters as the mean of its path tokens' vectors, the mean of its hashed words' vectors, and eight figures. One
LSTM reads the blocks forwards, one backwards; a logistic unit on both states gives the block's probability. Vectors and
weights are learnt together (Adam, on batches of pages of similar length).
"""

from __future__ import annotations

import io
from zlib import crc32

import numpy as np

from .html_blocks import Block

PATHS, WORDS = 2048, 4096
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 16, 6, 8, 16
#: Words whose vectors are in memory at a time, and cells (pages times blocks of the longest) of a batch.
WORDS_AT_ONCE, CELLS = 1 << 18, 1 << 15


def _bucket(token: str, size: int) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % size


class Inputs:
    """Pages as arrays: path and word buckets of all blocks, and figures."""

    def __init__(self, pages: list[list[Block]]) -> None:
        self.sizes = np.array([len(p) for p in pages], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        paths: dict[tuple[str, ...], list[int]] = {}
        words: dict[str, int] = {}
        path_ids: list[int] = []
        word_ids: list[int] = []
        path_n, word_n, figures = [], [], []
        for page in pages:
            for k, b in enumerate(page):
                ids = paths.get(b.path)
                if ids is None:
                    ids = paths[b.path] = [_bucket(t, PATHS) for t in b.path]
                path_ids += ids
                path_n.append(len(ids))
                found = b.text.lower().split()
                for w in found:
                    i = words.get(w)
                    if i is None:
                        i = words[w] = _bucket(w, WORDS)
                    word_ids.append(i)
                if len(words) > 1 << 18:
                    words.clear()
                word_n.append(len(found))
                size = len(b.text)
                stops = sum(map(b.text.count, ".,;:!?"))
                figures.append((np.log1p(len(found)) / 4, b.linked, k / len(page), (len(page) - k) / len(page), stops / len(found), size / len(found) / 10, np.log1p(len(page)) / 5, b.text[-1] in ".!?"))
        self.path_ids, self.path_n = np.array(path_ids, np.int32), np.array(path_n, np.int64)
        self.word_ids, self.word_n = np.array(word_ids, np.int32), np.array(word_n, np.int64)
        self.figures = np.array(figures, np.float32).reshape(-1, FIGURES)


def _means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean vector of each block; counts are at least 1."""
    out = np.empty((len(counts), table.shape[1]), np.float32)
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        begin = ends[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(ends, begin + WORDS_AT_ONCE, side="right")))
        part = ids[begin : ends[b - 1]]
        if b == a + 1:
            out[a] = np.bincount(part, minlength=len(table)) @ table / counts[a]
        else:
            out[a:b] = np.add.reduceat(table[part], ends[a:b] - counts[a:b] - begin, axis=0) / counts[a:b, None]
        a = b
    return out


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + FIGURES
    w = {"paths": rnd.normal(0, 0.3, (PATHS, PATH_DIM)), "words": rnd.normal(0, 0.1, (WORDS, WORD_DIM)), "out": rnd.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for side in ("f", "b"):
        w |= {"x" + side: rnd.normal(0, d**-0.5, (d, 4 * HIDDEN)), "h" + side: rnd.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), "c" + side: np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _vectors(w: dict[str, np.ndarray], x: Inputs) -> np.ndarray:
    return np.concatenate([_means(w["paths"], x.path_ids, x.path_n), _means(w["words"], x.word_ids, x.word_n), x.figures], axis=1)


def _cells(x: Inputs, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each cell (steps by pages), 0 where a page has ended, and whether there is one."""
    steps = np.arange(x.sizes[pages].max())[:, None]
    there = steps < x.sizes[pages]
    return np.where(there, x.firsts[pages] + steps, 0), there


def _read(w: dict[str, np.ndarray], side: str, inputs: np.ndarray, there: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """One LSTM over all steps; of each step (in reading order) the step, gates, cell before and after, state before and after."""
    steps, pages, _ = inputs.shape
    given = inputs @ w["x" + side] + w["c" + side]
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    trace = []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        gates = given[t] + h @ w["h" + side]
        ifo, g = _sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
        m = there[t][:, None]
        forget, take, give = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        new_c = np.where(m, forget * c + take * g, c)
        new_h = np.where(m, give * np.tanh(new_c), h)
        trace.append((t, forget, take, give, g, c, new_c, h, new_h))
        h, c = new_h, new_c
    return trace


def _states(trace: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    out = np.empty((len(trace), *trace[0][-1].shape), np.float32)
    for step in trace:
        out[step[0]] = step[-1]
    return out


def _batches(x: Inputs, order: np.ndarray) -> list[np.ndarray]:
    """Pages (in an order of falling size) in batches of at most CELLS cells; a longer page is a batch of its own."""
    out, a = [], 0
    while a < len(order):
        b = a + max(1, CELLS // int(x.sizes[order[a]]))
        out.append(order[a:b])
        a = b
    return out


def probabilities(w: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Of each page the probability of each block to be main text."""
    x = Inputs(pages)
    result = np.zeros(int(x.sizes.sum()), np.float32)
    filled = np.flatnonzero(x.sizes)
    if len(filled):
        vectors = _vectors(w, x)
        for part in _batches(x, filled[np.argsort(-x.sizes[filled], kind="stable")]):
            cells, there = _cells(x, part)
            inputs = vectors[cells]
            score = sum(_states(_read(w, side, inputs, there)) @ w["out"][k * HIDDEN : (k + 1) * HIDDEN] for k, side in enumerate("fb")) + w["bias"]
            result[cells[there]] = _sigmoid(score[there])
    return np.split(result, np.cumsum(x.sizes)[:-1]) if len(pages) else []


def _gradients(w: dict[str, np.ndarray], x: Inputs, part: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of a batch of pages, back through both readings."""
    cells, there = _cells(x, part)
    blocks = np.concatenate([np.arange(x.firsts[p], x.firsts[p] + x.sizes[p]) for p in part])
    sub = object.__new__(Inputs)
    of_paths = np.concatenate([np.arange(e - n, e) for e, n in zip(np.cumsum(x.path_n)[blocks], x.path_n[blocks], strict=True)])
    of_words = np.concatenate([np.arange(e - n, e) for e, n in zip(np.cumsum(x.word_n)[blocks], x.word_n[blocks], strict=True)])
    sub.path_ids, sub.path_n, sub.word_ids, sub.word_n, sub.figures = x.path_ids[of_paths], x.path_n[blocks], x.word_ids[of_words], x.word_n[blocks], x.figures[blocks]
    local = np.zeros(int(x.sizes.sum()), np.int64)
    local[blocks] = np.arange(len(blocks))
    inputs = _vectors(w, sub)[local[cells]]
    traces = {side: _read(w, side, inputs, there) for side in "fb"}
    states = {side: _states(traces[side]) for side in "fb"}
    score = sum(states[side] @ w["out"][k * HIDDEN : (k + 1) * HIDDEN] for k, side in enumerate("fb")) + w["bias"]
    d_score = np.where(there, _sigmoid(score) - labels[cells], 0).astype(np.float32) / there.sum()
    grads = {"bias": np.array([d_score.sum()]), "out": np.concatenate([np.einsum("tp,tph->h", d_score, states[side]) for side in "fb"])}
    d_inputs = np.zeros_like(inputs)
    for k, side in enumerate("fb"):
        d_given = np.zeros((*there.shape, 4 * HIDDEN), np.float32)
        grads["h" + side] = np.zeros_like(w["h" + side])
        dh, dc = np.zeros((len(part), HIDDEN), np.float32), np.zeros((len(part), HIDDEN), np.float32)
        for t, forget, take, give, g, c, new_c, h, _ in reversed(traces[side]):
            m = there[t][:, None]
            dh = dh + d_score[t][:, None] * w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            shown = np.tanh(new_c)
            inner = dc + dh * give * (1 - shown**2)
            gates = np.concatenate([inner * c * forget * (1 - forget), inner * g * take * (1 - take), dh * shown * give * (1 - give), inner * take * (1 - g**2)], axis=1)
            gates = np.where(m, gates, 0)
            d_given[t] = gates
            grads["h" + side] += h.T @ gates
            dc = np.where(m, inner * forget, dc)
            dh = np.where(m, gates @ w["h" + side].T, dh)
        grads["x" + side] = np.einsum("tpd,tpg->dg", inputs, d_given, optimize=True)
        grads["c" + side] = d_given.sum((0, 1))
        d_inputs += d_given @ w["x" + side].T
    d_blocks = np.zeros((len(blocks), inputs.shape[2]), np.float32)
    d_blocks[local[cells[there]]] = d_inputs[there]
    for name, ids, counts, columns in (("paths", sub.path_ids, sub.path_n, slice(0, PATH_DIM)), ("words", sub.word_ids, sub.word_n, slice(PATH_DIM, PATH_DIM + WORD_DIM))):
        grads[name] = np.zeros_like(w[name])
        np.add.at(grads[name], ids, np.repeat(d_blocks[:, columns] / counts[:, None], counts, axis=0))
    return grads


def train(pages: list[list[Block]], labels: list[np.ndarray], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights learnt from labelled pages; the same pages in the same order give the same weights. No pages give initial ones."""
    w = initial(seed)
    x, y = Inputs(pages), np.concatenate([*labels, np.zeros(0)]).astype(np.float32)
    order = np.flatnonzero(x.sizes)
    order = order[np.argsort(-x.sizes[order], kind="stable")]
    parts = [order[i : i + batch] for i in range(0, len(order), batch)]
    rnd = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        for i in rnd.permutation(len(parts)):
            step += 1
            grads = _gradients(w, x, parts[i], y)
            shrink = min(1.0, 5 / (1e-9 + np.sqrt(sum(float((g**2).sum()) for g in grads.values()))))
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = g * shrink
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g**2 - square[k])
                w[k] = (w[k] - pace * (mean[k] / (np.sqrt(square[k]) + 1e-8) + (1e-3 * w[k] if k == "words" else 0))).astype(np.float32)
    return w


def to_bytes(w: dict[str, np.ndarray]) -> bytes:
    with io.BytesIO() as f:
        np.savez(f, **w)
        return f.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}
