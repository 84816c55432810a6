"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text's code points, hashed into ``2**BITS`` buckets, weighted
(1 + ln count) * idf and scaled to length 1. Document frequencies are counted over every training text. The weights are
learned by follow-the-regularised-leader with elastic-net penalties (most stay exactly 0) on a bounded sample: at most
``per_class`` distinct texts of each language, those with the smallest hashes. One fifth of the sample only sets the temperature
that makes the softmax a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, per_text
from .hashing import slices

BITS, ORDERS = 16, (1, 2, 3)
UNKNOWN = "und"


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the text's n-grams hash to, ascending, and how often."""
    code = np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(code), np.uint64)
    for n in ORDERS:
        h = (h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + (code[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = bucket_counts(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression, one example at a time."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = np.outer(x, p)
        was = self.n[at]
        now = was + g * g
        self.z[at] += g - (np.sqrt(now) - np.sqrt(was)) / self.alpha * w
        self.n[at] = now


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 0.05 and 20 of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.mean(np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12))
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    """``languages`` ascending; ``weights`` by bucket and language, idf apart; empty languages predict only ``und``."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            if not self.languages or not has_letter(t):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = features(t, self.idf)
            p = softmax(x @ self.weights[at] / self.temperature)
            best = int(p.argmax())
            langs.append(self.languages[best])
            scores.append(float(p[best]))
        return langs, scores


def training_sample(rows: DataFrame, per_class: int, max_classes: int) -> DataFrame | None:
    """Of each ``lang`` the ``per_class`` distinct ``text``s with a letter whose hashes are smallest, or all if there are fewer; None without any.

    Copies and letterless texts count for nothing, so the sample depends on the distinct texts alone.
    """
    h = F.xxhash64("text")
    hashed = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", h.alias("h"))
    per_lang = hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_lang.limit(max_classes + 1).collect()
    if len(sizes) > max_classes:
        raise ValueError(f"more than {max_classes} languages among the labels")
    if not sizes:
        return None
    # the lowest part of the hash range, with twice the wanted texts: only those are grouped and sorted
    parts = [(r["lang"], min(1 << 20, (per_class * 2 * (1 << 20)) // r["n"] + 1)) for r in sizes]
    part = F.broadcast(rows.sparkSession.createDataFrame(parts, "lang string, part long"))
    low = hashed.join(part, "lang").filter(F.shiftright("h", 44) + (1 << 19) < F.col("part"))
    once = low.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.filter(F.col("rank") <= per_class).select("lang", "text")


def fit_language_model(train: DataFrame, text_col: str = "text", lang_col: str = "lang", per_class: int = 600, epochs: int = 3, max_classes: int = 400) -> LanguageModel:
    """Learn from the rows whose text has a letter and whose label is not null; other rows are left out.

    ``per_class`` bounds the sample that the weights are fitted on, in distinct texts; document frequencies cover all
    rows, copies included. More than ``max_classes`` languages are an error. An empty table gives a model that answers ``und``. One task learns from the sample;
    only its weights and 2**BITS counts come to the driver.
    """
    rows = train.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        total = 0
        for b in chain.from_iterable(map(slices, batches)):
            for t in b.column("text").to_pylist():
                if has_letter(t):
                    df[bucket_counts(t)[0]] += 1
                    total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], names=["bucket", "n"])

    counts = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    n_docs = int(n[bucket == -1].sum())
    df = np.zeros(1 << BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    picked = training_sample(rows, per_class, max_classes)
    if picked is None:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), 1.0)
    # the sample is bounded: one task learns from it, and only weights that aren't 0 come to the driver
    sample = picked.select("lang", F.xxhash64("text", F.lit(1)).alias("h"), "text")
    learned = sample.groupBy().applyInArrow(lambda rows: learn(rows, idf, epochs), "bucket int, w array<float>, languages array<string>, temperature double").toArrow()
    head = learned.filter(pc.equal(learned["bucket"], -1))
    langs = head["languages"][0].as_py()
    rest = learned.filter(pc.greater_equal(learned["bucket"], 0))
    w = np.zeros((1 << BITS, len(langs)), np.float32)
    w[rest["bucket"].to_numpy()] = rest["w"].combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
    return LanguageModel(langs, idf, w, head["temperature"][0].as_py())


def learn(sample: pa.Table, idf: np.ndarray, epochs: int) -> pa.Table:
    """Weights by bucket from rows of ``lang``, ``h``, ``text``, in the order of h; bucket -1 has the languages and the temperature."""
    sample = sample.sort_by([("h", "ascending"), ("lang", "ascending")])
    langs = sorted(set(sample["lang"].to_pylist()))
    index = {v: i for i, v in enumerate(langs)}
    examples = [(*features(t, idf), index[v]) for t, v in zip(sample["text"].to_pylist(), sample["lang"].to_pylist(), strict=True)]
    held = (sample["h"].to_numpy() % 5) == 0
    ftrl = Ftrl(1 << BITS, len(langs))
    for _ in range(epochs):
        for e, out in zip(examples, held, strict=True):
            if not out:
                ftrl.learn(*e)
    w = ftrl.weights(slice(None)).astype(np.float32)
    aside = [e for e, out in zip(examples, held, strict=True) if out]
    logits = np.array([x @ w[a] for a, x, _ in aside]).reshape(-1, len(langs))
    t = temperature(logits, np.array([y for *_, y in aside], np.int64))
    at = np.flatnonzero(w.any(axis=1))
    return pa.table([pa.array(np.append(-1, at), pa.int32()), pa.array([[], *w[at]], pa.list_(pa.float32())), pa.array([langs, *[None] * len(at)], pa.list_(pa.string())), pa.array([t, *[None] * len(at)], pa.float64())], names=["bucket", "w", "languages", "temperature"])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns named in ``carry``, ``lang_pred``, ``score``: one row per input row. A null text, or one without a letter, is ``und`` with score 0.

    Only the text enters the prediction. The model (a few MB, whatever the corpus) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list[str | None]) -> list[pa.Array]:
        langs, scores = shared.value.predict(texts)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    # a carried text goes through the workers once, not beside a second copy of it
    kept = text_col in carry and docs.schema[text_col].dataType.simpleString() == "string"
    others = [c for c in carry if not (kept and c == text_col)]
    read = col(text_col).cast("string").alias("text_read")
    told = per_text(docs.select(col(id_col).alias("doc_id"), *map(col, others), read), "lang_pred string, score double", predict, keep=kept, sliced=True)
    return told.withColumnRenamed("text_read", text_col).select("doc_id", *map(col, carry), "lang_pred", "score") if kept else told
