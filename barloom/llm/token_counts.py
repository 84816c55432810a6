"""Token counts by overlap resynchronisation.

A text of up to ``chunk_chars`` is encoded whole. A longer one is cut into chunks that overlap and that any task may
encode. Each chunk reports, for its two overlaps, the offsets at which a pre-token ends and the tokens up to there. The
pre-tokeniser only looks ahead, so from an offset at which both neighbours end a pre-token on, both go on alike: such an
offset is a proven stable boundary, if it is at least a special token's length away from the left chunk's end, where the
cut can still show. Neighbours are spliced at the last such offset. A document in which a pair has none is cut anew with
overlaps four times as wide, and in the end is one chunk.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, per_text, store

#: Characters before a chunk's end at which the cut can still change tokens: the longest special token, and one more.
MARGIN = 32
#: Below this code point the libraries' pre-tokenisers class all characters alike (tested); beyond it only the reference library counts.
PLAIN = re.compile(r"[\u0000-\u001b -\u0084\u0086-ɏ]*")


@cache
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _ranks(path: str, pattern: str):
    """The same vocabulary as merge ranks, for the library that counts plain texts faster; made from the .json file's own tables."""
    import json

    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    # byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: Fixed value: the pre-token pattern of byte-level BPE files with ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _plain_bpe(path: str) -> bool:
    """Whether the file is byte-level BPE with the pattern above and plain special tokens, so that _ranks() counts alike."""
    import json

    spec = json.load(open(path, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["special"] for t in spec["added_tokens"])
    return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")


def count_tokens_of(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text, as the library for the file counts them: no begin or end token, special strings as its default, nothing cut. Null: 0."""
    texts = [t or "" for t in texts]
    if path.endswith(".model"):
        return [len(x) for x in _sentencepiece(path).encode(texts, num_threads=1)]
    if not _plain_bpe(path):
        return [len(_reference(path).encode(t, add_special_tokens=False)) for t in texts]
    fast = _ranks(path, PATTERN)
    return [len(fast.encode(t, allowed_special="all")) if len(t) < 100_000 and PLAIN.fullmatch(t) else len(_reference(path).encode(t, add_special_tokens=False)) for t in texts]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Start and text of the chunks: each but the first begins ``overlap`` characters before the previous one's end."""
    if len(text) <= chunk or overlap >= chunk:
        return [(0, text)]
    starts = range(0, len(text) - overlap, chunk - overlap)
    return [(s, text[s : s + chunk]) for s in starts]


def boundaries(text: str, start: int, overlap: int, path: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """All tokens of a chunk, then the stable ends in its first and in its last overlap: offsets in the document, and tokens up to each."""
    e = _reference(path).encode(text, add_special_tokens=False)
    words, offsets, n = e.word_ids, e.offsets, len(e.ids)
    # a pre-token ends where the next token belongs to another one; special tokens have no word and end both ways
    ends = [(offsets[i][1], i + 1) for i in range(n - 1) if words[i] != words[i + 1] or words[i] is None]
    head = [(start + o, k) for o, k in ends if o <= overlap]
    tail = [(start + o, k) for o, k in ends if len(text) - overlap <= o <= len(text) - MARGIN]
    return n, [o for o, _ in head], [k for _, k in head], [o for o, _ in tail], [k for _, k in tail]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each text under the vocabulary file ``path``.

    One row per input row, repeated rows included. A null or empty text has 0 and 0. Texts over ``chunk_chars`` are
    counted in chunks by resynchronisation (byte-level BPE files; others are encoded whole). Executors read ``path``
    from their own installation of the vocabulary package. Other columns are not read, so their names can't clash.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.octet_length(F.coalesce(col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk_chars if path.endswith(".json") and _plain_bpe(path) else F.lit(False)
    whole = per_text(rows.filter(~long), "n_tokens long", lambda texts: [pa.array(count_tokens_of(texts, path), pa.int64())])

    done = []
    # equal (doc_id, text) count alike: repeated rows are cut once and joined back by that key
    huge = rows.filter(long).withColumn("h", F.xxhash64("text"))
    left, width = huge.select("doc_id", "h", "text").dropDuplicates(["doc_id", "h"]), overlap
    while True:
        counts = store(_spliced(left, path, chunk_chars if width < chunk_chars else 1 << 31, width), "spliced")
        done.append(counts)
        if counts.filter("n_tokens is null").isEmpty():
            break
        width *= 4
        failed = counts.filter("n_tokens is null").select(F.col("doc_id").alias("d"), F.col("h").alias("g"))
        left = left.join(failed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
    all_counts = done[0]
    for c in done[1:]:
        all_counts = all_counts.unionByName(c)
    all_counts = all_counts.filter("n_tokens is not null").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_tokens")
    long_rows = huge.drop("text").join(all_counts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("doc_id", "n_bytes", "n_tokens")
    return whole.unionByName(long_rows)


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, h, n_tokens: null where two neighbours share no stable boundary."""

    def chunks(batch: list[str]) -> list[pa.Array]:
        return [pa.array([[{"start": s, "part": p} for s, p in cut(t, chunk, overlap)] for t in batch], pa.list_(pa.struct([("start", pa.int64()), ("part", pa.string())])))]

    def ends(batch: list[str]) -> list[pa.Array]:
        got = [boundaries(p[p.index("\t") + 1 :], int(p[: p.index("\t")]), overlap, path) for p in batch]
        longs = pa.list_(pa.int64())
        return [pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], longs) for i in range(1, 5))]

    parts = per_text(texts, "chunks array<struct<start:long,part:string>>", chunks).select("doc_id", "h", F.explode("chunks").alias("c"))
    # the start travels in front of the chunk's text, so one string column is all that the encoder reads
    parts = parts.select("doc_id", "h", F.col("c.start").alias("start"), F.concat(F.col("c.start").cast("string"), F.lit("\t"), F.col("c.part")).alias("part"))
    parts = parts.repartition("doc_id", "h", "start")
    coded = per_text(parts, "n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>", ends)
    w = Window.partitionBy("doc_id", "h").orderBy("start")
    at = F.array_max(F.array_intersect("tail", "next_head"))
    coded = coded.withColumn("next_head", F.lead("head").over(w)).withColumn("next_n", F.lead("head_n").over(w)).withColumn("at", at)
    # tokens up to the splice on the left, less those that the right chunk has before it; a last chunk has all of its own
    gain = (
        F.when(F.col("next_head").isNull(), F.col("n"))
        .when(F.col("at").isNull(), F.lit(None))
        .otherwise(F.element_at("tail_n", F.array_position("tail", F.col("at")).cast("int")) - F.element_at("next_n", F.array_position("next_head", F.col("at")).cast("int")))
    )
    return coded.groupBy("doc_id", "h").agg(F.when(F.count(gain) == F.count(F.lit(1)), F.sum(gain)).alias("n_tokens"))
