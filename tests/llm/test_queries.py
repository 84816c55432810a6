"""The registered queries: rows equal to those of their SQL, columns as agreed, and the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, jaccard_join, queries

from ..conftest import DATA
from ..oracle import difference
from .test_operators import cut_lines, same

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op4_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op5_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op6_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op7_best_fit_packing": ["doc_id", "piece", "n_tokens", "shard", "bin", "bin_offset"], "op8_substring_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_line_dedup": ["doc_id", "n_lines", "n_removed", "n_chunks_removed", "kept_sha256"], "op10_vector_topk": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    for c, kind in df.dtypes:
        if c.startswith("n_") and name != "op7_best_fit_packing":
            assert kind == "bigint", c


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = (before, docs)
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    rows = lambda df: [(r.doc_id, r.text, None) for r in df.collect()]
    before, after = kept["language ID"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert len(gone) < 0.02 * before.count()
    before, after = kept["line dedup"]
    same([(r.doc_id, r.text) for r in after.collect()], [(i, t) for i, t, _, n in cut_lines(rows(before)) if not n or t])
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["n-gram Jaccard join"]
    want = {r.component_id for r in jaccard_join.near_duplicates(before).collect()}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)
    before, after = kept["benchmark decontamination"]
    bad = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad
    before, after = kept["best-fit packing"]
    total = Counter()
    for r in after.collect():
        total[r.doc_id] += r.n_tokens
    assert total == Counter({r.doc_id: len(r.text.encode().split()) for r in before.collect()})
    assert after.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n")).filter("n > 2048 and bin >= 0").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == after.count()
