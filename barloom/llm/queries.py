"""The queries of this subpackage, each a thin use of its operator over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import score_texts
from .common import ascii_lower, crc_mod
from .decontaminate import contamination
from .html_extract import extract_main_text, fit_block_labeller
from .jaccard_join import near_duplicates
from .language_id import fit_language_model, identify
from .line_dedup import remove_repeated_chunks, remove_repeated_passages
from .merkle_manifest import merkle_manifest
from .packing import best_fit_pack
from .periodic_runs import periodic_runs
from .pii import detect_pii, span_digest
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .vector_topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies keeps a file; the same on all machines of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(detect_pii(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = fit_language_model(docs.filter(~F.col("held_out")))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file()).withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_tokens"), F.md5(F.col("text").cast("binary")).alias("cluster"))
    return best_fit_pack(sized)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.size("removed").cast("long").alias("n_chunks_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.size("removed").cast("long").alias("n_runs_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which a document whose crc32 h ends in 0 repeats the p words from word a up to its end."""
    n = F.size("w")
    tail = n - F.col("a")
    p = F.lit(1) + F.floor(tail / (3 + F.col("g") % 8)).cast("int")
    copies = F.array_repeat(F.slice("w", F.col("a") + 1, p), F.ceil(tail / p).cast("int"))
    planted = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(copies)), F.lit(1), n), " ")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    first = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
    found = found.withColumn("best", first)
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_main_text(pages, fit_block_labeller(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_main")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered={"text": F.when(crc_mod("doc_id", 3) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pii, op2_language_id, op3_lm_score, op4_jaccard_join, op5_decontamination, op6_token_counts, op7_best_fit_packing, op8_substring_dedup, op9_line_dedup, op9_passage_dedup, op10_vector_topk, op11_periodic_runs, op12_html_extract, op13_merkle_manifest)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Only queries that SQL can express; models, tokenizers and the packing search are tested against brute force.
SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_n >= 75 * (p.n + q.n - both_n)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM v),
z AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT doc_id, n, s, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM z) JOIN win USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM occ)) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id""",
    "op9_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
m AS (SELECT *, list_transform(l, lambda x: md5(x)) AS m FROM d),
c AS (SELECT doc_id, text, l, list_distinct(list_append(list_filter(range(1, len(l) + 1), lambda i: md5(concat(CASE WHEN i = 1 THEN '' ELSE m[i - 1] END, m[i]))[1] IN ('0', '1', '2', '3')), len(l))) AS e FROM m),
s AS (SELECT doc_id, text, l, list_sort(e) AS e FROM c),
k AS (SELECT doc_id, text, l, unnest(list_zip(list_concat([0], e[:-2]), e)) AS z FROM s),
p AS (SELECT doc_id, text, l, z[1] AS a, z[2] AS b, array_to_string(l[z[1] + 1:z[2]], chr(10)) AS t FROM k),
f AS (SELECT *, b - a >= 2 AND row_number() OVER (PARTITION BY t, b - a ORDER BY doc_id, a) > 1 AS gone FROM p)
SELECT doc_id, CASE WHEN any_value(text) IS NULL THEN 0 ELSE CAST(len(any_value(l)) AS BIGINT) END AS n_lines, CAST(coalesce(sum(b - a) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed, count(*) FILTER (WHERE gone) AS n_chunks_removed,
sha256(coalesce(string_agg(t, chr(10) ORDER BY a) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op10_vector_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE h AS (SELECT doc_id, lang, source, n_chars, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM documents),
f AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM h),
x AS (SELECT *, list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda p, q: p || q) AS head FROM f),
e AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS forged FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, forged) - 1 AS pos, row_number() OVER () AS id FROM e),
t AS (SELECT lang, 0 AS k, list(leaf ORDER BY pos) AS l FROM r GROUP BY lang UNION ALL SELECT lang, k + 1, list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], ''))) FROM t WHERE len(l) > 1),
s AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(l) = 1),
u AS (SELECT 0 AS k, list(subroot ORDER BY pos) AS l FROM s HAVING count(*) > 0 UNION ALL SELECT k + 1, list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], ''))) FROM u WHERE len(l) > 1),
q AS (SELECT id, k, pos >> (3 * k) AS q, l FROM r JOIN t ON t.lang IS NOT DISTINCT FROM r.lang AND len(l) > 1
    UNION ALL SELECT id, 1000 + k, s.pos >> (3 * k), l FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang JOIN u ON len(u.l) > 1),
p AS (SELECT id, list({{'a': array_to_string(l[q - q % 8 + 1:q], ''), 'b': array_to_string(l[q + 2:q - q % 8 + 8], '')}} ORDER BY k) AS path FROM q GROUP BY id),
w AS (SELECT r.*, s.subroot, (SELECT l[1] FROM u WHERE len(l) = 1) AS root, coalesce(path, []) AS path FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang LEFT JOIN p ON p.id = r.id),
z AS (SELECT *, list_reduce(list_prepend({{'a': forged, 'b': ''}}, path), lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda v: v.a || v.b), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z""",
}
