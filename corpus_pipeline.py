"""A training corpus in five stages: language ID, line dedup, near-duplicate join, benchmark decontamination, packing.

Every stage takes the rows that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import crc_mod, row_keys, store
from barloom.llm.decontaminate import drop_contaminated
from barloom.llm.jaccard_join import keep_one
from barloom.llm.language_id import UNKNOWN, fit_language_model, identify
from barloom.llm.line_dedup import remove_repeated_chunks
from barloom.llm.packing import best_fit_pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if the model gives its language at least this probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language the model can't tell, go.

    Only keys and answers come back from the workers, and the few keys of what goes are set against the documents: texts
    are shuffled only where these keys are too many to broadcast.
    """
    model = fit_language_model(docs.filter(crc_mod("doc_id", 3) != 1))
    keyed = docs.select(*COLUMNS, *row_keys("doc_id", "text"))
    told = identify(keyed, model, carry=("k1", "k2"))
    gone = store(told.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_SCORE)).select("k1", "k2"), "rejected")
    return keyed.join(gone, ["k1", "k2"], "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; a document of which nothing is left goes."""
    cut = remove_repeated_chunks(docs, carry=("lang", "source"))
    left = cut.filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark items go."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; lengths are words, duplicate clusters equal texts."""
    length = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return best_fit_pack(docs.select("doc_id", "source", length.alias("n_tokens"), F.md5(F.col("text").cast("binary")).alias("cluster")))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: No SQL: the first stage is a trained model and the last an ordered search; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
