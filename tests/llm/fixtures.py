"""A small corpus: the smallest table's documents, and rows that are null, empty, long, repeated or alike."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from ..conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k1 long, label string, words string"


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    words = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = words(150), words(60)
    rows: list[tuple[int | None, str | None, str | None]] = [(10_000, None, None), (10_001, "", "en"), (10_002, " \n\t ", None), (10_003, "one two", "en"), (10_004, "One  TWO", "en"), (10_005, "12345 67890", None), (10_006, "a" * 3000, "en"), (10_007, "é ü ß ñ " * 200, "fr")]
    rows += [(10_010, base, "en"), (10_010, base, "en"), (10_011, base, "en")]
    for i in range(12):
        w = base.split()
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(len(w))] = f"edit{i}"
        rows.append((10_020 + i, " ".join(w), "en"))
    rows += [(10_040 + i, words(rnd.randint(5, 40)) + "\n" + passage + "\n" + words(rnd.randint(5, 40)), "en") for i in range(8)]
    rows += [(10_060, words(9000), "en"), (None, words(30), "en"), (None, None, None)]
    lines = [words(6) for _ in range(12)]
    rows += [(10_070, "\n".join(lines), "en"), (10_071, "\n".join([words(5), *lines, words(5)]), "en"), (10_072, "\n".join(lines[3:] + [words(5)]), "en"), (10_073, "\n\n\n", "en"), (10_074, "\n\n\n", "en")]
    return rows


def corpus(spark: SparkSession) -> DataFrame:
    """All columns of ``documents``, and more whose names operators use inside."""
    extra = spark.createDataFrame([(i, t, lang, "src0", None, 1.0, 5, "x", "y") for i, t, lang in texts()], SCHEMA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs.unionByName(extra, allowMissingColumns=True).repartition(3)


def rows(docs: DataFrame) -> list[tuple]:
    return [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]


def empty(docs: DataFrame) -> DataFrame:
    return docs.limit(0)
