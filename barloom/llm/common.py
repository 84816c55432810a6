"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import slices

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, in local mode, a temporary one where it is unset."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="barloom-")
    return f"file://{_local_dir}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and any executor can reread it."""
    path = f"{shared_dir(df.sparkSession)}/barloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.barloom_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that store() wrote, once nothing reads them any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.barloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes ``k1`` and ``k2`` that name a row by its id and text, nulls included; rows equal in both share them."""
    text = col(text_col).cast("string")
    return F.xxhash64(col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(1), col(id_col)).alias("k2")


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the column's text, modulo ``n``: the fold that the evaluation splits use. A null counts as an empty text."""
    return F.crc32(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: maximal runs of characters other than space and U+0009 to U+000D, with A-Z in lower case.

    Methods of bytes change and split at exactly these ASCII characters and no others.
    """
    return text.lower().split() if text else []


def per_text(rows: DataFrame, fields: str, of_texts: Callable[[list[str | None]], list[pa.Array]], keep: bool = False, sliced: bool = False) -> DataFrame:
    """Append the columns ``fields`` (DDL) that ``of_texts`` computes from each Arrow batch, or from slices() of it, of the last column, a string, which is dropped unless ``keep``."""
    text = rows.columns[-1]
    keys = rows.columns if keep else rows.columns[:-1]
    names = [*keys, *T.StructType.fromDDL(fields).names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)) if sliced else batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *of_texts(b.column(text).to_pylist())], names=names)

    schema = T.StructType([*rows.schema.fields[: len(keys)], *T.StructType.fromDDL(fields).fields])
    return rows.mapInArrow(run, schema)
