"""State machines over long series, block by block.

A series is cut into blocks of rows by number. Every block runs from the state in which a warm-up over the rows before it
ends, all of them at once. A block is right if it began in the very state in which the block before it ended; those that
weren't run again from that state, until all fit. States of indicators forget where they came from, so as a rule nothing
runs twice; where they don't, each round puts at least one more block of a series right. The longest task is one block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .series import KEYS

#: Rows of a block, and rows of a warm-up.
BLOCK, WARM = 1 << 14, 1 << 11

#: From arrays of the columns, the state before them and the number of the first row: arrays of the output, and the state after.
Step = Callable[[dict[str, np.ndarray], list[float], int], tuple[dict[str, np.ndarray], list[float]]]

_local_dir: str | None = None


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read back from the folder that spark.checkpoint.dir names; in local mode, where that is unset, from a temporary one."""
    global _local_dir
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="barloom-folds-")
        folder = f"file://{_local_dir}"
    path = f"{folder.rstrip('/')}/barloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *columns: str, bucket: str = "day") -> DataFrame:
    """(symbol, tf, ts, columns) with ``_i``, the row's number in its series from 0, by counts of calendar blocks. Rows of equal ts count in any order."""
    rows = df.select(*KEYS, "ts", *columns).withColumn("_day", F.date_trunc(bucket, "ts"))
    sizes = rows.groupBy(*KEYS, "_day").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*KEYS).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*KEYS, "_day", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*KEYS, "_day").orderBy("ts")) - 1
    # a null ts has no day; it doesn't join, and its row takes no part
    return rows.withColumn("_in", inside).join(sizes, [*KEYS, "_day"]).withColumn("_i", F.col("_ahead") + F.col("_in")).drop("_day", "_in", "_ahead")


def block_fold(df: DataFrame, columns: tuple[str, ...], out: str, start: list[float], step: Step, block: int | None = None, warm: int | None = None) -> DataFrame:
    """(symbol, tf, ts, ``_i``, the DDL columns ``out``) of ``step`` run over each series in order of time from the state ``start``.

    Runs jobs when called: blocks are stored, and checked against each other. Columns are doubles, nulls NaN.
    """
    block, warm = block or BLOCK, warm or WARM
    rows = numbered(df, *columns).withColumn("_b", F.floor(F.col("_i") / block))
    stamp = df.schema["ts"].dataType.simpleString()
    names = [f.split()[0] for f in out.split(", ")]
    schema = f"symbol string, tf string, ts {stamp}, _i long, _b long, {out}, _entry array<double>, _exit array<double>"

    def run(p: pa.Table) -> pa.Table:
        p = p.sort_by("_i")
        i, b = p["_i"].to_numpy(), p["_b"][0].as_py()
        a = {c: p[c].cast(pa.float64()).fill_null(np.nan).to_numpy() for c in columns}
        own = int(np.searchsorted(i, b * block))
        given = p["_given"][0].as_py() if "_given" in p.column_names else None
        entry = given or (step({c: x[:own] for c, x in a.items()}, start, int(i[0]))[1] if own else start)
        got, after = step({c: x[own:] for c, x in a.items()}, entry, int(i[own]))
        table, n = p.slice(own).select(["symbol", "tf", "ts", "_i", "_b"]), len(i) - own
        for name in names:
            table = table.append_column(name, pa.array(got[name], from_pandas=True))
        for name, state in (("_entry", entry), ("_exit", after)):  # on a block's last row only
            table = table.append_column(name, pa.array([None] * (n - 1) + [[float(x) for x in state]], pa.list_(pa.float64())))
        return table

    warmed = rows.withColumn("_b", F.explode(F.sequence(F.col("_b"), F.floor((F.col("_i") + warm) / block))))
    last = numbered(df).groupBy(*KEYS).agg(F.floor(F.max("_i") / block).alias("_last"))
    warmed = warmed.join(last, [*KEYS]).filter("_b <= _last").drop("_last")
    first = stored(warmed.groupBy(*KEYS, "_b").applyInArrow(run, schema), "fold")
    states = first.filter("_exit is not null").select(*KEYS, "_b", "_entry", "_exit")
    again = None
    while True:
        before = F.lag("_exit").over(Window.partitionBy(*KEYS).orderBy("_b"))
        wrong = states.withColumn("_given", before).filter((F.col("_b") > 0) & ~F.col("_entry").eqNullSafe(F.col("_given"))).select(*KEYS, "_b", "_given")
        wrong = stored(wrong, "wrong")
        if wrong.isEmpty():
            break
        rerun = rows.join(wrong, [*KEYS, "_b"]).groupBy(*KEYS, "_b").applyInArrow(run, schema).filter("_exit is not null").select(*KEYS, "_b", "_entry", "_exit")
        again = states = stored(states.join(wrong, [*KEYS, "_b"], "left_anti").unionByName(rerun), "states")
    result = first.drop("_entry", "_exit")
    if again is not None:
        changed = again.join(first.filter("_exit is not null").select(*KEYS, "_b", F.col("_entry").alias("_old")), [*KEYS, "_b"]).filter(~F.col("_entry").eqNullSafe(F.col("_old"))).select(*KEYS, "_b", F.col("_entry").alias("_given"))
        right = rows.join(changed, [*KEYS, "_b"]).groupBy(*KEYS, "_b").applyInArrow(run, schema).drop("_entry", "_exit")
        result = result.join(changed, [*KEYS, "_b"], "left_anti").unionByName(right)
    return result.drop("_b")
