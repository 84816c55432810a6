"""Evaluation of outcome tables: symbol, ts, seq and win (1 or 0), in order of (ts, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(*keys: str) -> Column:
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def runs(outcomes: DataFrame) -> DataFrame:
    """Outcomes with ``run``: a number for each stretch of equal ones."""
    change = (F.col("win") != F.lag("win").over(_order("symbol"))).cast("int")
    df = outcomes.withColumn("_change", F.coalesce(change, F.lit(1)))
    return df.withColumn("run", F.sum("_change").over(_order("symbol").rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def streak_stats(outcomes: DataFrame) -> DataFrame:
    """By symbol: longest and mean runs of wins and losses, their numbers, and the last run (negative: losses). B01"""
    each = runs(outcomes).groupBy("symbol", "run").agg(F.first("win").alias("win"), F.count(F.lit(1)).alias("n"))
    win, loss = F.when(F.col("win") == 1, F.col("n")), F.when(F.col("win") == 0, F.col("n"))
    last = F.max_by(F.when(F.col("win") == 1, F.col("n")).otherwise(-F.col("n")), "run")
    return each.groupBy("symbol").agg(F.max(win).alias("max_win_run"), F.avg(win).alias("avg_win_run"), F.count(win).alias("n_win_runs"), F.max(loss).alias("max_loss_run"), F.avg(loss).alias("avg_loss_run"), F.count(loss).alias("n_loss_runs"), last.alias("last_run"))


def rolling_win_rate(outcomes: DataFrame, n: int = 20) -> DataFrame:
    """By symbol: least, mean and greatest share of wins over n outcomes in a row. B02"""
    w = _order("symbol").rowsBetween(1 - n, 0)
    rate = F.when(F.count("win").over(w) == n, F.avg("win").over(w))
    return outcomes.withColumn("rate", rate).groupBy("symbol").agg(F.min("rate").alias("min_rate"), F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate"))


def block_win_rate(outcomes: DataFrame, blocks: int = 4) -> DataFrame:
    """Share of wins in equal consecutive blocks of n div ``blocks``; the remainder is left out. B03"""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    size = F.floor(n / blocks)
    df = outcomes.withColumn("block", F.floor(F.try_divide(F.row_number().over(_order("symbol")) - 1, size)))
    return df.filter(F.col("block") < blocks).groupBy("symbol", "block").agg(F.avg("win").alias("win_rate"), F.count(F.lit(1)).alias("n"))


def equity_curve(outcomes: DataFrame, base: float = 1.0, step: bool = False) -> DataFrame:
    """Running sum of won and lost sizes, and its fall from the highest value so far. B04

    With ``step`` the size doubles with each loss in a row and starts anew after four: base * 2 ** (losses mod 4).
    """
    w = _order("symbol")
    df = runs(outcomes)
    in_run = Window.partitionBy("symbol", "run").orderBy("ts", "seq")
    losses_now = F.when(F.col("win") == 0, F.row_number().over(in_run)).otherwise(0)
    df = df.withColumn("_losses", losses_now)
    size = base * F.pow(F.lit(2.0), F.coalesce(F.lag("_losses").over(w), F.lit(0)) % 4) if step else F.lit(base)
    df = df.withColumn("size", size).drop("_losses", "run")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.sum(F.when(F.col("win") == 1, F.col("size")).otherwise(-F.col("size"))).over(so_far))
    return df.withColumn("drawdown", F.col("equity") - F.greatest(F.max("equity").over(so_far), F.lit(0.0)))


def portfolio_report(trades: DataFrame) -> DataFrame:
    """Trades, wins and win rate by symbol and horizon, by symbol, and in all (nulls stand for all). B05"""
    return trades.rollup("symbol", "horizon").agg(F.count(F.lit(1)).alias("trades"), F.sum("win").alias("wins"), (100 * F.avg("win")).alias("win_pct"), F.grouping_id().alias("level"))


def win_loss_by_key(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Wins and losses by key. B06"""
    return trades.groupBy(*keys).agg(F.count_if(F.col("win") == 1).alias("wins"), F.count_if(F.col("win") == 0).alias("losses"))


def performance_summary(outcomes: DataFrame) -> DataFrame:
    """Trades, wins (reward over 0), losses and win per cent of all, unresolved ones included. A38"""
    return outcomes.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("reward") > 0).alias("wins"), F.count_if(F.col("reward") <= 0).alias("losses"), (100 * F.try_divide(F.count_if(F.col("reward") > 0), F.count(F.lit(1)))).alias("win_pct"))


def eval_summary(outcomes: DataFrame) -> DataFrame:
    """Means of reward, win, excursions and of their ratio (not the ratio of means). A39"""
    return outcomes.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("avg_reward"), F.avg((F.col("reward") > 0).cast("double")).alias("win_rate"), F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"), F.avg(F.try_divide("mfe", F.nullif(F.abs("mae"), F.lit(0.0)))).alias("avg_ratio"))
