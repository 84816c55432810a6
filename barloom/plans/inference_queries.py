"""Queries over tests of samples, dependence, bootstrap intervals, unit roots and dataset lineage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import rounded
from ..operators import dependence, inference, preparation, stats
from .bar_queries import hourly
from .event_queries import COLS, lineitem, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


def orders(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).cast("double").alias("cust"), F.dayofmonth("o_orderdate").cast("double").alias("day"))


_ORDERS = "o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey % 97 AS DOUBLE) AS cust, CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders)"
#: All pairs of rows: the plain form of both coefficients.
_PAIRED = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, sum(xy) / (count(*) * count(*)) - 2 * avg(ax * ay) + avg(ax) * avg(ay) AS cov, sum(xx) / (count(*) * count(*)) - 2 * avg(ax * ax) + avg(ax) * avg(ax) AS vx, sum(yy) / (count(*) * count(*)) - 2 * avg(ay * ay) + avg(ay) * avg(ay) AS vy, sum(score) AS score, sum(dx) AS dx, sum(dy) AS dy FROM"
    f" (SELECT p.id, avg(abs(p.{a} - q.{a})) AS ax, avg(abs(p.{b} - q.{b})) AS ay, sum(abs(p.{a} - q.{a}) * abs(p.{b} - q.{b})) AS xy, sum((p.{a} - q.{a}) * (p.{a} - q.{a})) AS xx, sum((p.{b} - q.{b}) * (p.{b} - q.{b})) AS yy, sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) AS score, count(*) FILTER (WHERE p.{a} <> q.{a}) AS dx, count(*) FILTER (WHERE p.{b} <> q.{b}) AS dy FROM o p, o q GROUP BY 1)"
    for a, b in (("o_totalprice", "cust"), ("o_totalprice", "day"))
)
_DEPENDENT = (("o_totalprice", "cust"), ("o_totalprice", "day"))
add("a13_distance_correlation", lambda s, d: dependence.pair_dependence(orders(s, d), _DEPENDENT).select("a", "b", "n", "dcor"), f"WITH {_ORDERS}, z AS ({_PAIRED}) SELECT a, b, n, round(CASE WHEN vx * vy > 0 THEN sqrt(greatest(cov, 0) / sqrt(vx * vy)) ELSE 0 END, 6) AS dcor FROM z")
add("a11_kendall", lambda s, d: dependence.pair_dependence(orders(s, d), _DEPENDENT).select("a", "b", "n", "tau_b"), f"WITH {_ORDERS}, z AS ({_PAIRED}) SELECT a, b, n, round(score / sqrt(dx) / sqrt(dy), 6) AS tau_b FROM z")
for _m in ("pearson", "spearman", "kendall"):
    add(f"a11_{_m}_p", lambda s, d, m=_m: inference.correlation_tests(lineitem(s, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), COLS, m, "id"), None)
add("a12_significant_pairs", lambda s, d: inference.significant_pairs(inference.correlation_tests(hourly(s, d), ("open", "high", "low", "close", "volume"))), None)

_SAMPLES = ("cust", "day")
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS x FROM o WHERE {c} IS NOT NULL" for c in _SAMPLES)
_F = "(SELECT sum(n * (m - g) * (m - g)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT c, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM {} GROUP BY c)))"
_RANK = "r AS (SELECT c, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM l), t AS (SELECT sum(n * n * n - n) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY x))"
add(
    "a22_group_statistics", lambda s, d: inference.group_tests(stats.unpivot(orders(s, d), _SAMPLES)).select("test", "statistic"),
    f"WITH {_ORDERS}, l AS ({_LONG}), far AS (SELECT l.c, abs(x - m) AS x FROM l JOIN (SELECT c, median(x) AS m FROM l GROUP BY c) USING (c)), {_RANK}, g AS (SELECT c, CAST(count(*) - 1 AS DOUBLE) AS d, var_samp(x) AS v FROM l GROUP BY c)"
    f" SELECT 'anova' AS test, round({_F.format('l')}, 6) AS statistic UNION ALL SELECT 'levene', round({_F.format('far')}, 6) UNION ALL SELECT 'bartlett', round((sum(d) * ln(sum(d * v) / sum(d)) - sum(d * ln(v))) / (1 + (sum(1 / d) - 1 / sum(d)) / (3 * (count(*) - 1))), 6) FROM g"
    " UNION ALL SELECT 'kruskal', round((12.0 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (CAST(sum(n) AS DOUBLE) * sum(n) * sum(n) - sum(n))), 6) FROM (SELECT c, count(*) AS n, sum(r) AS r FROM r GROUP BY c), t",
)
add("a22_group_tests", lambda s, d: inference.group_tests(lineitem(s, d).select(F.col("l_returnflag").alias("column"), F.col("l_extendedprice").cast("double").alias("x"))), None)
add(
    "a22_pairwise_statistics", lambda s, d: inference.pairwise_tests(orders(s, d), _SAMPLES).select("a", "b", "n_a", "n_b", "t", "u"),
    f"WITH {_ORDERS}, l AS ({_LONG}), {_RANK}, g AS (SELECT c, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY c) SELECT p.c AS a, q.c AS b, p.n AS n_a, q.n AS n_b, round((p.m - q.m) / sqrt(((p.n - 1) * p.v + (q.n - 1) * q.v) / (p.n + q.n - 2) * (1.0 / p.n + 1.0 / q.n)), 6) AS t, round((SELECT sum(r) FROM r WHERE r.c = p.c) - p.n * (p.n + 1) / 2.0, 6) AS u FROM g p, g q WHERE p.c = 'cust' AND q.c = 'day'",
)
add("a22_pairwise_tests", lambda s, d: inference.pairwise_tests(lineitem(s, d), ("l_quantity", "l_discount", "l_tax")), None)
add("a19_normality", lambda s, d: inference.normality(orders(s, d), ("o_totalprice", "cust")), None)
SQL["a19_jarque_bera"] = "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS x FROM lineitem WHERE {c} IS NOT NULL" for c in COLS) + "), m AS (SELECT c, avg(x) AS m FROM l GROUP BY c), p AS (SELECT c, count(*) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM l JOIN m USING (c) GROUP BY c), j AS (SELECT c, n, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM p) SELECT c AS \"column\", n, round(jb, 6) AS jb, round(exp(-jb / 2), 6) AS p_value FROM j"
add("a23_median_interval", lambda s, d: inference.median_interval(orders(s, d), ("o_totalprice", "cust"), "o_orderkey"), None)
add("a28_unit_root", lambda s, d: inference.unit_root_selected(hourly(s, d)).drop("tf"), None)


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """Parts as datasets in three sessions: parents some way back, some missing, some ahead, so that chains may close."""
    key, size = F.col("p_partkey"), F.col("p_size")
    parent = F.when(size % 10 == 0, None).when(key % 50 == 0, key + 3 * size).otherwise(key - 3 * size)
    return read(s, d, "part").select((key % 3).alias("session_id"), key.alias("dataset_id"), parent.cast("long").alias("parent_id"))


add(
    "s18_lineage", lambda s, d: preparation.dataset_lineage(_catalog(s, d)).select("session_id", "start_id", "depth", "dataset_id", "ended"),
    "WITH RECURSIVE c AS (SELECT p_partkey % 3 AS session_id, p_partkey AS dataset_id, CAST(CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_partkey % 50 = 0 THEN p_partkey + 3 * p_size ELSE p_partkey - 3 * p_size END AS BIGINT) AS parent_id FROM part),"
    " l AS (SELECT session_id, dataset_id AS start_id, dataset_id, parent_id, 0 AS depth, [CAST(dataset_id AS BIGINT)] AS path FROM c UNION ALL SELECT l.session_id, start_id, c.dataset_id, c.parent_id, depth + 1, list_append(path, CAST(c.dataset_id AS BIGINT)) FROM l JOIN c ON c.session_id = l.session_id AND c.dataset_id = l.parent_id WHERE NOT list_contains(path, l.parent_id)),"
    " e AS (SELECT l.session_id, start_id, CASE WHEN l.parent_id IS NULL THEN 'root' WHEN list_contains(path, l.parent_id) THEN 'cycle' ELSE 'missing' END AS ended FROM (SELECT *, row_number() OVER (PARTITION BY session_id, start_id ORDER BY depth DESC) AS k FROM l) l WHERE k = 1)"
    " SELECT l.session_id, l.start_id, depth, l.dataset_id, ended FROM l JOIN e ON e.session_id = l.session_id AND e.start_id = l.start_id",
)
add("a21_adaptive_information", lambda s, d: dependence.adaptive_mutual_information(lineitem(s, d), (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"))), None)
