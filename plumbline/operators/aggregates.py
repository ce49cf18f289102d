"""Aggregations: hash, sort and object aggregates, statistics, distinct counts, grouping sets and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table
from .joins import CENTS, cents


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query(
    "agg_hash",
    f"""SELECT l_returnflag, l_linestatus, {CENTS.format('l_quantity')} AS quantity, {CENTS.format('l_extendedprice')} AS price, ROUND(AVG(l_discount), 6) AS discount, COUNT(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-01 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
def agg_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: partial and final hash aggregate around one exchange of a row a group and task."""
    rows = _lines(spark, sf_dir).filter(F.col("l_shipdate") <= F.lit("2000-09-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(cents("l_quantity").alias("quantity"), cents("l_extendedprice").alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("agg_sort", "SELECT o_orderstatus, MAX(o_orderpriority) AS last_priority, MIN(o_orderpriority) AS first_priority FROM orders GROUP BY o_orderstatus")
def agg_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String buffers cannot be updated in place, which makes the planner sort."""
    return _orders(spark, sf_dir).groupBy("o_orderstatus").agg(F.max("o_orderpriority").alias("last_priority"), F.min("o_orderpriority").alias("first_priority"))


@query("agg_object_hash", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY c_nationkey")
def agg_object_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of a column of few values."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("agg_first_deterministic", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def agg_first_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first`` depends on the order rows arrive in; the least by date and key does not."""
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("agg_global", f"SELECT COUNT(*) AS n, {CENTS.format('l_extendedprice')} AS price, MAX(l_shipdate) AS last_shipped FROM lineitem")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row; only partial results meet in the single partition."""
    return _lines(spark, sf_dir).agg(F.count("*").alias("n"), cents("l_extendedprice").alias("price"), F.max("l_shipdate").alias("last_shipped"))


STATS = {
    "avg_": ("AVG(x)", lambda x, y: F.avg(x)), "mean_": ("AVG(x)", lambda x, y: F.mean(x)),
    "stddev_": ("STDDEV_SAMP(x)", lambda x, y: F.stddev(x)), "stddev_samp_": ("STDDEV_SAMP(x)", lambda x, y: F.stddev_samp(x)), "stddev_pop_": ("STDDEV_POP(x)", lambda x, y: F.stddev_pop(x)),
    "variance_": ("VAR_SAMP(x)", lambda x, y: F.variance(x)), "var_samp_": ("VAR_SAMP(x)", lambda x, y: F.var_samp(x)), "var_pop_": ("VAR_POP(x)", lambda x, y: F.var_pop(x)),
    "corr_": ("CORR(x, y)", lambda x, y: F.corr(x, y)), "covar_pop_": ("COVAR_POP(x, y)", lambda x, y: F.covar_pop(x, y)), "covar_samp_": ("COVAR_SAMP(x, y)", lambda x, y: F.covar_samp(x, y)),
    "skewness_": ("((SUM(pow(x, 3)) / COUNT(x) - 3 * AVG(x) * VAR_POP(x) - pow(AVG(x), 3)) / pow(STDDEV_POP(x), 3))", lambda x, y: F.skewness(x)),
    "kurtosis_": ("KURTOSIS_POP(x)", lambda x, y: F.kurtosis(x)),
}


@query("agg_stats", f"SELECT o_orderpriority, {', '.join(f'ROUND({sql}, 3) AS {k}' for k, (sql, _) in STATS.items())} FROM (SELECT o_orderpriority, o_totalprice / 100000 AS x, CAST(o_custkey AS DOUBLE) / 1000 AS y FROM orders) AS t GROUP BY o_orderpriority")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and correlations, all in one pass of mergeable buffers."""
    rows = _orders(spark, sf_dir).select("o_orderpriority", (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_custkey").cast("double") / 1000).alias("y"))
    return rows.groupBy("o_orderpriority").agg(*[F.round(f("x", "y"), 3).alias(k) for k, (_, f) in STATS.items()])


@query("agg_percentile")
def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate quartiles (a sketch: no oracle)."""
    return _orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", [0.25, 0.5, 0.75], 1000).alias("quartiles"))


@query("agg_sum_distinct", "SELECT l_returnflag, CAST(SUM(DISTINCT CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_sum_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct aggregates over different columns; the planner expands rows and aggregates in two levels."""
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.sum_distinct(F.col("l_quantity").cast("bigint")).alias("quantity"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg_approx_distinct")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch of fixed size a group instead of an exact distinct count (no oracle)."""
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("distinct_all", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return _lines(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("dedupe_subset", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) AS t WHERE k = 1")
def dedupe_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key, and a stated one: the latest. As an aggregate, so that rows are combined before the exchange."""
    best = F.min_by(F.struct("o_orderkey", "o_orderdate"), F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_orderdate")


GROUPED = ("o_orderstatus", "o_orderpriority")
_SUMS = f"COUNT(*) AS n, {CENTS.format('o_totalprice')} AS total, CAST(GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS INTEGER) AS level"


def _levels(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), cents("o_totalprice").alias("total"), F.grouping_id().cast("int").alias("level"))


@query("agg_rollup", f"SELECT o_orderstatus, o_orderpriority, {_SUMS} FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return _levels(_orders(spark, sf_dir).rollup(*GROUPED))


@query("agg_cube", f"SELECT o_orderstatus, o_orderpriority, {_SUMS} FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return _levels(_orders(spark, sf_dir).cube(*GROUPED))


@query("agg_grouping_sets", f"SELECT o_orderstatus, o_orderpriority, {_SUMS} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets that are asked for and no other."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return _levels(_orders(spark, sf_dir).groupingSets([[status], [priority], []], status, priority))


_PIVOT = ", ".join(f"COUNT(*) FILTER (WHERE l_linestatus = '{s}') AS n_{s}" for s in "FO")


@query("agg_pivot", f"SELECT l_returnflag, {_PIVOT} FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot over stated values, so that no job runs to find them."""
    out = _lines(spark, sf_dir).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", *[F.coalesce(s, F.lit(0)).alias(f"n_{s}") for s in "FO"])


@query("agg_having", "SELECT o_custkey, COUNT(*) AS orders FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("orders")).filter("orders >= 12")


@query("agg_collect", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a fixed dimension, in order."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


@query("session_window", """SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL '12 hours' AS session_end, COUNT(*) AS events FROM (
  SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events) AS a) AS b GROUP BY user_id, session""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after twelve quiet hours."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = rows.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events")


