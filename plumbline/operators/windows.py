"""Windows, sorts, limits and exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import shared_folder, table

BY_DATE = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _own() -> Window:
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@query("win_row_number", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER ({BY_DATE}) AS INTEGER) AS k FROM orders")
def win_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered inside each customer."""
    return _orders(spark, sf_dir).select("o_orderkey", F.row_number().over(_own()).alias("k"))


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers over the whole table without one partition holding it: rows are range partitioned and numbered in place, and the
    sizes of earlier ranges (one row a range) are added. ``order`` has to be unique.

    The ranges are written to shared storage once: range bounds are sampled, and a second evaluation may draw others.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    folder = shared_folder(spark)
    ranged.write.parquet(folder)
    ranged = spark.read.schema(ranged.schema).parquet(folder)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


@query("win_global", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders")
def win_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number over all rows. A plain global window would put them all into one task; this does not."""
    return global_rank(_orders(spark, sf_dir).select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "k").select("o_orderkey", "k")


@query(
    "win_rank_family",
    """SELECT o_orderkey, CAST(RANK() OVER w AS INTEGER) AS rnk, CAST(DENSE_RANK() OVER w AS INTEGER) AS dense, ROUND(PERCENT_RANK() OVER w, 6) AS pct, ROUND(CUME_DIST() OVER w, 6) AS cume
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
def win_rank_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return _orders(spark, sf_dir).select("o_orderkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"))


@query("win_lag_lead", f"SELECT o_orderkey, LAG(o_orderkey) OVER w AS before, LEAD(o_orderkey, 2, -1) OVER w AS after FROM orders WINDOW w AS ({BY_DATE})")
def win_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return _orders(spark, sf_dir).select("o_orderkey", F.lag("o_orderkey").over(_own()).alias("before"), F.lead("o_orderkey", 2, -1).over(_own()).alias("after"))


@query("win_ntile_dist", f"SELECT quarter, COUNT(*) AS n FROM (SELECT CAST(NTILE(4) OVER ({BY_DATE}) AS INTEGER) AS quarter FROM orders) AS t GROUP BY quarter")
def win_ntile_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return _orders(spark, sf_dir).select(F.ntile(4).over(_own()).alias("quarter")).groupBy("quarter").agg(F.count("*").alias("n"))


FRAMES = {"back": (-5, 0), "around": (-4, 4), "wide": (-5, 10), "ahead": (0, 15)}


def _bound(n: int) -> str:
    return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


@query("win_rows_frame", "SELECT o_orderkey, " + ", ".join(f"CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({BY_DATE} ROWS BETWEEN {_bound(a)} AND {_bound(b)}) AS DOUBLE) AS {k}" for k, (a, b) in FRAMES.items()) + " FROM orders")
def win_rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four row frames that context rules look through."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return _orders(spark, sf_dir).select("o_orderkey", *[F.sum(price).over(_own().rowsBetween(a, b)).cast("double").alias(k) for k, (a, b) in FRAMES.items()])


@query("win_range_frame", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS last_day FROM events")
def win_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame in time."""
    w = "COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day"
    return table(spark, sf_dir, "events").selectExpr("event_id", w)


@query("sort_global", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: a total order over range partitions."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("sort_within_partitions", "SELECT c_custkey, c_nationkey FROM customer")
def sort_within_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: sorted runs a nation apart, as a writer wants them; the rows are the same."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")


@query("limit_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-N by a total order; each task keeps 25 rows."""
    return _orders(spark, sf_dir).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("sample_rows")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded tenth (which rows it holds depends on the layout of the files: no oracle)."""
    return _orders(spark, sf_dir).sample(fraction=0.1, seed=7)


@query("exchange_hash", "SELECT o_custkey, COUNT(*) AS n, MAX(o_orderkey) AS last_order FROM orders GROUP BY o_custkey")
def exchange_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit exchange that the aggregate after it reuses: one exchange in all."""
    return _orders(spark, sf_dir).select("o_custkey", "o_orderkey").repartition("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))


@query("exchange_round_robin", "SELECT p_partkey, p_size FROM part")
def exchange_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly dealt rows."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(6)


@query("coalesce_semantics", "SELECT n_nationkey, n_name FROM nation")
def coalesce_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer partitions without an exchange, for a table of fixed size."""
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1)
