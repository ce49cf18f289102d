"""Joins: every strategy and type, each on keys that the tables really share. Strategy tests look at the plans in tests/."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import small, table

CENTS = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def cents(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


PER_NATION = f"SELECT n_name, COUNT(*) AS orders, {CENTS.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query("join_broadcast", PER_NATION)
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions are broadcast behind a check of their size; orders never move before the aggregate."""
    nation = small(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    customers = small(_customers(spark, sf_dir).select("c_custkey", "c_nationkey"))
    rows = _orders(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), cents("o_totalprice").alias("total"))


@query("join_then_global", f"SELECT COUNT(*) AS orders, {CENTS.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_then_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broadcast join under a global aggregate; partial sums keep the last exchange to a row a task."""
    some = small(_customers(spark, sf_dir).filter("c_mktsegment = 'BUILDING'").select("c_custkey"))
    return _orders(spark, sf_dir).join(some, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("orders"), cents("o_totalprice").alias("total"))


def _hinted(hint: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        right = _customers(spark, sf_dir).select("c_custkey", "c_name").hint(hint)
        return _orders(spark, sf_dir).select("o_orderkey", "o_custkey").join(right, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")

    return run


for _name, _hint in (("join_sortmerge", "merge"), ("join_shuffle_hash", "shuffle_hash")):  # J3, J5
    query(_name, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(_hinted(_hint))


@query("join_small_side", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_small_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side is small is read off the optimizer's statistics, not guessed; no hint is given."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("join_cartesian", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of two fixed dimensions (5 and 25 rows at any scale), as a Cartesian product."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name").hint("shuffle_replicate_nl"))


@query("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross join against a broadcast dimension of fixed size."""
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("a")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("b"))))


BANDS = [(0, 50_000.0), (50_000.0, 150_000.0), (150_000.0, 300_000.0)]
BANDS_SQL = ", ".join(f"({i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for i, (lo, hi) in enumerate(BANDS))


@query("join_theta", f"SELECT band, COUNT(*) AS orders FROM orders JOIN (VALUES {BANDS_SQL}) AS b(band, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a range alone, against a literal table."""
    bands = spark.sql(f"SELECT * FROM VALUES {BANDS_SQL} AS b(band, lo, hi)")
    rows = _orders(spark, sf_dir).join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi")))
    return rows.groupBy("band").agg(F.count("*").alias("orders"))


def _outer(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rich = _customers(spark, sf_dir).filter("c_acctbal > 5000").select("c_custkey", "c_acctbal")
        late = _orders(spark, sf_dir).filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
        joined = rich.join(late, F.col("c_custkey") == F.col("o_custkey"), how)
        return joined if how in ("left", "right", "full") else joined.select("c_custkey", "c_acctbal")

    return run


_SIDES = "(SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000) AS c {} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P') AS o ON c_custkey = o_custkey"
for _how in ("left", "right", "full"):  # J10, J11
    query(f"join_{_how}", f"SELECT * FROM {_SIDES.format(_how.upper())}")(_outer(_how))
for _how in ("semi", "anti"):
    query(f"join_{_how}", f"SELECT c_custkey, c_acctbal FROM {_SIDES.format(_how.upper())}")(_outer(_how))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, value: str, bucket=None) -> DataFrame:
    """Each left row with ``value`` of the latest right row at or before it: one sorted pass over the union of both sides.

    ``bucket`` gives a coarse, increasing number of a place in time; rows are then dealt by key and bucket, so a key that holds a
    third of all rows is spread over its buckets, and what a bucket starts with comes from one row a key and earlier bucket.
    """
    bucket = bucket or (lambda c: F.lit(0))
    cols = left.columns
    a = left.select("*", F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(*by, "__bucket").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__bucket", bucket(F.col("__at"))).withColumn("__own", F.last("__value", ignorenulls=True).over(w)).filter("__side = 1")
    ends = right.filter(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(f"__{c}") for c in by], bucket(F.col(right_on)).alias("__b")).agg(F.max_by(value, right_on).alias("__end"))
    # one row a key and bucket: what the buckets before it end with
    marks = both.filter("__own IS NULL").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__b")).distinct()
    earlier = Window.partitionBy(*[f"__{c}" for c in by]).orderBy(F.col("__b").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    ends = marks.withColumn("__end", F.lit(None).cast(right.schema[value].dataType)).withColumn("__asks", F.lit(True)).unionByName(ends.withColumn("__asks", F.lit(False)))
    start = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(earlier)).filter("__asks")
    start = start.select(*[F.col(f"__{c}").alias(f"__s_{c}") for c in by], F.col("__b").alias("__s_bucket"), F.col("__start").alias("__end"))
    joined = both.join(start, [*[F.col(c) == F.col(f"__s_{c}") for c in by], F.col("__bucket") == F.col("__s_bucket"), F.col("__own").isNull()], "left")
    return joined.select(*cols, F.coalesce("__own", "__end").alias(value))


@query(
    "join_asof",
    """SELECT e.event_id, e.user_id, p.value AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') AS e
ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) AS p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the value of its user's latest purchase."""
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return asof(clicks, bought, ["user_id"], "ts", "ts", "last_purchase", lambda t: F.datediff(t, F.lit("1970-01-01"))).select("event_id", "user_id", "last_purchase")
