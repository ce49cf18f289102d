"""Spend: priced usage and its summaries. Money is summed exactly, as decimals, and returned as doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import PRICES_SQL, USAGE_SQL, list_prices, small, usage

START, END = "2024-01-05", "2024-01-25"
JOB, RUN, RUN_DATE = "7", 47, "2024-01-12"
NO_IDENTITY, UNKNOWN = "(no identity)", "UNKNOWN"


def priced(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, prices: DataFrame | None = None) -> DataFrame:
    """Usage with the price valid at its start, null where there is none: equal keys and a half-open interval as the residual.

    The price list is broadcast while it is small, so usage is neither shuffled nor sorted.
    """
    u, p = (usage(spark, sf_dir) if rows is None else rows).alias("u"), small(list_prices(spark) if prices is None else prices).alias("p")
    valid = (F.col("u.usage_start_time") >= F.col("p.price_start_time")) & (F.col("p.price_end_time").isNull() | (F.col("u.usage_start_time") < F.col("p.price_end_time")))
    same = (F.col("u.sku_name") == F.col("p.sku_name")) & (F.col("u.usage_unit") == F.col("p.usage_unit"))
    return u.join(p, same & valid, "left").select("u.*", "p.price")


def dollars() -> Column:
    return F.sum(F.col("usage_quantity") * F.coalesce("price", F.lit(0).cast("decimal(10,4)"))).cast("double")


def dbus() -> Column:
    return F.sum("usage_quantity").cast("double")


PRICED_SQL = f"""WITH {USAGE_SQL}, {PRICES_SQL}, priced AS (
  SELECT u.*, p.price FROM usage u LEFT JOIN list_prices p ON u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit
    AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time))"""
DOLLARS_SQL = "CAST(SUM(usage_quantity * COALESCE(price, 0)) AS DOUBLE)"
BILLING_SQL = f"""{PRICED_SQL}, billing AS (
  SELECT usage_date, billing_origin_product AS workload_type, COALESCE(run_as, created_by, owned_by) AS run_as, job_id, MAX(job_name) AS job_name, sku_name,
    CAST(SUM(usage_quantity) AS DOUBLE) AS dbus, {DOLLARS_SQL} AS dollars
  FROM priced WHERE usage_date BETWEEN DATE '{START}' AND DATE '{END}' AND record_type = 'ORIGINAL'
  GROUP BY usage_date, billing_origin_product, COALESCE(run_as, created_by, owned_by), job_id, sku_name)"""


@query("billing_rows", f"{BILLING_SQL} SELECT * FROM billing")
def billing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: priced usage by date, workload, identity, job and sku. Job names agree within a job, so their greatest is any of them."""
    keep = F.col("usage_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")) & (F.col("record_type") == "ORIGINAL")
    keys = ["usage_date", F.col("billing_origin_product").alias("workload_type"), F.coalesce("run_as", "created_by", "owned_by").alias("run_as"), "job_id", "sku_name"]
    return priced(spark, sf_dir).filter(keep).groupBy(*keys).agg(F.max("job_name").alias("job_name"), dbus().alias("dbus"), dollars().alias("dollars"))


@query("billing_total", f"{PRICED_SQL} SELECT {DOLLARS_SQL} AS dollars, CAST(SUM(usage_quantity) AS DOUBLE) AS dbus FROM priced WHERE record_type = 'ORIGINAL'")
def billing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the whole account's cost."""
    return priced(spark, sf_dir).filter("record_type = 'ORIGINAL'").agg(dollars().alias("dollars"), dbus().alias("dbus"))


@query(
    "job_run_cost",
    f"""{PRICED_SQL}, sums AS (
  SELECT {DOLLARS_SQL.replace('SUM(', f"SUM(CASE WHEN TRY_CAST(job_run_id AS BIGINT) = {RUN} THEN 1 ELSE 0 END * ")} AS exact,
    {DOLLARS_SQL.replace('SUM(', f"SUM(CASE WHEN usage_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-14' THEN 1 ELSE 0 END * ")} AS near
  FROM priced WHERE job_id = '{JOB}' AND record_type = 'ORIGINAL')
SELECT COALESCE(NULLIF(exact, 0), near) AS dollars, NULLIF(exact, 0) IS NULL AS approximate FROM sums""",
)
def job_run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a run's cost by its id, or by its job from a day before to two days after; one pass with two conditional sums."""
    rows = usage(spark, sf_dir).filter((F.col("job_id") == JOB) & (F.col("record_type") == "ORIGINAL"))
    cost = F.col("usage_quantity") * F.coalesce("price", F.lit(0).cast("decimal(10,4)"))
    day = F.lit(RUN_DATE).cast("date")
    exact = F.sum(F.when(F.expr(f"try_cast(job_run_id AS bigint) = {RUN}"), cost).otherwise(0)).cast("double")
    near = F.sum(F.when(F.col("usage_date").between(F.date_sub(day, 1), F.date_add(day, 2)), cost).otherwise(0)).cast("double")
    sums = priced(spark, sf_dir, rows).agg(exact.alias("exact"), near.alias("near"))
    return sums.select(F.coalesce(F.nullif("exact", F.lit(0.0)), "near").alias("dollars"), F.nullif("exact", F.lit(0.0)).isNull().alias("approximate"))


@query("run_dbus", f"WITH {USAGE_SQL} SELECT job_run_id, ROUND(CAST(SUM(usage_quantity) AS DOUBLE), 6) AS dbus, MIN(usage_unit) AS unit, MIN(sku_name) AS sku FROM usage WHERE job_run_id IS NOT NULL GROUP BY job_run_id")
def run_dbus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: units used by each run; older schemas name the run ``run_id``. The sku is the least of the run's, not any."""
    rows = usage(spark, sf_dir)
    run = "job_run_id" if "job_run_id" in rows.columns else "run_id"
    return rows.filter(F.col(run).isNotNull()).groupBy(F.col(run).alias("job_run_id")).agg(F.round(dbus(), 6).alias("dbus"), F.min("usage_unit").alias("unit"), F.min("sku_name").alias("sku"))


@query(
    "usage_daily",
    f"""WITH {USAGE_SQL}, daily AS (SELECT usage_date, sku_name, usage_unit, CAST(SUM(usage_quantity) AS DOUBLE) AS quantity FROM usage
  WHERE usage_date > DATE '2024-01-23' GROUP BY usage_date, sku_name, usage_unit)
SELECT *, CASE WHEN contains(usage_unit, 'DBU') THEN ROUND(quantity * 0.4, 6) ELSE 0 END AS cost, ROUND(SUM(quantity) OVER () * 0.4, 4) AS total_cost FROM daily""",
)
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week by day and sku. A row costs something only if its unit is a DBU; the total prices every unit."""
    rows = usage(spark, sf_dir).filter(F.col("usage_date") > F.lit("2024-01-23").cast("date"))
    daily = rows.groupBy("usage_date", "sku_name", "usage_unit").agg(dbus().alias("quantity"))
    total = daily.agg(F.round(F.sum("quantity") * 0.4, 4).alias("total_cost"))  # one row
    cost = F.when(F.col("usage_unit").contains("DBU"), F.round(F.col("quantity") * 0.4, 6)).otherwise(0.0)
    return daily.withColumn("cost", cost).crossJoin(F.broadcast(total))


def _exact(column: str, name: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,6)")).cast("double").alias(name)


EXACT_SQL = "CAST(SUM(CAST(dollars AS DECIMAL(18,6))) AS DOUBLE) AS dollars, CAST(SUM(CAST(dbus AS DECIMAL(18,6))) AS DOUBLE) AS dbus"


def summed(rows: DataFrame, *keys: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(_exact("dollars", "dollars"), _exact("dbus", "dbus"))


@query("spend_totals", f"{BILLING_SQL} SELECT {EXACT_SQL}, COUNT(*) AS n_rows FROM billing")
def spend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1."""
    return billing_rows(spark, sf_dir).agg(_exact("dollars", "dollars"), _exact("dbus", "dbus"), F.count("*").alias("n_rows"))


@query("spend_by_user", f"{BILLING_SQL} SELECT COALESCE(NULLIF(run_as, ''), '{NO_IDENTITY}') AS run_as, {EXACT_SQL} FROM billing GROUP BY 1 ORDER BY dollars DESC, run_as LIMIT 10")
def spend_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the ten costliest identities."""
    name = F.coalesce(F.nullif("run_as", F.lit("")), F.lit(NO_IDENTITY)).alias("run_as")
    return summed(billing_rows(spark, sf_dir), name).orderBy(F.desc("dollars"), "run_as").limit(10)


@query("spend_by_workload", f"{BILLING_SQL} SELECT COALESCE(NULLIF(workload_type, ''), '{UNKNOWN}') AS workload_type, {EXACT_SQL} FROM billing GROUP BY 1 ORDER BY dollars DESC, workload_type LIMIT 10")
def spend_by_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3."""
    name = F.coalesce(F.nullif("workload_type", F.lit("")), F.lit(UNKNOWN)).alias("workload_type")
    return summed(billing_rows(spark, sf_dir), name).orderBy(F.desc("dollars"), "workload_type").limit(10)


@query(
    "spend_by_job",
    f"""{BILLING_SQL} SELECT job_id, COALESCE(MAX(job_name) FILTER (WHERE usage_date = last_named), 'Job ' || job_id) AS job_name, {EXACT_SQL}
FROM (SELECT *, MAX(CASE WHEN job_name IS NOT NULL THEN usage_date END) OVER (PARTITION BY job_id) AS last_named FROM billing WHERE job_id IS NOT NULL AND job_id <> '') AS b
GROUP BY job_id ORDER BY dollars DESC, job_id LIMIT 10""",
)
def spend_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the latest name wins (of one day's, the greatest), else the job's number."""
    rows = billing_rows(spark, sf_dir).filter("job_id IS NOT NULL AND job_id <> ''")
    latest = F.max(F.when(F.col("job_name").isNotNull(), F.struct("usage_date", "job_name")))["job_name"]
    out = rows.groupBy("job_id").agg(latest.alias("name"), _exact("dollars", "dollars"), _exact("dbus", "dbus"))
    return out.select("job_id", F.coalesce("name", F.concat(F.lit("Job "), "job_id")).alias("job_name"), "dollars", "dbus").orderBy(F.desc("dollars"), "job_id").limit(10)


@query("spend_daily", f"{BILLING_SQL} SELECT usage_date, {EXACT_SQL} FROM billing GROUP BY usage_date")
def spend_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5."""
    return summed(billing_rows(spark, sf_dir), F.col("usage_date")).orderBy("usage_date")


@query(
    "period_ranges",
    """SELECT d AS today, period, CAST(d - CAST(days AS INTEGER) AS DATE) AS start_date, d AS end_date
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) AS t CROSS JOIN (VALUES ('day', 1), ('week', 7), ('month', 30)) AS p(period, days)""",
)
def period_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: first and last day of the day, week and month up to each day."""
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("date").alias("today")).distinct()
    spans = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(n).alias("days")) for p, n in (("day", 1), ("week", 7), ("month", 30))])
    each = days.select("today", F.inline(spans))
    return each.select("today", "period", F.date_sub("today", F.col("days")).alias("start_date"), F.col("today").alias("end_date"))


def period_of(start: Column, end: Column) -> Column:
    """M6 reversed: the label of a range by its length in days."""
    days = F.datediff(end, start)
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 30, "month").otherwise("custom")


@query(
    "preference_pick",
    """SELECT s_nationkey, arg_min(s_suppkey, (tier, s_suppkey)) AS picked, CAST(MIN(tier) AS INTEGER) AS tier FROM (
  SELECT *, CASE WHEN s_suppkey % 4 = 0 AND s_acctbal > 0 THEN 1 WHEN s_suppkey % 4 = 0 THEN 2 WHEN s_acctbal > 0 THEN 3 ELSE 4 END AS tier FROM supplier) AS s GROUP BY s_nationkey""",
)
def preference_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the best of four tiers (serverless and running, serverless, running, any), then the least id. Suppliers stand for warehouses."""
    serverless, running = F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") > 0
    tier = F.when(serverless & running, 1).when(serverless, 2).when(running, 3).otherwise(4)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", "s_suppkey", tier.alias("tier"))
    return rows.groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("tier", "s_suppkey")).alias("picked"), F.min("tier").alias("tier"))
