"""Product telemetry: activity, retention, funnel and feature reports over events. A user is a machine id, else a user id."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import QUERIES, query
from ..sources.tables import NOW, TELEMETRY_SQL, telemetry

WITH = f"WITH {TELEMETRY_SQL}"
TODAY = f"DATE '{NOW}'"
FIRST_SQL = f"{WITH}, firsts AS (SELECT user_key, MIN(ts) AS first_seen, MIN(country) AS country FROM telemetry GROUP BY user_key)"
#: Names of the steps; deployments differ, so they are parameters.
FUNNEL = ("view", "click", "signup", "purchase")
FEATURES = ("click", "purchase", "signup")


def today() -> Column:
    return F.lit(NOW).cast("date")


def users(where: Column | None = None) -> Column:
    return F.countDistinct("user_key" if where is None else F.when(where, F.col("user_key")))


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).groupBy("user_key").agg(F.min("ts").alias("first_seen"), F.min("country").alias("country"))


@query(
    "dau",
    f"""{WITH} SELECT COUNT(DISTINCT CASE WHEN day = {TODAY} THEN user_key END) AS today, COUNT(DISTINCT CASE WHEN day = {TODAY} - 1 THEN user_key END) AS yesterday
FROM telemetry WHERE day >= {TODAY} - 1""",
)
def dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of today and of yesterday."""
    rows = telemetry(spark, sf_dir).filter(F.col("day") >= F.date_sub(today(), 1))
    return rows.agg(users(F.col("day") == today()).alias("today"), users(F.col("day") == F.date_sub(today(), 1)).alias("yesterday"))


@query("new_users_detail", f"{FIRST_SQL} SELECT * FROM firsts WHERE CAST(first_seen AS DATE) >= {TODAY} - 7")
def new_users_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users first seen in the last week."""
    return firsts(spark, sf_dir).filter(F.col("first_seen").cast("date") >= F.date_sub(today(), 7))


@query(
    "new_users_returned",
    f"""{FIRST_SQL} SELECT *, user_key IN (SELECT user_key FROM telemetry WHERE day > DATE '2024-01-23') AS came_back
FROM firsts WHERE CAST(first_seen AS DATE) BETWEEN DATE '2024-01-22' AND DATE '2024-01-23'""",
)
def new_users_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: whether new users of two days came back later: an existence join."""
    rows = telemetry(spark, sf_dir)
    later = rows.filter(F.col("day") > F.lit("2024-01-23").cast("date")).select(F.col("user_key").alias("back")).distinct()
    new = firsts(spark, sf_dir).filter(F.col("first_seen").cast("date").between(F.lit("2024-01-22").cast("date"), F.lit("2024-01-23").cast("date")))
    return new.join(later, new.user_key == later.back, "left").select("user_key", "first_seen", "country", F.col("back").isNotNull().alias("came_back"))


@query("install_trend", f"{FIRST_SQL} SELECT CAST(first_seen AS DATE) AS day, COUNT(*) AS installs FROM firsts WHERE CAST(first_seen AS DATE) > {TODAY} - 30 GROUP BY 1")
def install_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    days = firsts(spark, sf_dir).select(F.col("first_seen").cast("date").alias("day")).filter(F.col("day") > F.date_sub(today(), 30))
    return days.groupBy("day").agg(F.count("*").alias("installs"))


@query("wau_mau", f"{WITH} SELECT COUNT(DISTINCT CASE WHEN day > {TODAY} - 7 THEN user_key END) AS wau, COUNT(DISTINCT CASE WHEN day > {TODAY} - 30 THEN user_key END) AS mau FROM telemetry")
def wau_mau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional distinct counts."""
    return telemetry(spark, sf_dir).agg(users(F.col("day") > F.date_sub(today(), 7)).alias("wau"), users(F.col("day") > F.date_sub(today(), 30)).alias("mau"))


@query(
    "users_total",
    f"""{WITH} SELECT COUNT(DISTINCT user_key) AS users, COUNT(DISTINCT CASE WHEN starts_with(user_key, 'mid:') THEN user_key END) AS machines,
  COUNT(DISTINCT CASE WHEN starts_with(user_key, 'uid:') THEN user_key END) AS accounts FROM telemetry""",
)
def users_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7."""
    key = F.col("user_key")
    return telemetry(spark, sf_dir).agg(users().alias("users"), users(key.startswith("mid:")).alias("machines"), users(key.startswith("uid:")).alias("accounts"))


@query("top10_groups", f"{WITH} SELECT country, COUNT(DISTINCT user_key) AS users FROM telemetry GROUP BY country ORDER BY users DESC, country LIMIT 10")
def top10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten countries of most users."""
    return telemetry(spark, sf_dir).groupBy("country").agg(users().alias("users")).orderBy(F.desc("users"), "country").limit(10)


@query("prop_dist", f"{WITH} SELECT json_extract_string(props, '$.k') AS prop, COUNT(DISTINCT user_key) AS users FROM telemetry GROUP BY 1")
def prop_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by a property (version, operating system)."""
    return telemetry(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").alias("prop")).agg(users().alias("users"))


def _usage_sql(names: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""{WITH} SELECT replace(name, 'c', 'C') AS feature, COUNT(*) AS uses, COUNT(DISTINCT user_key) AS users,
  COUNT(DISTINCT CASE WHEN day > {TODAY} - 7 THEN user_key END) AS users_7d, COUNT(DISTINCT CASE WHEN day = {TODAY} THEN user_key END) AS users_today, MAX(ts) AS last_used
FROM telemetry WHERE name IN ({listed}) GROUP BY name"""


def usage_of(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Uses and users of some event names, and when each was used last."""
    found = rows.filter(F.col("name").isin(*names)).groupBy("name")
    out = found.agg(
        F.count("*").alias("uses"), users().alias("users"), users(F.col("day") > F.date_sub(today(), 7)).alias("users_7d"),
        users(F.col("day") == today()).alias("users_today"), F.max("ts").alias("last_used"),
    )
    return out.select(F.replace("name", F.lit("c"), F.lit("C")).alias("feature"), "uses", "users", "users_7d", "users_today", "last_used")


@query("feature_usage", _usage_sql(FEATURES))
def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11."""
    return usage_of(telemetry(spark, sf_dir), FEATURES)


@query("mcp_usage", _usage_sql(("view", "error")))
def mcp_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over other names."""
    return usage_of(telemetry(spark, sf_dir), ("view", "error"))


@query("hour_heatmap", f"{WITH} SELECT CAST(EXTRACT(HOUR FROM ts + INTERVAL '330 minutes') AS INTEGER) AS hour, COUNT(*) AS events FROM telemetry GROUP BY 1")
def hour_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the day at a fixed offset of five and a half hours."""
    return telemetry(spark, sf_dir).groupBy(F.hour(F.col("ts") + F.expr("INTERVAL 330 MINUTES")).alias("hour")).agg(F.count("*").alias("events"))


@query("dow_pattern", f"{WITH} SELECT CAST(EXTRACT(DOW FROM ts) AS INTEGER) AS dow, COUNT(*) AS events FROM telemetry GROUP BY 1")
def dow_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the week, Sunday 0."""
    return telemetry(spark, sf_dir).groupBy((F.dayofweek("ts") - 1).alias("dow")).agg(F.count("*").alias("events"))


@query("error_trend", f"{WITH} SELECT day, COUNT(DISTINCT user_key) AS users, COUNT(*) FILTER (WHERE contains(name, 'fail') OR contains(name, 'error')) AS errors FROM telemetry GROUP BY day")
def error_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14."""
    bad = F.col("name").contains("fail") | F.col("name").contains("error")
    return telemetry(spark, sf_dir).groupBy("day").agg(users().alias("users"), F.count_if(bad).alias("errors"))


@query(
    "d1_retention",
    f"""{FIRST_SQL}, active AS (SELECT DISTINCT user_key, day FROM telemetry)
SELECT cohort, COUNT(DISTINCT f.user_key) AS users, COUNT(DISTINCT CASE WHEN a.day = cohort + 1 THEN f.user_key END) AS returned,
  ROUND(100.0 * COUNT(DISTINCT CASE WHEN a.day = cohort + 1 THEN f.user_key END) / COUNT(DISTINCT f.user_key), 1) AS percent
FROM (SELECT user_key, CAST(first_seen AS DATE) AS cohort FROM firsts) AS f LEFT JOIN active a ON f.user_key = a.user_key GROUP BY cohort""",
)
def d1_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each day's new users who are back the next day. First day and next-day visit come from one grouping by user."""
    days = telemetry(spark, sf_dir).select("user_key", "day").distinct()
    per = days.groupBy("user_key").agg(F.min("day").alias("cohort"), F.collect_set("day").alias("days"))  # days of one user: bounded by the calendar
    back = per.select("cohort", F.array_contains("days", F.date_add("cohort", 1)).alias("back"))
    out = back.groupBy("cohort").agg(F.count("*").alias("users"), F.count_if("back").alias("returned"))
    return out.withColumn("percent", F.round(F.lit(100.0) * F.col("returned") / F.col("users"), 1))


@query(
    "churn_trend",
    f"""{WITH}, lasts AS (SELECT user_key, MAX(day) AS last_day FROM telemetry GROUP BY user_key)
SELECT CAST(last_day - CAST(EXTRACT(DOW FROM last_day) AS INTEGER) AS DATE) AS week, COUNT(*) AS users, COUNT(*) FILTER (WHERE {TODAY} - last_day > 14) AS churned FROM lasts GROUP BY 1""",
)
def churn_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the week they were last seen in (weeks start on Sunday), and those gone for over two weeks."""
    lasts = telemetry(spark, sf_dir).groupBy("user_key").agg(F.max("day").alias("last_day"))
    week = F.date_sub("last_day", F.dayofweek("last_day") - 1).alias("week")
    return lasts.groupBy(week).agg(F.count("*").alias("users"), F.count_if(F.datediff(today(), "last_day") > 14).alias("churned"))


FUNNEL_SQL = ", ".join(f"COUNT(DISTINCT CASE WHEN name = '{n}' THEN user_key END) AS step{i}" for i, n in enumerate(FUNNEL, 1))


@query("funnel", f"{WITH} SELECT {FUNNEL_SQL} FROM telemetry")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each step, one row."""
    return telemetry(spark, sf_dir).agg(*[users(F.col("name") == n).alias(f"step{i}") for i, n in enumerate(FUNNEL, 1)])


@query(
    "funnel_pct",
    f"""{WITH}, steps AS (SELECT name AS step, COUNT(DISTINCT user_key) AS users FROM telemetry WHERE name IN {FUNNEL} GROUP BY name)
SELECT step, users, CAST(FLOOR(100 * users / (SELECT MAX(users) FROM steps)) AS BIGINT) AS percent, CAST(FLOOR(20 * users / (SELECT MAX(users) FROM steps)) AS BIGINT) AS bar FROM steps""",
)
def funnel_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as floored percentages of, and bars scaled to, the widest."""
    steps = telemetry(spark, sf_dir).filter(F.col("name").isin(*FUNNEL)).groupBy(F.col("name").alias("step")).agg(users().alias("users"))
    most = steps.agg(F.max("users").alias("most"))  # one row
    part = lambda n: F.floor(F.lit(n) * F.col("users") / F.col("most"))
    return steps.crossJoin(F.broadcast(most)).select("step", "users", part(100).alias("percent"), part(20).alias("bar"))


def fan_out(spark: SparkSession, sf_dir: str, names: list[str], threads: int = 10) -> dict[str, list | Exception]:
    """Run several reports at once on one session; a failing report gives its error and spoils no other."""

    def one(name: str) -> list | Exception:
        try:
            return QUERIES[name](spark, sf_dir).collect()
        except Exception as error:  # reported to the caller, by name
            return error

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(names, pool.map(one, names), strict=True))
