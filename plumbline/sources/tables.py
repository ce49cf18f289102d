"""Driver tables and the adapters that make them look like usage, prices, telemetry, runs, clusters and code.

Each adapter exists twice, as a DataFrame and as the SQL of a CTE, so that a query and its oracle start from the same rows.
Readers prune columns: adapters are plain projections over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows any broadcast side may have, and the planner's size up to which rows need not be counted; larger sides are left to the planner.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if the planner knows it to be small (files, literals), or a bounded count shows ``rows`` rows or fewer."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES or df.limit(rows + 1).count() <= rows else df


USAGE_SQL = """usage AS (
  SELECT CAST(ts AS DATE) AS usage_date, ts AS usage_start_time, event_type AS sku_name, 'DBU' AS usage_unit,
    CASE event_type WHEN 'click' THEN 'JOBS' WHEN 'purchase' THEN 'SQL' WHEN 'signup' THEN '' WHEN 'view' THEN 'INTERACTIVE' END AS billing_origin_product,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'user' || CAST(user_id AS VARCHAR(20)) END AS run_as,
    CASE WHEN user_id % 14 = 0 THEN NULL ELSE 'maker' || CAST(user_id % 5 AS VARCHAR(20)) END AS created_by,
    CASE WHEN user_id % 28 = 0 THEN NULL ELSE 'owner' || CAST(user_id % 3 AS VARCHAR(20)) END AS owned_by,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 20 AS VARCHAR(20)) END AS job_id,
    CASE WHEN event_id % 40 < 20 THEN 'Job ' || CAST(event_id % 20 AS VARCHAR(20)) END AS job_name,
    CASE WHEN event_id % 11 = 0 THEN 'manual' ELSE CAST(event_id % 100 AS VARCHAR(20)) END AS job_run_id,
    CAST(value AS DECIMAL(18,2)) AS usage_quantity,
    CASE WHEN event_id % 50 = 0 THEN 'RETRACTION' ELSE 'ORIGINAL' END AS record_type, event_id
  FROM events)"""

PRICES = [
    ("click", "2023-01-01", "2024-01-15", "0.4000"), ("click", "2024-01-15", None, "0.4500"),
    ("view", "2023-01-01", "2024-01-15", "0.0700"), ("view", "2024-01-15", None, "0.0750"),
    ("purchase", "2023-01-01", "2024-01-15", "0.5500"), ("purchase", "2024-01-15", None, "0.7000"),
    ("signup", "2023-01-01", "2024-01-15", "0.1500"), ("signup", "2024-01-15", None, "0.2000"),
]
PRICES_SQL = (
    "list_prices(sku_name, usage_unit, price_start_time, price_end_time, price) AS (VALUES "
    + ", ".join(f"('{s}', 'DBU', TIMESTAMP '{a} 00:00:00', {f"TIMESTAMP '{b} 00:00:00'" if b else 'CAST(NULL AS TIMESTAMP)'}, CAST({p} AS DECIMAL(10,4)))" for s, a, b, p in PRICES)
    + ")"
)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {USAGE_SQL.replace('FROM events)', 'FROM {events})')} SELECT * FROM usage", events=table(spark, sf_dir, "events"))


def list_prices(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{s}', 'DBU', TIMESTAMP_NTZ '{a} 00:00:00', {f"TIMESTAMP_NTZ '{b} 00:00:00'" if b else 'CAST(NULL AS TIMESTAMP_NTZ)'}, CAST({p} AS DECIMAL(10,4)))" for s, a, b, p in PRICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(sku_name, usage_unit, price_start_time, price_end_time, price)")


#: "Now" of all telemetry questions, and the one user they leave out.
NOW, LEFT_OUT = "2024-01-30", "mid:71"
TELEMETRY_SQL = f"""telemetry AS (
  SELECT * FROM (
    SELECT ts, CAST(ts AS DATE) AS day, event_type AS name,
      CASE WHEN user_id % 4 = 0 THEN 'uid:' ELSE 'mid:' END || CAST(user_id * 10 + CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 7) AS BIGINT) AS VARCHAR(20)) AS user_key,
      'c' || CAST(user_id % 13 AS VARCHAR(20)) AS country, props, event_id
    FROM events) AS t
  WHERE user_key <> '{LEFT_OUT}')"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {TELEMETRY_SQL.replace('FROM events)', 'FROM {events})')} SELECT * FROM telemetry", events=table(spark, sf_dir, "events"))


CODE_LINES_SQL = """code_lines AS (
  SELECT doc_id AS file, CAST(i AS INTEGER) AS line, parts[i + 1] AS text
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole documents, numbered from 0."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a temporary one where that is unset and the master is local (tests)."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found.rstrip('/')}/plumbline/{uuid.uuid4().hex}" if found else f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
