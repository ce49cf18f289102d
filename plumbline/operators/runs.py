"""Runs, jobs, clusters and bundle tasks. Orders stand for runs, customers for jobs, suppliers for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import small, table

RUNS_SQL = """runs AS (SELECT o_custkey AS job_id, o_orderkey AS run_id, o_orderdate AS started, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey % 5000 END AS took_ms, o_orderstatus AS state,
  CASE WHEN o_orderkey % 3 = 0 THEN 'task-' || CAST(o_orderkey % 7 AS VARCHAR(20)) END AS task_cluster, CASE WHEN o_orderkey % 4 = 0 THEN 'job-' || CAST(o_orderkey % 5 AS VARCHAR(20)) END AS job_cluster,
  CASE WHEN o_orderkey % 5 = 0 THEN 'spec-1' END AS spec_cluster FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {RUNS_SQL.replace('FROM orders)', 'FROM {orders})')} SELECT * FROM runs", orders=table(spark, sf_dir, "orders"))


@query("last_run_per_job", f"WITH {RUNS_SQL} SELECT job_id, arg_max(run_id, (started, run_id)) AS run_id, arg_max(state, (started, run_id)) AS state, MAX(started) AS started FROM runs GROUP BY job_id")
def last_run_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate, so that each task sends one row a job."""
    last = F.max_by(F.struct("run_id", "state"), F.struct("started", "run_id")).alias("last")
    return runs(spark, sf_dir).groupBy("job_id").agg(last, F.max("started").alias("started")).select("job_id", "last.run_id", "last.state", "started")


@query("run_summary", f"WITH {RUNS_SQL} SELECT run_id, NULLIF(took_ms, 0) AS duration_ms, COALESCE(task_cluster, job_cluster, spec_cluster, 'none') AS cluster_id FROM runs")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An end of 0 means that the run has not ended."""
    return runs(spark, sf_dir).select("run_id", F.nullif("took_ms", F.lit(0)).alias("duration_ms"), F.coalesce("task_cluster", "job_cluster", "spec_cluster", F.lit("none")).alias("cluster_id"))


CLUSTERS_SQL = """clusters AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS name, CASE s_suppkey % 4 WHEN 0 THEN 'JOB' WHEN 1 THEN 'UI' WHEN 2 THEN 'MODELS' END AS source, n_name AS zone FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("interactive_clusters", f"WITH {CLUSTERS_SQL} SELECT id, COALESCE(NULLIF(name, ''), 'cluster ' || CAST(id AS VARCHAR)) AS name, zone FROM clusters WHERE source IS NULL OR source NOT IN ('JOB', 'MODELS')")
def interactive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing source counts as interactive."""
    nation = small(table(spark, sf_dir, "nation"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    source = F.when(F.col("s_suppkey") % 4 == 0, "JOB").when(F.col("s_suppkey") % 4 == 1, "UI").when(F.col("s_suppkey") % 4 == 2, "MODELS")
    name = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("cluster "), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_name"))
    return s.filter(source.isNull() | ~source.isin("JOB", "MODELS")).select(F.col("s_suppkey").alias("id"), name.alias("name"), F.col("n_name").alias("zone"))
