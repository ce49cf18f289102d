"""Plan reports over literal plans, the same rows in both engines; live plans are in the tests."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import eventlog
from . import cost, detect, walk

P_SQL = """(VALUES ('p1', 1, 'join', 'SortMergeJoin', 50, NULL, 10, 'hash'), ('p1', 2, 'shuffle', 'Exchange', 20, NULL, 10, NULL), ('p1', 3, 'shuffle', 'Exchange', 20, NULL, 11, NULL),
  ('p1', 4, 'cache', 'RepeatedFileScan', 30, 'db.t', 4, NULL), ('p1', 5, 'cache', 'RepeatedFileScan', 30, NULL, 5, NULL), ('p2', 1, 'join', 'CrossJoin', 500, NULL, 20, 'cross'),
  ('p2', 2, 'union', 'UnionSchemaMismatch', 75, NULL, 21, NULL), ('p2', 3, 'cache', 'RepeatedFileScan', 60, 'db.t', 22, NULL), ('p3', 1, 'join', 'BroadcastHashJoin', 1, NULL, 30, 'hash'),
  ('p3', 2, 'join', 'CartesianProduct', 1000, NULL, 30, 'cross'), ('p3', 3, 'format', 'CsvRead', 40, 'a.csv', 31, NULL)) AS t(plan_id, node_id, type, name, points, table_name, line, join_type)"""
S_SQL = """(VALUES ('p1', 1, 'db.a', CAST(700000000 AS BIGINT)), ('p1', 2, 'db.a', 700000000), ('p1', 3, 'db.b', 1000), ('p2', 1, 'db.a', 600000000), ('p2', 2, 'db.c', NULL), ('p3', 1, 'db.b', 1000), ('p3', 2, '__tmp', 5), ('p3', 3, 'spark_catalog', 5),
  ('p3', 4, 'db.d', 9), ('p3', 5, 'db.d', 9)) AS t(plan_id, node_id, path, size)"""
G_SQL = """(VALUES (1, 'save at Load.py', 'Scan parquet'), (2, 'save at Load.py', 'Exchange hashpartitioning'), (3, 'show', 'Execute SetCommand'), (4, 'save at Load.py', 'LocalTableScan'), (5, 'count', 'Scan csv')) AS t(id, description, plan)"""


def _rows(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values.replace('(VALUES', 'VALUES', 1).replace(')) AS t(', ') AS t(', 1)}")


@query("plan_tables", "SELECT DISTINCT regexp_extract(plan, '(?:Scan|Relation) \\w+ ([\\w.]+\\.\\w+)', 1) AS table_name FROM (VALUES ('FileScan parquet db.a[x]'), ('FileScan orc db.b[x]'), ('FileScan parquet [y]'), ('Scan parquet db.a[z]')) AS t(plan) WHERE regexp_matches(plan, '(?:Scan|Relation) \\w+ [\\w.]+\\.\\w+')")
def plan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that plan text names, qualified ones only."""
    rows = spark.sql("SELECT * FROM VALUES ('FileScan parquet db.a[x]'), ('FileScan orc db.b[x]'), ('FileScan parquet [y]'), ('Scan parquet db.a[z]') AS t(plan)")
    return rows.select(F.explode(F.regexp_extract_all("plan", F.lit(r"(?:Scan|Relation) \w+ ([\w.]+\.\w+)"), F.lit(1))).alias("table_name")).distinct()


DEDUPED_SQL = f"SELECT plan_id, node_id, type, name, points, table_name, line, join_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id, name || COALESCE(':' || table_name, '') ORDER BY table_name IS NULL, node_id) AS k FROM {P_SQL}) AS d WHERE k = 1"


@query("plan_issue_dedupe", DEDUPED_SQL)
def plan_issue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    return detect.deduplicated(_rows(spark, P_SQL))


@query("job_run_issues", f"SELECT DISTINCT name, table_name FROM {P_SQL} WHERE name NOT IN ('CrossJoin', 'UnionSchemaMismatch')")
def job_run_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a run over all its plans, without those that code rules cover."""
    covered = F.broadcast(spark.sql("SELECT * FROM VALUES ('CrossJoin'), ('UnionSchemaMismatch') AS t(covered)"))
    return _rows(spark, P_SQL).select("name", "table_name").dropDuplicates().join(covered, F.col("name") == F.col("covered"), "left_anti")


@query(
    "cross_plan_scans",
    f"""SELECT path, COUNT(*) AS plans, MAX(size) AS size, string_agg(plan_id, ',' ORDER BY plan_id) AS names, CASE WHEN MAX(size) > 536870912 THEN 80 ELSE 40 END AS points
FROM (SELECT plan_id, path, MAX(size) AS size FROM {S_SQL} GROUP BY plan_id, path) AS d GROUP BY path HAVING COUNT(*) >= 2""",
)
def cross_plan_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18."""
    per = _rows(spark, S_SQL).groupBy("plan_id", "path").agg(F.max("size").alias("size"))
    out = per.groupBy("path").agg(F.count("*").alias("plans"), F.max("size").alias("size"), F.array_join(F.sort_array(F.collect_list("plan_id")), ",").alias("names"))
    return out.filter("plans >= 2").withColumn("points", F.when(F.col("size") > 512 * 2**20, 80).otherwise(40))


@query("repeated_scan", f"SELECT plan_id, node_id, path FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id, path ORDER BY node_id) AS k FROM {S_SQL}) AS d WHERE k = 2")
def repeated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19."""
    k = F.row_number().over(Window.partitionBy("plan_id", "path").orderBy("node_id"))
    return _rows(spark, S_SQL).withColumn("k", k).filter("k = 2").select("plan_id", "node_id", "path")


@query("repeated_alias", f"SELECT plan_id, path, COUNT(*) AS n FROM {S_SQL} WHERE NOT starts_with(path, '__') AND path <> 'spark_catalog' GROUP BY plan_id, path HAVING COUNT(*) >= 2")
def repeated_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20."""
    own = ~F.col("path").startswith("__") & (F.col("path") != "spark_catalog")
    return _rows(spark, S_SQL).filter(own).groupBy("plan_id", "path").agg(F.count("*").alias("n")).filter("n >= 2")


@query("plan_cost", f"SELECT plan_id, CAST(SUM(points) AS BIGINT) AS points FROM {P_SQL} GROUP BY plan_id")
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21."""
    return _rows(spark, P_SQL).groupBy("plan_id").agg(F.sum("points").alias("points"))


@query(
    "cost_breakdown",
    f"""SELECT join_points, shuffle_points, code_points, join_points + shuffle_points + code_points AS total,
  CASE WHEN join_points + shuffle_points + code_points = 0 THEN 'none' WHEN join_points + shuffle_points + code_points < 50 THEN 'low' WHEN join_points + shuffle_points + code_points < 200 THEN 'medium' WHEN join_points + shuffle_points + code_points < 500 THEN 'high' ELSE 'very high' END AS label
FROM (SELECT CAST(SUM(points) FILTER (WHERE type = 'join') AS BIGINT) AS join_points, CAST(SUM(points) FILTER (WHERE type = 'shuffle') AS BIGINT) AS shuffle_points, CAST(136 AS BIGINT) AS code_points FROM {P_SQL}) AS s""",
)
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M22."""
    code = spark.sql("SELECT * FROM VALUES ('critical'), ('warning'), ('info'), ('suggestion') AS t(severity)")
    return cost.breakdown(_rows(spark, P_SQL), code)


@query("cost_label", f"SELECT plan_id, node_id, CASE WHEN points = 0 THEN 'none' WHEN points < 50 THEN 'low' WHEN points < 200 THEN 'medium' WHEN points < 500 THEN 'high' ELSE 'very high' END AS label FROM {P_SQL}")
def cost_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M23."""
    return _rows(spark, P_SQL).select("plan_id", "node_id", cost.label(F.col("points")).alias("label"))


@query("cost_points_dollars", f"SELECT plan_id, node_id, ROUND(points * 0.1 * (8 / 4) * 0.4 / 3600, 9) AS dollars FROM {P_SQL}")
def cost_points_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M24."""
    return _rows(spark, P_SQL).select("plan_id", "node_id", F.round(cost.from_points(F.col("points"), F.lit(8)), 9).alias("dollars"))


@query("cost_bytes_dollars", f"SELECT plan_id, node_id, ROUND(size / (500 * 1048576.0) / 3600 * 0.7, 9) AS dollars FROM {S_SQL}")
def cost_bytes_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M25."""
    return _rows(spark, S_SQL).select("plan_id", "node_id", F.round(cost.from_bytes(F.col("size")), 9).alias("dollars"))


@query("cost_duration_dollars", "SELECT o_orderkey, ROUND(o_orderkey % 100000 / 3.6e6 * (8 / 4) * 0.4, 9) AS dollars FROM orders")
def cost_duration_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders' keys stand for run times."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return rows.select("o_orderkey", F.round(cost.from_duration(F.col("o_orderkey") % 100000, F.lit(8)), 9).alias("dollars"))


C_SQL = "(VALUES (1, CAST(1000000000 AS BIGINT), CAST(5000 AS BIGINT), 70), (2, NULL, 5000, 70), (3, 0, NULL, 70), (4, NULL, 0, 0)) AS t(id, size, millis, points)"


@query("cost_strategy", f"SELECT id, ROUND(COALESCE(NULLIF(size, 0) / (500 * 1048576.0) / 3600 * 0.7, NULLIF(millis, 0) / 3.6e6 * (8 / 4) * 0.4, points * 0.1 * (8 / 4) * 0.4 / 3600), 9) AS dollars FROM {C_SQL}")
def cost_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M27."""
    return _rows(spark, C_SQL).select("id", F.round(cost.strategy(F.col("size"), F.col("millis"), F.col("points"), F.lit(8)), 9).alias("dollars"))


@query("plan_groups", f"SELECT description, COUNT(*) AS executions, COUNT(*) FILTER (WHERE regexp_matches(plan, 'Scan|Exchange') AND NOT starts_with(plan, 'Execute')) AS working FROM {G_SQL} GROUP BY description")
def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions by what started them, and how many of them did work."""
    return _rows(spark, G_SQL).groupBy("description").agg(F.count("*").alias("executions"), F.count_if(~eventlog.trivial()).alias("working"))


@query("plan_issue_count", f"SELECT plan_id, COUNT(*) AS n FROM {P_SQL} GROUP BY plan_id")
def plan_issue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M35."""
    return _rows(spark, P_SQL).groupBy("plan_id").agg(F.count("*").alias("n"))


@query("top_issues", f"SELECT plan_id, node_id, substring(name, 1, 12) AS name, points FROM {P_SQL} ORDER BY points DESC, plan_id, node_id LIMIT 10")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten costliest, names cut short."""
    return _rows(spark, P_SQL).orderBy(F.desc("points"), "plan_id", "node_id").limit(10).select("plan_id", "node_id", F.substring("name", 1, 12).alias("name"), "points")


@query("line_cost", f"SELECT plan_id, line, CAST(SUM(points) AS BIGINT) AS points, arg_max(join_type, node_id) FILTER (WHERE join_type IS NOT NULL) AS join_type FROM {P_SQL} GROUP BY plan_id, line")
def line_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each line, and the type of its last join."""
    last = F.max(F.when(F.col("join_type").isNotNull(), F.struct("node_id", "join_type")))["join_type"]
    return _rows(spark, P_SQL).groupBy("plan_id", "line").agg(F.sum("points").alias("points"), last.alias("join_type"))


N_SQL = """(VALUES ('p1', 1, NULL, 'Exchange', 'Exchange hashpartitioning(a#1, 4)', CAST(600.0 AS DOUBLE)), ('p1', 2, 1, 'Exchange', 'Exchange hashpartitioning(a#1, 1)', NULL), ('p1', 3, 2, 'Exchange', 'Exchange SinglePartition', NULL),
  ('p2', 1, NULL, 'Exchange', 'Exchange hashpartitioning(a#1, 200)', 30000.0), ('p2', 2, 1, 'Exchange', 'Exchange rangepartitioning(a#1 ASC, 200)', 30000.0), ('p3', 1, NULL, 'Exchange', 'Exchange hashpartitioning(a#1, 4)', 100.0)) AS t(plan_id, node_id, parent_id, operator, detail, mib)"""


@query(
    "plan_partition_rules",
    f"""SELECT plan_id, node_id, CASE WHEN n <= 1 THEN 50 WHEN n < 10 AND most > 500 THEN 35 WHEN n = 200 AND most > 20480 THEN 40 END AS points, CASE WHEN n = 200 AND most > 20480 THEN CAST(ceil(most / 200) AS BIGINT) END AS suggested
FROM (SELECT *, TRY_CAST(regexp_extract(detail, 'partitioning\\(.*?,?\\s*([0-9]+)\\)', 1) AS INTEGER) AS n, MAX(mib) OVER (PARTITION BY plan_id) AS most FROM {N_SQL}) AS d WHERE n IS NOT NULL AND (n <= 1 OR (n < 10 AND most > 500) OR (n = 200 AND most > 20480))""",
)
def plan_partition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too few shuffle partitions, or the default number under much data and how many would do."""
    n = F.expr(r"try_cast(nullif(regexp_extract(detail, 'partitioning\\(.*?,?\\s*([0-9]+)\\)', 1), '') AS int)")
    rows = _rows(spark, N_SQL).withColumns({"n": n, "most": F.max("mib").over(Window.partitionBy("plan_id"))})
    default = (F.col("n") == 200) & (F.col("most") > 20480)
    points = F.when(F.col("n") <= 1, 50).when((F.col("n") < 10) & (F.col("most") > 500), 35).when(default, 40)
    return rows.select("plan_id", "node_id", points.alias("points"), F.when(default, F.ceil(F.col("most") / 200)).alias("suggested")).filter("points IS NOT NULL")


U_SQL = """(VALUES ('p1', 1, NULL, 'Union', 'Union'), ('p1', 2, 1, 'Project', 'Project [a#1 AS b#5, c#2]'), ('p1', 3, 1, 'Project', 'Project [a#3, c#4]'), ('p2', 1, NULL, 'Union', 'Union'), ('p2', 2, 1, 'Project', 'Project [a#1, b#2]'),
  ('p3', 1, NULL, 'Project', 'Project [a#1 AS b#5]')) AS t(plan_id, node_id, parent_id, operator, detail)"""


@query(
    "plan_union_reorder",
    f"""SELECT u.plan_id, MIN(u.node_id) AS node_id FROM {U_SQL.replace('AS t(', 'AS u(')} JOIN {U_SQL.replace('AS t(', 'AS c(')} ON c.plan_id = u.plan_id AND c.parent_id = u.node_id
WHERE u.operator = 'Union' AND regexp_matches(c.detail, '\\w+#\\d+ AS \\w+#\\d+') GROUP BY u.plan_id""",
)
def plan_union_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns renamed right under a union."""
    n = _rows(spark, U_SQL)
    child = n.select("plan_id", F.col("parent_id").alias("node_id"), F.col("detail").alias("below"))
    hit = n.filter("operator = 'Union'").join(child, ["plan_id", "node_id"]).filter(F.col("below").rlike(r"\w+#\d+ AS \w+#\d+"))
    return hit.groupBy("plan_id").agg(F.min("node_id").alias("node_id"))


@query("plan_detectors")
def plan_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.9 on live plans of the driver tables (node ids depend on the planner: rows only)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o, c = read("orders"), read("customer")
    frames = [
        o.join(c.hint("merge"), o.o_custkey == c.c_custkey).groupBy("c_mktsegment").count(),
        o.groupBy("o_orderstatus").agg(F.max("o_orderpriority")),
        read("region").crossJoin(F.broadcast(read("nation"))),
        o.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderkey")).alias("k")),
    ]
    return detect.deduplicated(detect.detect(walk.plan_nodes(*frames)))


@query("event_log_plans")
def event_log_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of an event log. Where the session writes none, a small log of its own plans is written first."""
    import json

    if spark.conf.get("spark.eventLog.enabled", "false") == "true" and spark.conf.get("spark.eventLog.rolling.enabled", "true") == "false" and spark.conf.get("spark.eventLog.compress", "false") == "false":
        return eventlog.executions(spark, spark.conf.get("spark.eventLog.dir"))
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    frames = [read("orders").groupBy("o_orderstatus").count(), read("nation").orderBy("n_name")]
    events = [{"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": i, "description": f"query {i}", "physicalPlanDescription": walk.explained(df), "time": i} for i, df in enumerate(frames)]
    from ..sources.tables import shared_folder

    path = f"{shared_folder(spark)}/event-log"
    text = [json.dumps(e) for e in events] + ["not json SparkListenerSQLExecutionStart", json.dumps({"Event": "SparkListenerJobStart"})]
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.mode("overwrite").text(path)
    return eventlog.executions(spark, path).drop("file")


