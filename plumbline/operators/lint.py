"""Bundle lint: allowed values, exclusions, ranges, duplicates and references as anti joins and conditional aggregates over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import bundle
from ..sources.tables import table

#: Keys and resource types of the deployment format.
TOP_LEVEL = ("bundle", "include", "variables", "resources", "targets", "artifacts", "workspace", "permissions", "presets", "run_as", "sync", "scripts", "python", "experimental")
RESOURCES = ("jobs", "pipelines", "clusters", "dashboards", "alerts", "quality_monitors", "experiments", "models", "registered_models", "schemas", "volumes", "sql_warehouses", "instance_pools")
#: The numbers that keys may have; a version.
RANGES = {"max_concurrent_runs": (0, 1000), "num_workers": (0, 2**31 - 1), "autotermination_minutes": (10, 10_000)}
VERSION = r"^\d+\.\d+\.x(-scala\d+\.\d+)?(-cpu-ml|-gpu-ml|-photon)?$"
#: Where a path leads: the first of these that matches names the place of a fact.
PLACES = {
    "target": r"^/targets/[^/]+$",
    "bundle_permission": r"^/permissions/\d+$",
    "job": r"^/resources/jobs/[^/]+$",
    "job_permission": r"^/resources/jobs/[^/]+/permissions/\d+$",
    "shown_permission": r"^/resources/(?:dashboards|alerts)/[^/]+/permissions/\d+$",
    "schedule": r"^/resources/jobs/[^/]+/(?:schedule|trigger)$",
    "periodic": r"^/resources/jobs/[^/]+/trigger/periodic$",
    "table_update": r"^/resources/jobs/[^/]+/trigger/table_update$",
    "environment": r"^/resources/jobs/[^/]+/environments/\d+/spec$",
    "health": r"^/resources/jobs/[^/]+/health/rules/\d+$",
    "task": r"^/resources/jobs/[^/]+/tasks/\d+$",
    "python_task": r"^/resources/jobs/[^/]+/tasks/\d+/spark_python_task$",
    "cluster": r"^/resources/jobs/[^/]+/(?:tasks|job_clusters)/\d+/new_cluster$",
    "volume": r"^/resources/volumes/[^/]+$",
    "alert": r"^/resources/alerts/[^/]+$",
    "alert_schedule": r"^/resources/alerts/[^/]+/schedule$",
    "alert_evaluation": r"^/resources/alerts/[^/]+/evaluation$",
}
#: What a key may be, by place.
ALLOWED = {
    ("target", "mode"): ("development", "production"),
    ("bundle_permission", "level"): ("CAN_VIEW", "CAN_RUN", "CAN_MANAGE", "CAN_MANAGE_RUN", "IS_OWNER", "CAN_READ", "CAN_EDIT"),
    ("job_permission", "level"): ("CAN_VIEW", "CAN_MANAGE_RUN", "CAN_MANAGE", "IS_OWNER"),
    ("shown_permission", "level"): ("CAN_READ", "CAN_RUN", "CAN_EDIT", "CAN_MANAGE", "IS_OWNER"),
    ("schedule", "pause_status"): ("PAUSED", "UNPAUSED"),
    ("periodic", "unit"): ("HOURS", "DAYS", "WEEKS"),
    ("table_update", "condition"): ("ANY_UPDATED",),
    ("health", "metric"): ("RUN_DURATION_SECONDS", "STREAMING_BACKLOG_SECONDS", "STREAMING_BACKLOG_RECORDS"),
    ("health", "op"): ("GREATER_THAN",),
    ("task", "run_if"): ("ALL_SUCCESS", "ALL_DONE", "NONE_FAILED", "AT_LEAST_ONE_SUCCESS", "ALL_FAILED", "AT_LEAST_ONE_FAILED"),
    ("cluster", "data_security_mode"): ("SINGLE_USER", "USER_ISOLATION", "NONE", "LEGACY_TABLE_ACL", "LEGACY_PASSTHROUGH", "LEGACY_SINGLE_USER", "LEGACY_SINGLE_USER_STANDARD"),
    ("cluster", "runtime_engine"): ("PHOTON", "STANDARD"),
    ("alert_evaluation", "comparison_operator"): ("EQUAL", "NOT_EQUAL", "GREATER_THAN", "GREATER_THAN_OR_EQUAL", "LESS_THAN", "LESS_THAN_OR_EQUAL"),
}
#: Places whose odd values are warnings.
MILD = ("health",)
#: Rules on one entity: its place, the key that is shown, keys that stand in it and keys that do not, and the value of the shown key.
ENTITY_RULES = (
    ("volume_permissions", "error", "volume", "permissions", ("permissions",), (), None),
    ("alert_condition", "error", "alert", "condition", ("condition",), ("evaluation",), None),
    ("alert_subscriptions", "error", "alert", "subscriptions", ("subscriptions",), (), None),
    ("alert_cron", "error", "alert_schedule", "cron_schedule", ("cron_schedule",), ("quartz_cron_schedule",), None),
    ("alert_without_pause_status", "warning", "alert_schedule", "pause_status", (), ("pause_status",), None),
    ("view_level", "warning", "shown_permission", "level", ("level",), (), "CAN_VIEW"),
    ("job_without_name", "warning", "job", "name", (), ("name",), None),
    ("schedule_and_continuous", "error", "job", "schedule", ("schedule", "continuous"), (), None),
    ("environment_without_client", "warning", "environment", "client", (), ("client",), None),
    ("two_clusters", "error", "task", "job_cluster_key", ("job_cluster_key", "existing_cluster_id"), (), None),
    ("jar_uri_deprecated", "warning", "python_task", "jar_uri", ("jar_uri",), (), None),
    ("single_user_without_name", "warning", "cluster", "data_security_mode", ("data_security_mode",), ("single_user_name",), "SINGLE_USER"),
    ("photon_deprecated", "warning", "cluster", "photon", ("photon",), (), "True"),
)


def _found(rows: DataFrame, rule: str, severity: str) -> DataFrame:
    return rows.select("file", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "path", "key", "value")


def placed(rows: DataFrame) -> DataFrame:
    """``place``: what the path of a fact leads to; null where no rule looks."""
    place = None
    for name, path in PLACES.items():
        place = F.when(F.col("path").rlike(path), name) if place is None else place.when(F.col("path").rlike(path), name)
    return rows.withColumn("place", place)


def allowed_values(facts: DataFrame) -> DataFrame:
    """Values outside the list of their key and place; unknown top-level keys and resource types."""
    spark = facts.sparkSession
    listed = F.broadcast(spark.createDataFrame([(*at, v) for at, vs in ALLOWED.items() for v in vs], "place string, key string, value string"))  # a fixed list
    asked = F.broadcast(spark.createDataFrame([(*at, "warning" if at[0] in MILD else "error") for at in ALLOWED], "place string, key string, severity string"))
    judged = placed(facts).filter(F.col("value").isNotNull() & ~F.col("value").startswith("${")).join(asked, ["place", "key"])
    odd = judged.join(listed, ["place", "key", "value"], "left_anti")
    bad = odd.select("file", F.lit("value_not_allowed").alias("rule"), "severity", "path", "key", "value")
    top = _found(facts.filter((F.col("path") == "") & ~F.col("key").isin(*TOP_LEVEL)), "unknown_key", "warning")
    kind = _found(facts.filter((F.col("path") == "/resources") & ~F.col("key").isin(*RESOURCES)), "unknown_resource", "warning")
    host = _found(facts.filter((F.col("key") == "host") & ~F.col("value").startswith("https://") & ~F.col("value").startswith("${")), "host_not_https", "error")
    return bad.unionByName(top).unionByName(kind).unionByName(host)


def entities(facts: DataFrame) -> DataFrame:
    """What an entity must have, must not have, or not have together; one aggregate by entity for all rules."""
    # an entity without any key is known from its parent's fact
    empty = facts.filter("value IS NULL").select("file", F.concat_ws("/", "path", "key").alias("path"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    rows = placed(facts.filter("value IS NULL OR value <> ''").unionByName(empty)).filter("place IS NOT NULL")
    kept = F.collect_set(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    each = rows.groupBy("file", "path", "place").agg(kept.alias("own"))

    def judged(rule: str, severity: str, place: str, shown: str, with_: tuple, without: tuple, value: str | None):
        up = F.col("place") == place
        for key in with_:
            up &= F.array_contains(F.col("own.key"), key)
        for key in without:
            up &= ~F.array_contains(F.col("own.key"), key)
        said = F.get(F.filter("own", lambda x: x["key"] == shown), F.lit(0))["value"]
        if value is not None:
            up &= F.coalesce(said == value, F.lit(False))
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(shown).alias("key"), said.alias("value"), up.alias("up"))

    found = each.select("file", "path", F.inline(F.filter(F.array(*[judged(*r) for r in ENTITY_RULES]), lambda x: x["up"])))
    return found.select("file", "rule", "severity", "path", "key", "value")


def ranges(facts: DataFrame) -> DataFrame:
    """Numbers that are none, or out of range."""
    number = F.expr("try_cast(value AS bigint)")
    outside = F.lit(False)
    for key, (low, high) in RANGES.items():
        outside |= (F.col("key") == key) & (number.isNull() | ~number.between(low, high))
    return _found(facts.filter(F.col("value").isNotNull() & ~F.coalesce("value", F.lit("")).startswith("${") & outside), "out_of_range", "error")


def duplicates(facts: DataFrame) -> DataFrame:
    """Task keys that stand twice in a job, and tasks without one."""
    tasks = facts.filter(F.col("path").rlike(r"^/resources/jobs/[^/]+/tasks/\d+$"))
    keys = tasks.filter("key = 'task_key'").withColumn("job", F.regexp_extract("path", r"^(/resources/jobs/[^/]+)", 1))
    twice = keys.groupBy("file", "job", "value").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1").withColumn("key", F.lit("task_key"))
    without = tasks.groupBy("file", "path").agg(F.count_if(F.col("key") == "task_key").alias("n")).filter("n = 0").withColumns({"key": F.lit("task_key"), "value": F.lit(None).cast("string")})
    return _found(twice, "duplicate_task", "error").unionByName(_found(without, "task_without_key", "error"))


def references(facts: DataFrame) -> DataFrame:
    """Cluster keys that no job cluster of the job defines, where it defines any."""
    job = F.regexp_extract("path", r"^(/resources/jobs/[^/]+)", 1).alias("job")
    used = facts.filter((F.col("key") == "job_cluster_key") & F.col("path").rlike(r"/tasks/\d+$")).select("file", job, "path", "key", "value")
    made = facts.filter((F.col("key") == "job_cluster_key") & F.col("path").rlike(r"/job_clusters/\d+$")).select("file", job, "value")
    lost = used.join(made, ["file", "job", "value"], "left_anti").join(made.select("file", "job").distinct(), ["file", "job"], "left_semi")
    return _found(lost, "undefined_cluster", "error")


def security(facts: DataFrame) -> DataFrame:
    """No isolation in a file with a production target, and versions that do not read as one."""
    clusters = placed(facts).filter("place = 'cluster'")
    production = placed(facts).filter("place = 'target' AND key = 'mode' AND value = 'production'").select("file").distinct()
    open_ = clusters.filter("key = 'data_security_mode' AND value = 'NONE'").join(production, "file", "left_semi")
    version = clusters.filter((F.col("key") == "spark_version") & (F.col("value") != "") & ~F.col("value").rlike(VERSION) & ~F.col("value").startswith("${"))
    return _found(open_, "no_isolation_in_production", "warning").unionByName(_found(version, "odd_version", "warning"))


def missing_files(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that are not among ``files(path)``."""
    used = facts.filter(F.col("key").isin("notebook_path", "python_file") & ~F.coalesce("value", F.lit("")).startswith("/"))
    return _found(used.join(files.select(F.regexp_replace("path", r"^\./", "").alias("name")), F.regexp_replace("value", r"^\./", "") == F.col("name"), "left_anti"), "file_missing", "error")


def lint(facts: DataFrame) -> DataFrame:
    """All findings: (file, rule, severity, path, key, value)."""
    out = allowed_values(facts)
    for part in (ranges, entities, duplicates, references, security):
        out = out.unionByName(part(facts))
    return out


def located(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with the first line of their file that holds the value, else the key."""
    said = F.coalesce("value", "key")
    at = found.withColumn("said", said).join(lines.select("file", "line", "text"), "file").filter(F.expr("contains(text, said)"))
    first = at.groupBy("file", "rule", "path", "key", "said").agg(F.min("line").alias("line"))
    return found.withColumn("said", said).join(first, ["file", "rule", "path", "key", "said"], "left").drop("said")


EXAMPLE = """
bundle: {name: shop}
targetz: {}
targets:
  dev: {mode: development, workspace: {host: https://a.example}}
  prod: {mode: prodution, workspace: {host: http://a.example}}
resources:
  jobs:
    load:
      name: load
      max_concurrent_runs: 2000
      schedule: {pause_status: PAUSED}
      continuous: {pause_status: OFF}
      job_clusters:
        - {job_cluster_key: main, new_cluster: {spark_version: 15.4.x-scala2.12, num_workers: -1}}
      tasks:
        - {task_key: a, job_cluster_key: main, notebook_task: {notebook_path: ./a.py}}
        - {task_key: a, job_cluster_key: other, existing_cluster_id: c1, run_if: SOMETIMES}
        - {spark_python_task: {python_file: b.py}}
  jobz: {}
"""


@query(
    "bundle_tasks",
    """SELECT * FROM (VALUES ('bundle.yml', 'load', 'main', 'a', 'notebook_task', './a.py', '15.4.x-scala2.12', '-1'), ('bundle.yml', 'load', 'other', 'a', NULL, NULL, NULL, NULL),
  ('bundle.yml', 'load', NULL, NULL, 'spark_python_task', 'b.py', NULL, NULL)) AS t(file, job, cluster_key, task, kind, source, spark_version, num_workers)""",
)
def bundle_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1."""
    found = bundle.facts(spark, {"bundle.yml": EXAMPLE})
    named = bundle.clusters(found).select("cluster_key").distinct()
    out = bundle.tasks(found)
    clusters = found.filter(F.col("path").rlike(r"/new_cluster$")).select("file", F.regexp_extract("path", r"^/resources/jobs/([^/]+)", 1).alias("job"), "key", "value")
    spec = clusters.groupBy("file", "job").agg(F.max(F.when(F.col("key") == "spark_version", F.col("value"))).alias("v"), F.max(F.when(F.col("key") == "num_workers", F.col("value"))).alias("w"))
    known = named.withColumn("known", F.lit(True))
    out = out.join(spec, ["file", "job"], "left").join(known, "cluster_key", "left")
    return out.select("file", "job", "cluster_key", "task", "kind", "source", F.when(F.col("known"), F.col("v")).alias("spark_version"), F.when(F.col("known"), F.col("w")).alias("num_workers"))


@query("lint_allowed_values", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name NOT IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_8', 'NATION_13', 'NATION_21')")
def lint_allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed-values shape over a table: an anti join with a literal list."""
    listed = F.broadcast(spark.createDataFrame([(f"NATION_{n}",) for n in (1, 2, 3, 5, 8, 13, 21)], "allowed string"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.join(listed, F.col("n_name") == F.col("allowed"), "left_anti").select("s_suppkey", "n_name")


@query("lint_mutual_exclusion", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) FILTER (WHERE o_orderpriority LIKE '1%') > 0 AND COUNT(*) FILTER (WHERE o_orderpriority LIKE '5%') > 0")
def lint_mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    both = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(p.startswith("1")).alias("a"), F.count_if(p.startswith("5")).alias("b"))
    return both.filter("a > 0 AND b > 0").select("o_custkey")


@query("lint_range", "SELECT p_partkey, p_size FROM part WHERE p_size IS NULL OR p_size NOT BETWEEN 5 AND 45")
def lint_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_size").isNull() | ~F.col("p_size").between(5, 45)).select("p_partkey", "p_size")


@query("lint_duplicates", "SELECT p_brand, p_type, COUNT(*) AS n, MIN(p_partkey) AS first_part FROM part GROUP BY p_brand, p_type HAVING COUNT(*) > 1")
def lint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part")).filter("n > 1")


@query("lint_fk", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def lint_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


#: A bundle with one fault a rule; the faults are named in the query's rows.
FAULTY = """
targetz: {}
permissions: [{level: CAN_USE}, {level: CAN_EDIT}]
targets: {live: {mode: production, workspace: {host: http://a.example}}}
resources:
  jobs:
    bare: {tasks: [{task_key: x, job_cluster_key: free}]}
    full:
      name: full
      permissions: [{level: CAN_READ}, {level: CAN_VIEW}]
      schedule: {pause_status: STOPPED}
      trigger: {pause_status: PAUSED, periodic: {unit: MINUTES}, table_update: {condition: ALL_UPDATED}}
      environments: [{environment_key: e, spec: {dependencies: [a]}}, {environment_key: f, spec: {client: "4"}}]
      health: {rules: [{metric: RUN_SECONDS, op: LESS_THAN}]}
      job_clusters:
        - {job_cluster_key: main, new_cluster: {spark_version: latest, photon: true, data_security_mode: NONE, autotermination_minutes: 5}}
        - {job_cluster_key: own, new_cluster: {spark_version: 14.3.x-scala2.12, data_security_mode: SINGLE_USER, runtime_engine: TURBO}}
      tasks:
        - {task_key: a, job_cluster_key: main, spark_python_task: {python_file: a.py, jar_uri: old.jar}}
        - {task_key: b, job_cluster_key: lost}
  dashboards: {shown: {permissions: [{level: CAN_VIEW}]}}
  alerts:
    late: {condition: x, subscriptions: [y], schedule: {cron_schedule: z}}
    fine: {evaluation: {comparison_operator: ABOVE}, schedule: {quartz_cron_schedule: z, pause_status: PAUSED}}
  volumes: {v: {permissions: [{level: READ_VOLUME}]}}
"""
FAULTS = (
    ("unknown_key", "warning", "", "targetz"), ("value_not_allowed", "error", "/permissions/0", "level"), ("host_not_https", "error", "/targets/live/workspace", "host"),
    ("job_without_name", "warning", "/resources/jobs/bare", "name"), ("value_not_allowed", "error", "/resources/jobs/full/permissions/0", "level"), ("value_not_allowed", "error", "/resources/jobs/full/schedule", "pause_status"),
    ("value_not_allowed", "error", "/resources/jobs/full/trigger/periodic", "unit"), ("value_not_allowed", "error", "/resources/jobs/full/trigger/table_update", "condition"), ("environment_without_client", "warning", "/resources/jobs/full/environments/0/spec", "client"),
    ("value_not_allowed", "warning", "/resources/jobs/full/health/rules/0", "metric"), ("value_not_allowed", "warning", "/resources/jobs/full/health/rules/0", "op"), ("odd_version", "warning", "/resources/jobs/full/job_clusters/0/new_cluster", "spark_version"),
    ("photon_deprecated", "warning", "/resources/jobs/full/job_clusters/0/new_cluster", "photon"), ("no_isolation_in_production", "warning", "/resources/jobs/full/job_clusters/0/new_cluster", "data_security_mode"), ("out_of_range", "error", "/resources/jobs/full/job_clusters/0/new_cluster", "autotermination_minutes"),
    ("single_user_without_name", "warning", "/resources/jobs/full/job_clusters/1/new_cluster", "data_security_mode"), ("value_not_allowed", "error", "/resources/jobs/full/job_clusters/1/new_cluster", "runtime_engine"), ("jar_uri_deprecated", "warning", "/resources/jobs/full/tasks/0/spark_python_task", "jar_uri"),
    ("undefined_cluster", "error", "/resources/jobs/full/tasks/1", "job_cluster_key"), ("value_not_allowed", "error", "/resources/dashboards/shown/permissions/0", "level"), ("view_level", "warning", "/resources/dashboards/shown/permissions/0", "level"),
    ("alert_condition", "error", "/resources/alerts/late", "condition"), ("alert_subscriptions", "error", "/resources/alerts/late", "subscriptions"), ("alert_cron", "error", "/resources/alerts/late/schedule", "cron_schedule"),
    ("alert_without_pause_status", "warning", "/resources/alerts/late/schedule", "pause_status"), ("value_not_allowed", "error", "/resources/alerts/fine/evaluation", "comparison_operator"), ("volume_permissions", "error", "/resources/volumes/v", "permissions"),
)


@query("lint_bundle", f"SELECT * FROM (VALUES {', '.join(map(str, FAULTS))}) AS t(rule, severity, path, key)")
def lint_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over one bundle."""
    return lint(bundle.facts(spark, {"bundle.yml": FAULTY})).select("rule", "severity", "path", "key")
