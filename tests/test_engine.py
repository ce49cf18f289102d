"""Lint, event logs, caching, streams and the remaining pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline import api
from plumbline.functions import types
from plumbline.operators import issues, lint, spend, telemetry
from plumbline.operators.joins import asof
from plumbline.operators.windows import global_rank
from plumbline.sources import bundle, eventlog
from plumbline.streaming import queries as streams


def test_lint_rules(spark):
    found = lint.lint(bundle.facts(spark, {"b.yml": lint.EXAMPLE}))
    rules = sorted({r["rule"] for r in found.collect()})
    assert rules == ["duplicate_task", "host_not_https", "out_of_range", "schedule_and_continuous", "task_without_key", "two_clusters", "undefined_cluster", "unknown_key", "unknown_resource", "value_not_allowed"]
    clean = "bundle: {name: a}\ntargets: {dev: {mode: development}}\nresources: {jobs: {x: {name: x, tasks: [{task_key: a}]}}}"
    assert lint.lint(bundle.facts(spark, {"b.yml": clean})).count() == 0
    lines = spark.createDataFrame([("b.yml", i, t) for i, t in enumerate(lint.EXAMPLE.split("\n"))], "file string, line int, text string")
    at = {(r["rule"], r["value"]): r["line"] for r in lint.located(found, lines).collect()}
    assert at[("value_not_allowed", "prodution")] == 5
    files = spark.createDataFrame([("a.py",)], "path string")
    assert [r["value"] for r in lint.missing_files(bundle.facts(spark, {"b.yml": lint.EXAMPLE}), files).collect()] == ["b.py"]


def test_bundle_includes(tmp_path, spark):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "b.yml").write_text("include: ['jobs/*.yml', 'b.yml']\nbundle: {name: x}")
    (tmp_path / "jobs/a.yml").write_text("resources: {jobs: {j: {tasks: [{task_key: t, notebook_task: {notebook_path: n.py}}]}}}")
    assert [(r["job"], r["task"], r["kind"]) for r in api.list_bundle_tasks(spark, str(tmp_path / "b.yml")).collect()] == [("j", "t", "notebook_task")]


def test_event_log(spark, tmp_path):
    from plumbline.plans import walk

    plan = walk.explained(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    events = [
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 1, "description": "d", "physicalPlanDescription": plan},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 2, "description": "d", "physicalPlanDescription": ""},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Task Metrics": {"Executor Run Time": 10, "Disk Bytes Spilled": 5}},
    ]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "log").write_text("\n".join([*map(json.dumps, events), "{broken SparkListenerSQLExecutionStart"]))
    assert [r["execution_id"] for r in eventlog.executions(spark, str(tmp_path)).collect()] == [1]
    assert eventlog.task_figures(spark, str(tmp_path)).first()["spilled"] == 5
    assert eventlog.newest(spark, str(tmp_path)).first()["file"].endswith("/log")
    assert "Exchange" in {r["name"] for r in api.job_run_analysis(spark, str(tmp_path)).collect()}


def test_cache_expires(spark):
    now = [0.0]
    cache, made = api.Cache(10, lambda: now[0]), []
    make = lambda: made.append(1) or spark.range(3)
    cache.get("k", make)
    cache.get("k", make)
    now[0] = 11
    cache.get("k", make)
    assert len(made) == 2


def test_billing_summaries(spark, sf_dir):
    users = api.billing_summary(spark, sf_dir, "user").collect()
    assert len(users) <= 10 and users == sorted(users, key=lambda r: (-r["dollars"], r["run_as"]))
    assert api.refresh_billing(spark, sf_dir).count() == 1


def test_period_labels(spark):
    rows = spark.sql("SELECT * FROM VALUES (DATE '2024-01-01', DATE '2024-01-02'), (DATE '2024-01-01', DATE '2024-01-08'), (DATE '2024-01-01', DATE '2024-01-31'), (DATE '2024-01-01', DATE '2024-06-01') AS t(a, b)")
    assert [r[0] for r in rows.select(spend.period_of(F.col("a"), F.col("b"))).collect()] == ["day", "week", "month", "custom"]


def test_fan_out_keeps_errors_apart(spark, sf_dir):
    out = telemetry.fan_out(spark, sf_dir, ["dau", "no_such_report", "wau_mau"])
    assert isinstance(out["no_such_report"], KeyError) and len(out["dau"]) == 1


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 7)])
@pytest.mark.parametrize("seed", range(3))
def test_asof_against_brute_force(spark, seed, bucket):
    rng = random.Random(seed)
    left = [(i, rng.randrange(4), rng.randrange(50)) for i in range(60)]
    right = [(k, t, k * 1000 + t) for k in range(4) for t in rng.sample(range(50), 12)]
    out = asof(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, rt int, v int"), ["k"], "t", "rt", "v", bucket)
    want = {i: max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(0, None))[1] for i, k, t in left}
    assert {r["id"]: r["v"] for r in out.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 50])
def test_global_rank(spark, n):
    rows = spark.createDataFrame([((i * 37) % 101,) for i in range(n)], "v int")
    assert sorted((r["v"], r["k"]) for r in global_rank(rows, ["v"], "k").collect()) == [(v, i + 1) for i, v in enumerate(sorted((i * 37) % 101 for i in range(n)))]


def test_function_types(spark):
    rows = {r["function"]: r["category"] for r in types.probe(spark, ["sqrt", "explode", "upper", "year", "sin"]).collect()}
    assert rows["explode"] == "array" and types.family_of("sqrt") == "numeric" and len(types.public()) > 300
    assert sum(len(v.split()) for v in types.FAMILIES.values()) == 102


def test_stream_equals_batch_over_several_files(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    rows = streams.events(spark, str(tmp_path), files_per_trigger=1).select("event_id", "user_id")
    assert streams.drained(rows, "append", "parts").count() == batch.count()


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for k, when in enumerate(("2024-01-01", "2024-01-10", "2024-01-10", "2024-01-01")):  # late rows go by the watermark before the last batch
        df = spark.sql(f"SELECT {k} AS event_id, TIMESTAMP_NTZ '{when} 00:00:00' AS ts, 1 AS user_id, 'a' AS event_type, 1.0 AS value, '' AS props")
        df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        import time

        time.sleep(1.1)
    rows = streams.events(spark, str(tmp_path), files_per_trigger=1).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    out = streams.drained(rows.select(F.col("w.start").alias("start"), "n"), "append", "late").collect()
    assert [r["n"] for r in out] == [1]


def test_nudge_and_offsets(spark):
    assert issues.nudge(spark, 5, False, False).first()["due"] and not issues.nudge(spark, 9, True, False).first()["due"]
    assert issues.selection_offset(spark.createDataFrame([(2,)], "line int"), 10).first()["line"] == 12
