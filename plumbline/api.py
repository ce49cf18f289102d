"""What tools call: one function a question, each returning a DataFrame."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code, issues, runs, spend
from .plans import cost, detect, text, walk
from .sources import bundle, eventlog


class Cache:
    """Results kept for an hour by key, as cached frames."""

    def __init__(self, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.seconds, self.clock, self.kept = seconds, clock, {}

    def get(self, key, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.kept.get(key)
        if found and self.clock() - found[0] < self.seconds:
            return found[1]
        self.drop(key)
        df = make().persist()
        self.kept[key] = (self.clock(), df)
        return df

    def drop(self, key) -> None:
        if key in self.kept:
            self.kept.pop(key)[1].unpersist()


SPEND = Cache()


def analyze_pyspark(spark: SparkSession, source: str, name: str = "code", opt_in: bool = False) -> DataFrame:
    """Code issues of a source text."""
    return code.analyse(code.from_source(spark, {name: source}), opt_in)


def file_issues(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Issues of several files, by priority, with their counts a file on ``severity_rollup``."""
    found = code.analyse(code.from_source(spark, sources))
    return found.withColumn("priority", issues.rank(F.col("severity"))).orderBy("priority", "file", "line")


def billing_summary(spark: SparkSession, sf_dir: str, by: str = "user", refresh: bool = False) -> DataFrame:
    """Spend by user, workload, job or day."""
    makers = {"user": spend.spend_by_user, "workload": spend.spend_by_workload, "job": spend.spend_by_job, "day": spend.spend_daily, "total": spend.spend_totals}
    if refresh:
        SPEND.drop((sf_dir, by))
    return SPEND.get((sf_dir, by), lambda: makers[by](spark, sf_dir))


def refresh_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_summary(spark, sf_dir, "total", refresh=True)


def plan_analysis(*frames: DataFrame, limits: detect.Limits | None = None) -> DataFrame:
    """Findings in the plans of some frames, costliest first."""
    nodes = walk.plan_nodes(*frames)
    found = detect.deduplicated(detect.detect(nodes, limits))
    return found.withColumn("severity", detect.severity(F.col("points"))).orderBy(F.desc("points"), "plan_id", "node_id")


def plan_text_analysis(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Findings in plan texts."""
    rows = [row for name, t in texts.items() for row in text.parse(t, name)]
    found = detect.detect(spark.createDataFrame(rows, walk.NODES))
    plans = spark.createDataFrame(list(texts.items()), "plan_id string, text string")
    return detect.deduplicated(found.unionByName(detect.statistics_findings(plans)))


def job_run_plans(spark: SparkSession, path: str) -> DataFrame:
    """Executions of the logs under a path that did some work."""
    return eventlog.executions(spark, path).filter(~eventlog.trivial())


def job_run_analysis(spark: SparkSession, path: str, plans: int = 10) -> DataFrame:
    """Findings of a run's event log, with their points; text plans are parsed in Arrow batches, a row a node."""

    def parsed(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [row for i, t in zip(pdf["execution_id"], pdf["plan"], strict=True) for row in text.parse(t, f"execution {i}")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in walk.NODES.split(", ")]).astype({"parent_id": "Int32"})

    from .sources.tables import shared_folder

    runs_ = job_run_plans(spark, path).select("execution_id", "plan")
    folder = f"{shared_folder(spark)}/nodes"
    runs_.mapInPandas(parsed, walk.NODES).write.parquet(folder)  # every detector reads the nodes
    texts = runs_.select(F.concat(F.lit("execution "), F.col("execution_id").cast("string")).alias("plan_id"), F.col("plan").alias("text"))
    found = detect.detect(spark.read.parquet(folder)).unionByName(detect.statistics_findings(texts))
    return detect.deduplicated(found).orderBy(F.desc("points"))


def list_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.interactive_clusters(spark, sf_dir)


def list_job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.last_run_per_job(spark, sf_dir)


def list_bundle_tasks(spark: SparkSession, path: str) -> DataFrame:
    return bundle.tasks(bundle.facts(spark, bundle.read(path)))


#: Methods that run a job, on frames and on their writers.
ACTIONS = ("collect", "count", "show", "toPandas", "toLocalIterator", "foreach", "foreachPartition", "first", "head", "take", "tail", "isEmpty")
WRITES = ("save", "saveAsTable", "insertInto", "parquet", "json", "csv", "orc", "text", "jdbc")


@contextlib.contextmanager
def dry_run() -> Iterator[list[DataFrame]]:
    """Run code without running jobs (N1 to N3): actions record their frame and return nothing, wherever they stand in an expression.

    Frames are captured at the call, so no source text has to be rewritten, and conditions such as ``if df.count() > 0`` run no job either.
    """
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    from pyspark.sql.readwriter import DataFrameWriter
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    seen: list[DataFrame] = []
    empty = {"collect": [], "toLocalIterator": iter(()), "take": [], "tail": [], "count": 0, "isEmpty": True}
    kept: list[tuple] = []

    def swap(owner, name: str, make) -> None:
        if name in vars(owner):
            kept.append((owner, name, vars(owner)[name]))
            setattr(owner, name, make)

    def action(name: str):
        def run(self, *args, **kwargs):
            seen.append(self)
            return empty.get(name)

        return run

    def write(self, *args, **kwargs):
        seen.append(self._df)

    for name in ACTIONS:
        swap(Frame, name, action(name))
    for name in WRITES:
        swap(DataFrameWriter, name, write)
    for name in ("start", "toTable"):
        swap(DataStreamWriter, name, lambda self, *a, **k: None)
    try:
        yield seen
    finally:
        for owner, name, value in kept:
            setattr(owner, name, value)


def run_dry(spark: SparkSession, source: str) -> DataFrame:
    """The plans that a source text would run: (plan_id, node rows) of every frame it acted on."""
    namespace: dict = {"spark": spark}
    with dry_run() as seen:
        exec(compile(source, "<dry run>", "exec"), namespace)  # the caller's own code, on the caller's own session
    frames = list({id(f): f for f in [*seen, *walk.captured(namespace).values()]}.values())
    return walk.plan_nodes(*frames) if frames else spark.createDataFrame([], walk.NODES)


def estimate(spark: SparkSession, source: str) -> DataFrame:
    """The static estimate of a source text's notes."""
    return code.static_estimate(code.from_source(spark, {"code": source}))


def cost_of(found: DataFrame, cores: int = 8) -> DataFrame:
    """Points, label and dollars of some findings."""
    total = found.agg(F.coalesce(F.sum("points"), F.lit(0)).alias("points"))
    return total.select("points", cost.label(F.col("points")).alias("label"), cost.from_points(F.col("points"), F.lit(cores)).alias("dollars"))


def resources(spark: SparkSession, sf_dir: str, current: DataFrame, plans: DataFrame) -> list[str]:
    """The snapshots that clients read, as temp views."""
    current.createOrReplaceTempView("issues_current")
    plans.createOrReplaceTempView("plans_last")
    billing_summary(spark, sf_dir).createOrReplaceTempView("billing_summary")
    return ["issues_current", "plans_last", "billing_summary"]
