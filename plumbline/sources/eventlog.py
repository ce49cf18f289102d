"""Event logs as rows: SQL executions with their plans, and task figures by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXECUTION = "Event string, executionId long, description string, physicalPlanDescription string, time long"
TASK = "Event string, `Stage ID` int, `Task Metrics` struct<`Executor Run Time`: long, `Memory Bytes Spilled`: long, `Disk Bytes Spilled`: long>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all logs under a path, at any depth. Logs are text, one JSON object a line (no rolling, no compression)."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def executions(spark: SparkSession, path: str) -> DataFrame:
    """(file, execution_id, description, plan): executions that have a plan; lines that are no JSON are skipped.

    A substring test keeps the JSON parser off all other events; nothing is capped, files are read in splits.
    """
    found = lines(spark, path).filter(F.col("value").contains("SparkListenerSQLExecutionStart"))
    event = F.from_json("value", EXECUTION, {"mode": "PERMISSIVE"}).alias("e")
    plans = found.select("file", event).filter("e.physicalPlanDescription <> ''")
    return plans.select("file", F.col("e.executionId").alias("execution_id"), F.col("e.description").alias("description"), F.col("e.physicalPlanDescription").alias("plan"))


def task_figures(spark: SparkSession, path: str) -> DataFrame:
    """(file, stage, tasks, longest, mean, spilled): skew and spill by stage, from task metrics."""
    found = lines(spark, path).filter(F.col("value").contains("SparkListenerTaskEnd"))
    rows = found.select("file", F.from_json("value", TASK).alias("e")).select("file", F.col("e.`Stage ID`").alias("stage"), F.col("e.`Task Metrics`").alias("m"))
    run = F.col("m.`Executor Run Time`")
    return rows.groupBy("file", "stage").agg(F.count("*").alias("tasks"), F.max(run).alias("longest"), F.avg(run).alias("mean"), F.sum("m.`Disk Bytes Spilled`").alias("spilled"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The file last written under a path."""
    return lines(spark, path).agg(F.max_by("file", "modified").alias("file"))


def trivial(plan: str = "plan") -> F.Column:
    """Plans that only run a command or hold literals: they have neither a scan nor an exchange."""
    return ~F.col(plan).rlike(r"(?:Scan|Exchange|InMemoryRelation)") | F.col(plan).rlike(r"^\s*(?:== Physical Plan ==\s*)?Execute \w+Command")
