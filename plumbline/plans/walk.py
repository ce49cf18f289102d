"""Physical plans as rows ``plan_nodes``: a walk over the JVM plan, so every node has one row and a stable id."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "plan_id string, node_id int, parent_id int, depth int, operator string, label string, detail string"
#: What operators are called for readers.
LABELS = {
    "FileScan": "Read", "PhotonScan": "Read", "Scan": "Read", "BatchScan": "Read", "LocalTableScan": "Local Data", "Exchange": "Shuffle", "HashAggregate": "Aggregate", "SortAggregate": "Aggregate",
    "ObjectHashAggregate": "Aggregate", "BroadcastHashJoin": "Hash Join", "SortMergeJoin": "Sort-Merge Join", "ShuffledHashJoin": "Hash Join", "BroadcastNestedLoopJoin": "Nested Join",
    "CartesianProduct": "Cartesian Product", "BroadcastExchange": "Broadcast", "Filter": "Filter", "Project": "Select", "Sort": "Sort", "Window": "Window", "Union": "Union",
    "TakeOrderedAndProject": "Top-N", "Limit": "Limit", "Generate": "Explode", "Expand": "Expand", "Deduplicate": "Distinct", "Output": "Output",
}
#: Names that another engine's plans have for operators of the same kind.
ALIASES = {
    "PhotonBroadcastHashJoin": "BroadcastHashJoin", "PhotonSortMergeJoin": "SortMergeJoin", "PhotonShuffledHashJoin": "ShuffledHashJoin",
    "PhotonShuffleExchangeSink": "Exchange", "PhotonShuffleExchangeSource": "Exchange",
}
#: Operators that only wrap others.
WRAPPERS = {
    "ColumnarToRow", "RowToColumnar", "InputAdapter", "AQEShuffleRead", "InputIteratorTransformer", "AdaptiveSparkPlan", "QueryStageInput", "ReusedExchange", "WholeStageCodegen",
    "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage",
}


def short(operator: str) -> str:
    """An operator's name without stage numbers and formats: ``FileScan parquet`` is ``FileScan``."""
    name = re.split(r"[ (\[]", operator.strip())[0]
    return {**ALIASES, "GlobalLimit": "Limit", "LocalLimit": "Limit", "CollectLimit": "Limit", "FileSourceScan": "FileScan"}.get(name, name)


def label(operator: str) -> str:
    return LABELS.get(short(operator), short(operator))


def _children(node) -> list:
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return [node.executedPlan()]
    if "QueryStage" in name:
        return [node.plan()]
    if name.startswith("ReusedExchange"):
        return []  # its rows are made once, where it is first
    found, out = node.children(), []
    for i in range(found.size()):
        out.append(found.apply(i))
    if name == "InMemoryTableScan":
        out.append(node.relation().cachedPlan())
    return out


def walk(df: DataFrame, plan_id: str = "plan") -> list[tuple]:
    """Rows of ``NODES`` for the frame's physical plan (the final one if it has run)."""
    rows: list[tuple] = []

    def visit(node, parent: int | None, depth: int) -> None:
        name = node.nodeName()
        own = parent
        if short(name) not in WRAPPERS:
            own = len(rows)
            rows.append((plan_id, own, parent, depth, short(name), label(name), node.simpleString(500)))
            depth += 1
        for child in _children(node):
            visit(child, own, depth)

    visit(df._jdf.queryExecution().executedPlan(), None, 0)
    return rows


def plan_nodes(*frames: DataFrame) -> DataFrame:
    """``plan_nodes`` of some frames: plan_0, plan_1 and on."""
    rows = [row for i, df in enumerate(frames) for row in walk(df, f"plan_{i}")]
    return frames[0].sparkSession.createDataFrame(rows, NODES)


def operators(df: DataFrame) -> list[str]:
    return [row[4] for row in walk(df)]


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The explain text, where no JVM is at hand."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def statistics(df: DataFrame) -> tuple[int, int | None]:
    """The optimizer's size in bytes, and row count if it knows one."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return int(str(stats.sizeInBytes())), int(str(rows.get())) if rows.isDefined() else None


def analyse_table(spark: SparkSession, name: str, columns: bool = False) -> DataFrame:
    """Renew a table's statistics (its name with or without catalog) and return what is known of it."""
    names = [name, name.split(".", 1)[1]] if name.count(".") == 2 else [name]
    found = next((n for n in names if spark.catalog.tableExists(n)), None)
    if found is None:
        raise ValueError(f"no table {name}")
    quoted = ".".join(f"`{p.strip('`')}`" for p in found.split("."))
    spark.sql(f"ANALYZE TABLE {quoted} COMPUTE STATISTICS{' FOR ALL COLUMNS' if columns else ''}")
    described = spark.sql(f"DESCRIBE EXTENDED {quoted}")
    pick = lambda key: F.max(F.when(F.col("col_name") == key, F.col("data_type")))
    facts = described.agg(pick("Provider").alias("provider"), pick("Type").alias("type"), pick("Statistics").alias("statistics"))
    number = lambda p: F.expr(f"try_cast(nullif(regexp_extract(statistics, '{p}', 1), '') AS bigint)")
    return facts.select("provider", "type", number(r"([0-9]+) bytes").alias("bytes"), number(r"([0-9]+) rows").alias("rows"))


def table_detail(df: DataFrame) -> DataFrame:
    """Bytes and files behind a frame, from the readers' own file metadata."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def cluster_facts(spark: SparkSession) -> DataFrame:
    """Executors, cores and memory, from the settings, else from what is running."""
    conf = spark.sparkContext.getConf()
    cores = int(conf.get("spark.executor.cores", "0") or 0) or spark.sparkContext.defaultParallelism
    workers = int(conf.get("spark.executor.instances", conf.get("spark.dynamicAllocation.maxExecutors", "1")))
    memory = conf.get("spark.executor.memory", conf.get("spark.driver.memory", "1g"))
    return spark.createDataFrame([(workers, cores, workers * cores, memory)], "workers int, cores_per_worker int, total_cores int, executor_memory string")


def captured(namespace: dict) -> dict[str, DataFrame]:
    """The frames of a namespace, each once."""
    out: dict[int, tuple[str, DataFrame]] = {}
    for name, value in namespace.items():
        if isinstance(value, DataFrame) and not name.startswith("_"):
            out.setdefault(id(value), (name, value))
    return dict(out.values())
