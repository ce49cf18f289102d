"""Plan detectors over ``plan_nodes``: every costly shape is a filter, a self join on parent and child, or a grouping by plan.

Findings: (plan_id, node_id, type, name, points, table_name). Thresholds are parameters of ``Limits``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import size_in_bytes

MIB, GIB = 2.0**20, 2.0**30


@dataclass(frozen=True)
class Limits:
    """Sizes that findings depend on, and the cluster they are judged by."""

    small_side: float = 200 * MIB
    few_partitions: int = 10
    few_bytes: float = 500 * MIB
    default_partitions: int = 200
    default_bytes: float = 20 * GIB
    large_scan: float = 512 * MIB
    large_cache: float = 10 * GIB
    large_frame: float = 5 * GIB
    executor_memory: float = 8 * GIB
    workers: int = 2
    storage_share: float = 0.3


#: Points by finding, and the severities that points stand for.
POINTS = {
    "BroadcastHashJoin": ("join", 1), "BroadcastJoinSinglePartition": ("join", 60), "SortMergeJoin": ("join", 50), "BroadcastableSmallSide": ("join", 30), "ShuffledHashJoin": ("join", 30),
    "CartesianProduct": ("join", 1000), "BroadcastNestedLoopJoin": ("join", 80), "CrossJoin": ("join", 500), "SinglePartitionBottleneck": ("shuffle", 65), "Exchange": ("shuffle", 20),
    "TooFewShufflePartitions": ("partition", 50), "DefaultShufflePartitions": ("partition", 40), "MissingPartitionFilter": ("pushdown", 60), "CacheRescan": ("cache", 25), "CacheDiskSpill": ("cache", 70),
    "CacheDeserialized": ("cache", 30), "CacheMemorySpillRisk": ("cache", 80), "LargeCache": ("cache", 30), "LargeDfPersisted": ("cache", 25), "CsvRead": ("format", 40), "FirstWithoutOrdering": ("aggregation", 15),
    "SortAggregate": ("aggregation", 35), "GlobalWindow": ("window", 70), "UnionSchemaMismatch": ("union", 75), "RepeatedFileScan": ("cache", 30), "RepeatedTableScan": ("cache", 40), "MissingTableStatistics": ("statistics", 50),
}
SCANS = ("FileScan", "Scan", "BatchScan", "PhotonScan", "HiveTableScan")


def severity(points: Column) -> Column:
    return F.when(points >= 80, "critical").when(points >= 30, "warning").when(points >= 10, "info").otherwise("suggestion")


def table_of(detail: Column) -> Column:
    """The table or path that a scan reads; null if it has neither."""
    named = F.regexp_extract(detail, r"(?:FileScan|PhotonScan|BatchScan|Scan)\s+\w+\s+([\w.`]+\.[\w`]+)", 1)
    relation = F.regexp_extract(detail, r"(?:Relation|HiveTableScan)\s+([\w.`]+\.[\w`]+)", 1)
    path = F.regexp_extract(detail, r"Location:[^\[]*\[([^\]]+)\]", 1)
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(named), blank(relation), blank(path))


def _finding(rows: DataFrame, name: str, points: Column | None = None, table: Column | None = None) -> DataFrame:
    kind, own = POINTS[name]
    return rows.select(
        "plan_id", "node_id", F.lit(kind).alias("type"), F.lit(name).alias("name"), (F.lit(own) if points is None else points).cast("int").alias("points"), (F.lit(None).cast("string") if table is None else table).alias("table_name")
    )


def _once(rows: DataFrame) -> DataFrame:
    """The first row of each plan."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("plan_id").orderBy("node_id"))).filter("__k = 1").drop("__k")


def detect(nodes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All findings of single plans."""
    at = limits or Limits()
    n = nodes.withColumns({"size": size_in_bytes(F.col("detail")), "table": table_of(F.col("detail"))})
    op, detail = F.col("operator"), F.col("detail")
    scan = op.isin(*SCANS)
    single = detail.contains("SinglePartition")
    shuffle = op == "Exchange"
    count = F.expr(r"try_cast(nullif(regexp_extract(detail, 'partitioning\\(.*?,\\s*([0-9]+)\\)', 1), '') AS int)")
    biggest = F.max("size").over(Window.partitionBy("plan_id"))
    child = n.select("plan_id", F.col("parent_id").alias("node_id"), F.col("operator").alias("child"), F.col("size").alias("child_size"), F.col("detail").alias("child_detail"))
    out = []
    for name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "CartesianProduct"):
        out.append(_finding(n.filter(op == name), name))
    nested = op == "BroadcastNestedLoopJoin"
    out.append(_finding(n.filter(nested & ~detail.rlike(r"\bCross\b")), "BroadcastNestedLoopJoin"))
    out.append(_finding(n.filter(nested & detail.rlike(r"\bCross\b")), "CrossJoin"))
    joins = n.filter(op == "BroadcastHashJoin").select("plan_id")
    out.append(_finding(_once(n.filter(shuffle & single)).join(joins.distinct(), "plan_id", "left_semi"), "BroadcastJoinSinglePartition"))
    sides = n.filter(op == "SortMergeJoin").select("plan_id", "node_id").join(child.filter("child_size IS NOT NULL"), ["plan_id", "node_id"]).groupBy("plan_id", "node_id").agg(F.count("*").alias("sides"), F.min("child_size").alias("least"))
    out.append(_finding(sides.filter((F.col("sides") >= 2) & (F.col("least") < at.small_side)), "BroadcastableSmallSide"))
    out.append(_finding(_once(n.filter(shuffle & single)), "SinglePartitionBottleneck"))
    out.append(_finding(n.filter(shuffle & ~single), "Exchange"))
    parts = n.withColumn("count", count).withColumn("biggest", biggest).filter(shuffle & ~single & F.col("count").isNotNull())
    few = F.when(F.col("count") <= 1, 50).when((F.col("count") < at.few_partitions) & (F.col("biggest") > at.few_bytes), 35)
    out.append(_finding(parts.withColumn("few", few).filter("few IS NOT NULL"), "TooFewShufflePartitions", F.col("few")))
    out.append(_finding(parts.filter((F.col("count") == at.default_partitions) & (F.col("biggest") > at.default_bytes)), "DefaultShufflePartitions"))
    open_ = n.filter(scan & detail.contains("PartitionFilters: []") & F.col("table").rlike(r"^[\w`]+\.[\w.`]+$"))
    out.append(_finding(open_.groupBy("plan_id", "table").agg(F.min("node_id").alias("node_id")), "MissingPartitionFilter", table=F.col("table")))
    cached = n.filter(op.isin("InMemoryTableScan", "InMemoryRelation"))
    columns = F.regexp_extract("detail", r"\[([^\]]*)\]", 1)
    again = F.row_number().over(Window.partitionBy("plan_id", columns).orderBy("node_id"))
    out.append(_finding(cached.withColumn("k", again).filter("k = 2"), "CacheRescan"))
    level = cached.withColumn("level", F.lower(F.regexp_extract("detail", r"StorageLevel\(([^)]*)\)", 1)))
    disk, memory = F.col("level").contains("disk"), F.col("level").contains("memory")
    out.append(_finding(level.filter(disk & ~(memory & F.col("level").contains("deserialized"))), "CacheDiskSpill", F.when(memory, 70).otherwise(50)))
    out.append(_finding(level.filter(F.col("level").contains("deserialized") & ~disk), "CacheDeserialized"))
    capacity = at.executor_memory * max(at.workers, 1) * at.storage_share
    out.append(_finding(cached.filter(F.col("size") > capacity), "CacheMemorySpillRisk"))
    out.append(_finding(cached.filter((F.col("size") <= capacity) & ((F.col("size") > 0.7 * capacity) | (F.col("size") > at.large_cache))), "LargeCache"))
    out.append(_finding(cached.filter((F.col("size") <= 0.7 * capacity) & (F.col("size") > at.large_frame) & (F.col("size") <= at.large_cache)), "LargeDfPersisted"))
    out.append(_finding(n.filter(scan & detail.rlike(r"(?i)scan (?:csv|text)\b|Format: (?:CSV|Text)\b|\.csv\b")), "CsvRead", table=F.col("table")))
    out.append(_finding(n.filter(op.contains("Aggregate") & detail.rlike(r"\bfirst\(")), "FirstWithoutOrdering"))
    out.append(_finding(_once(n.filter(op == "SortAggregate")), "SortAggregate"))
    unbounded = (op == "Window") & detail.rlike(r"windowspecdefinition\((?:\w+#\d+L? (?:ASC|DESC)|specifiedwindowframe)")
    out.append(_finding(_once(n.filter(unbounded)), "GlobalWindow"))
    renamed = n.filter(op == "Union").select("plan_id", "node_id").join(child.filter(F.col("child_detail").rlike(r"(\w+)#\d+L? AS (?!\1#)\w+#\d+")), ["plan_id", "node_id"]).select("plan_id", "node_id").distinct()
    out.append(_finding(_once(renamed), "UnionSchemaMismatch"))
    twice = n.filter(scan & F.col("table").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "table").orderBy("node_id"))).filter("k = 2")
    out.append(_finding(twice, "RepeatedFileScan", F.when(F.col("size") > at.large_scan, 60).otherwise(30), F.col("table")))
    alias = F.regexp_extract("detail", r"^SubqueryAlias\s+([\w.`]+)", 1)
    aliases = n.filter((op == "SubqueryAlias") & ~alias.rlike(r"^(?:__|spark_catalog$)")).withColumn("alias", alias)
    out.append(_finding(aliases.withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "alias").orderBy("node_id"))).filter("k = 2"), "RepeatedTableScan", table=F.col("alias")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def missing_statistics(text: Column) -> Column:
    """Tables without statistics by the optimizer's section of a plan's text: named in a list, else as rows of a table, else as relations."""
    section = F.regexp_extract(text, r"(?is)==\s*Optimizer Statistics\s*==(.*?)(?:==\s*\w|\z)", 1)
    lines = F.split(section, "\n")

    def named(line: str, name: str) -> Column:
        return F.transform(F.filter(lines, lambda x: x.rlike(line)), lambda x: F.regexp_extract(x, name, 1))

    listed = F.flatten(F.transform(named(r"(?i)missing\s*=", r"(?i)missing\s*=\s*(.*)"), lambda x: F.split(x, ",")))
    ways = (listed, named(r"(?i)\|\s*missing\s*\|", r"\|\s*([\w.]+)\s*\|"), named(r"(?i)Statistics:\s*Not Available", r"(?i)Relation:\s*([\w.]+)"))
    found = [F.array_distinct(F.filter(F.transform(way, F.trim), lambda t: t != "")) for way in ways]
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(found[2])


def statistics_findings(plans: DataFrame) -> DataFrame:
    """``MissingTableStatistics`` of ``plans(plan_id, text)``, one a plan with the first table; node -1 stands for the whole plan."""
    kind, points = POINTS["MissingTableStatistics"]
    rows = plans.withColumn("tables", missing_statistics(F.coalesce("text", F.lit("")))).filter(F.size("tables") > 0)
    return rows.select("plan_id", F.lit(-1).alias("node_id"), F.lit(kind).alias("type"), F.lit("MissingTableStatistics").alias("name"), F.lit(points).alias("points"), F.col("tables")[0].alias("table_name"))


def deduplicated(found: DataFrame) -> DataFrame:
    """One finding a plan, name and table; of those without a table, none beside one that has it."""
    key = F.concat_ws(":", "name", "table_name")
    place = F.row_number().over(Window.partitionBy("plan_id", key).orderBy(F.col("table_name").isNull(), "node_id"))
    return found.withColumn("__k", place).filter("__k = 1").drop("__k")


def cross_plan_scans(nodes: DataFrame, limits: Limits | None = None) -> DataFrame:
    """What two plans or more read: path, plans, points, their names."""
    at = limits or Limits()
    scans = nodes.filter(F.col("operator").isin(*SCANS)).select("plan_id", table_of(F.col("detail")).alias("path"), size_in_bytes(F.col("detail")).alias("size")).filter("path IS NOT NULL")
    per = scans.groupBy("plan_id", "path").agg(F.max("size").alias("size"))
    out = per.groupBy("path").agg(F.count("*").alias("plans"), F.max("size").alias("size"), F.array_join(F.sort_array(F.collect_list("plan_id")), ",").alias("names"))
    return out.filter("plans >= 2").withColumn("points", F.when(F.col("size") > at.large_scan, 80).otherwise(40))
