"""A small plan for each detector, as queries whose rows are the findings it has to give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import api
from ..registry import query
from . import detect, walk

CACHE = "InMemoryTableScan"
#: (finding, points, (operator, detail) of each node); the first node is the parent of the others.
SHAPES = (
    ("BroadcastHashJoin", 1, (("BroadcastHashJoin", "BroadcastHashJoin [a#1], [b#2], Inner, BuildRight"),)),
    ("BroadcastJoinSinglePartition", 60, (("BroadcastHashJoin", "x"), ("Exchange", "Exchange SinglePartition"))),
    ("SortMergeJoin", 50, (("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner"),)),
    ("BroadcastableSmallSide", 30, (("SortMergeJoin", "x"), ("FileScan", "FileScan parquet a.b sizeInBytes=10.0 MiB"), ("FileScan", "FileScan parquet a.c sizeInBytes=10.0 GiB"))),
    ("ShuffledHashJoin", 30, (("ShuffledHashJoin", "ShuffledHashJoin [a#1], [b#2], Inner, BuildLeft"),)),
    ("CartesianProduct", 1000, (("CartesianProduct", "CartesianProduct"),)),
    ("BroadcastNestedLoopJoin", 80, (("BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, LeftOuter"),)),
    ("CrossJoin", 500, (("BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, Cross"),)),
    ("SinglePartitionBottleneck", 65, (("Exchange", "Exchange SinglePartition"),)),
    ("Exchange", 20, (("Exchange", "Exchange hashpartitioning(a#1, 64)"),)),
    ("TooFewShufflePartitions", 50, (("Exchange", "Exchange hashpartitioning(a#1, 1)"),)),
    ("DefaultShufflePartitions", 40, (("Exchange", "Exchange hashpartitioning(a#1, 200)"), ("FileScan", "FileScan parquet sizeInBytes=30.0 GiB"))),
    ("MissingPartitionFilter", 60, (("FileScan", "FileScan parquet db.t[a#1] PartitionFilters: []"),)),
    ("CacheRescan", 25, ((CACHE, "InMemoryRelation [a#1]"), (CACHE, "InMemoryRelation [a#1]"))),
    ("CacheDiskSpill", 70, ((CACHE, "InMemoryRelation [a#1], StorageLevel(disk, memory, 1 replicas)"),)),
    ("CacheDeserialized", 30, ((CACHE, "InMemoryRelation [a#1], StorageLevel(memory, deserialized, 1 replicas)"),)),
    ("CacheMemorySpillRisk", 80, ((CACHE, "x [a#1] sizeInBytes=100.0 GiB"),)),
    ("LargeCache", 30, ((CACHE, "x [a#1] sizeInBytes=4.0 GiB"),)),
    ("CsvRead", 40, (("FileScan", "FileScan csv [a#1]"),)),
    ("FirstWithoutOrdering", 15, (("HashAggregate", "HashAggregate(keys=[], functions=[first(a#1)])"),)),
    ("SortAggregate", 35, (("SortAggregate", "SortAggregate(key=[a#1], functions=[max(b#2)])"),)),
    ("GlobalWindow", 70, (("Window", "Window [row_number() windowspecdefinition(a#1 ASC NULLS FIRST, specifiedwindowframe(RowFrame))]"),)),
    ("UnionSchemaMismatch", 75, (("Union", "Union"), ("Project", "Project [a#1 AS b#2]"))),
    ("RepeatedFileScan", 60, (("FileScan", "FileScan parquet db.t[a#1] sizeInBytes=600.0 MiB"), ("FileScan", "FileScan parquet db.t[b#2] sizeInBytes=600.0 MiB"))),
    ("RepeatedTableScan", 40, (("SubqueryAlias", "SubqueryAlias t"), ("SubqueryAlias", "SubqueryAlias t"))),
)
#: The one finding that wants a larger cluster than the default: nothing above five GiB is below 0.7 of 4.8 GiB.
ROOMY = detect.Limits(executor_memory=32 * detect.GIB)

PLAN = "== Physical Plan ==\nPhotonSortMergeJoin [a#1], [b#2], Inner\n:- PhotonShuffleExchangeSink hashpartitioning(a#1, 64)\n:  +- PhotonScan parquet db.a[a#1]\n+- PhotonScan parquet db.b[b#2]\n"
TEXTS = {
    "listed": PLAN + "\n== Optimizer Statistics ==\n  missing = db.a, db.b\n  full = \n",
    "rows": PLAN + "\n== Optimizer Statistics ==\n| table | rows |\n| db.b | missing |\n",
    "relations": PLAN + "\n== Optimizer Statistics ==\nRelation: db.c Statistics: Not Available\n== Notes ==\nmissing = db.z\n",
    "known": PLAN + "\n== Optimizer Statistics ==\n  full = db.a, db.b\n",
    "none": PLAN,
    "hash": "== Physical Plan ==\nPhotonShuffledHashJoin [a#1], [b#2], Inner\n:- PhotonScan parquet db.a[a#1]\n+- PhotonScan parquet db.b[b#2]\n",
    "broadcast": "== Physical Plan ==\nPhotonBroadcastHashJoin [a#1], [b#2], Inner\n:- PhotonScan parquet db.a[a#1]\n+- PhotonScan parquet db.b[b#2]\n",
}
EXPECTED = [(p, n, k) for p in ("listed", "rows", "relations", "known", "none") for n, k in (("SortMergeJoin", 50), ("Exchange", 20))] + [
    ("listed", "MissingTableStatistics", 50), ("rows", "MissingTableStatistics", 50), ("relations", "MissingTableStatistics", 50), ("hash", "ShuffledHashJoin", 30), ("broadcast", "BroadcastHashJoin", 1),
]


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t({columns})"


def _nodes(spark: SparkSession) -> DataFrame:
    rows = [(name, i, None if i == 0 else 0, min(i, 1), op, op, detail) for name, _, nodes in SHAPES for i, (op, detail) in enumerate(nodes)]
    return spark.createDataFrame(rows, walk.NODES)


@query("plan_shapes", _values([(name, points) for name, points, _ in SHAPES], "name, points"))
def plan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector in a plan of its own."""
    return detect.detect(_nodes(spark)).filter("name = plan_id").select("name", "points")


@query("plan_large_frame", _values([("LargeDfPersisted", 25)], "name, points"))
def plan_large_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of six GiB kept by executors that have room for it."""
    node = spark.createDataFrame([("p", 0, None, 0, CACHE, CACHE, "x [a#1] sizeInBytes=6.0 GiB")], walk.NODES)
    return detect.detect(node, ROOMY).select("name", "points")


@query("plan_text_rules", _values(EXPECTED, "plan_id, name, points"))
def plan_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan texts with the names of another engine, and their section of statistics."""
    return api.plan_text_analysis(spark, TEXTS).select("plan_id", "name", "points")
