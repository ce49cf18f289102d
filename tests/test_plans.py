"""Plan walker, text parser and detectors, on live plans and on literal ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import api, registry
from plumbline.plans import detect, text, walk
from plumbline.plans.walk import operators

registry.load_all()
STRATEGIES = {
    "join_broadcast": "BroadcastHashJoin", "join_then_global": "BroadcastHashJoin", "join_sortmerge": "SortMergeJoin", "join_shuffle_hash": "ShuffledHashJoin", "join_cartesian": "CartesianProduct",
    "join_cross": "BroadcastNestedLoopJoin", "join_theta": "BroadcastNestedLoopJoin", "agg_hash": "HashAggregate", "agg_sort": "SortAggregate", "agg_object_hash": "ObjectHashAggregate", "agg_cube": "Expand",
    "win_row_number": "Window", "limit_ordered": "TakeOrderedAndProject", "fn_explode": "Generate", "set_union_all": "Union",
}


@pytest.mark.parametrize("name", sorted(STRATEGIES))
def test_operator_is_in_the_plan(spark, sf_dir, name):
    assert STRATEGIES[name] in operators(registry.QUERIES[name](spark, sf_dir))


def test_no_query_puts_all_rows_into_one_window(spark, sf_dir):
    nodes = walk.plan_nodes(registry.QUERIES["win_global"](spark, sf_dir))
    windows = nodes.filter("operator = 'Window' AND detail LIKE '%o_orderdate%'").collect()
    assert windows and all("__range" in w["detail"] for w in windows)


def test_hash_exchange_is_reused_by_the_aggregate(spark, sf_dir):
    assert operators(registry.QUERIES["exchange_hash"](spark, sf_dir)).count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = walk.explained(registry.QUERIES["join_then_global"](spark, sf_dir))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "o_orderpriority" not in plan


def test_udf_blocks_pushdown_and_a_builtin_does_not(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    late = F.udf(lambda s: s == "P", "boolean")
    assert "EqualTo(o_orderstatus" not in walk.explained(orders.filter(late("o_orderstatus")))
    assert "EqualTo(o_orderstatus,P)" in walk.explained(orders.filter("o_orderstatus = 'P'"))


def names(found):
    return sorted(r["name"] for r in found.collect())


def test_live_findings(spark, sf_dir):
    o, n = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    found = api.plan_analysis(o.join(o.hint("merge").select("o_orderkey"), "o_orderkey").select("o_custkey"))
    assert {"SortMergeJoin", "Exchange", "RepeatedFileScan"} <= set(names(found))
    assert "CartesianProduct" in names(api.plan_analysis(n.crossJoin(n.hint("shuffle_replicate_nl"))))
    assert "GlobalWindow" in names(api.plan_analysis(o.select(F.row_number().over(Window.orderBy("o_orderkey")))))
    assert "GlobalWindow" not in names(api.plan_analysis(o.select(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))))
    assert "CrossJoin" in names(api.plan_analysis(n.crossJoin(F.broadcast(n))))
    assert names(api.plan_analysis(o.filter("o_orderkey = 1").select("o_custkey"))) == []


TREE = """== Physical Plan ==
AdaptiveSparkPlan isFinalPlan=true
+- == Final Plan ==
   *(5) SortMergeJoin [a#1], [b#2], Inner
   :- *(2) Sort [a#1 ASC NULLS FIRST], false, 0
   :  +- Exchange hashpartitioning(a#1, 4), ENSURE_REQUIREMENTS
   :     +- FileScan parquet db.t[a#1] PartitionFilters: [], Statistics(sizeInBytes=10.0 MiB)
   +- *(4) Sort [b#2 ASC NULLS FIRST], false, 0
      +- Exchange hashpartitioning(b#2, 4), ENSURE_REQUIREMENTS
         +- FileScan parquet db.t[b#2] PartitionFilters: [], Statistics(sizeInBytes=600.0 MiB)
+- == Initial Plan ==
   SortMergeJoin [a#1], [b#2], Inner
   :- CartesianProduct
"""


def test_text_tree():
    rows = text.parse(TREE)
    assert [r[4] for r in rows] == ["SortMergeJoin", "Sort", "Exchange", "FileScan", "Sort", "Exchange", "FileScan"]
    assert [r[2] for r in rows] == [None, 0, 1, 2, 0, 4, 5]
    assert [r[3] for r in rows] == [0, 1, 2, 3, 1, 2, 3]


def test_text_findings(spark):
    found = {r["name"]: (r["points"], r["table_name"]) for r in api.plan_text_analysis(spark, {"p": TREE}).collect()}
    assert found["RepeatedFileScan"] == (60, "db.t") and found["MissingPartitionFilter"] == (60, "db.t")
    assert found["TooFewShufflePartitions"][0] == 35 and "CartesianProduct" not in found


def test_formatted_text_counts_each_operator_once(spark, sf_dir):
    plan = walk.explained(spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count())
    assert [r[4] for r in text.parse(plan)].count("Scan") == 1
    assert "RepeatedFileScan" not in names(api.plan_text_analysis(spark, {"p": plan}))


def rows_of(spark, *details):
    return spark.createDataFrame([("p", i, None if i == 0 else 0, 0, op, op, d) for i, (op, d) in enumerate(details)], walk.NODES)


@pytest.mark.parametrize(
    ("details", "name", "points"),
    [
        ([("InMemoryTableScan", "InMemoryRelation [a#1], StorageLevel(disk, 1 replicas)")], "CacheDiskSpill", 50),
        ([("InMemoryTableScan", "InMemoryRelation [a#1], StorageLevel(disk, memory, 1 replicas)")], "CacheDiskSpill", 70),
        ([("InMemoryTableScan", "InMemoryRelation [a#1], StorageLevel(memory, deserialized, 1 replicas)")], "CacheDeserialized", 30),
        ([("InMemoryTableScan", "InMemoryRelation [a#1]"), ("InMemoryTableScan", "InMemoryRelation [a#1]")], "CacheRescan", 25),
        ([("InMemoryTableScan", "x [a#1] sizeInBytes=100.0 GiB")], "CacheMemorySpillRisk", 80),
        ([("FileScan", "FileScan csv [a#1]")], "CsvRead", 40),
        ([("HashAggregate", "HashAggregate(keys=[], functions=[first(a#1)])")], "FirstWithoutOrdering", 15),
        ([("Union", "Union"), ("Project", "Project [a#1 AS b#2]")], "UnionSchemaMismatch", 75),
        ([("Exchange", "Exchange SinglePartition")], "SinglePartitionBottleneck", 65),
        ([("BroadcastHashJoin", "x"), ("Exchange", "Exchange SinglePartition")], "BroadcastJoinSinglePartition", 60),
        ([("Exchange", "Exchange hashpartitioning(a#1, 1)")], "TooFewShufflePartitions", 50),
        ([("Exchange", "Exchange hashpartitioning(a#1, 200)"), ("FileScan", "FileScan parquet sizeInBytes=30.0 GiB")], "DefaultShufflePartitions", 40),
        ([("SubqueryAlias", "SubqueryAlias t"), ("SubqueryAlias", "SubqueryAlias t")], "RepeatedTableScan", 40),
        ([("SortMergeJoin", "x"), ("FileScan", "FileScan parquet a.b sizeInBytes=10.0 MiB"), ("FileScan", "FileScan parquet a.c sizeInBytes=10.0 GiB")], "BroadcastableSmallSide", 30),
    ],
)
def test_literal_findings(spark, details, name, points):
    found = {r["name"]: r["points"] for r in detect.detect(rows_of(spark, *details)).collect()}
    assert found.get(name) == points


def test_default_cache_is_no_finding(spark):
    found = detect.detect(rows_of(spark, ("InMemoryTableScan", "InMemoryRelation [a#1], StorageLevel(disk, memory, deserialized, 1 replicas)")))
    assert names(found) == []


def test_cross_plan(spark):
    rows = [(p, 0, None, 0, "FileScan", "Read", d) for p, d in (("p1", "FileScan parquet db.t sizeInBytes=600.0 MiB"), ("p2", "FileScan parquet db.t sizeInBytes=1.0 MiB"), ("p2", "FileScan parquet db.u"))]
    found = detect.cross_plan_scans(spark.createDataFrame(rows, walk.NODES)).collect()
    assert [(r["path"], r["plans"], r["points"], r["names"]) for r in found] == [("db.t", 2, 80, "p1,p2")]


def test_sizes():
    assert text.memory_bytes("28g") == 28 * 2**30 and text.memory_bytes("512m") == 512 * 2**20 and text.memory_bytes("?") == 0
    assert text.human(1536) == "1.5 KiB"


def test_statistics_and_tables(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.mode("overwrite").saveAsTable("plumbline_nation")
    try:
        row = walk.analyse_table(spark, "spark_catalog.default.plumbline_nation", columns=True).first()
        assert row["rows"] == 25 and row["bytes"] > 0
    finally:
        spark.sql("DROP TABLE plumbline_nation")
    assert walk.table_detail(spark.read.parquet(f"{sf_dir}/nation.parquet")).first()["files"] == 1
    assert walk.cluster_facts(spark).first()["total_cores"] >= 1


def test_dry_run_runs_no_job(spark, sf_dir):
    code = f"""
df = spark.read.parquet('{sf_dir}/orders.parquet')
n = {{'a': df.count(), 'b': f'{{df.filter("o_orderkey > 5").count()}}'}}
if df.count() > 0:
    raise SystemError('an action ran')
df.groupBy('o_custkey').count().write.mode('overwrite').parquet('/nowhere')
"""
    nodes = api.run_dry(spark, code)
    assert "HashAggregate" in {r["operator"] for r in nodes.collect()}
    assert spark.range(3).count() == 3
