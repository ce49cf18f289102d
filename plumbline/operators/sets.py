"""Set operations by position and by name, and checks that both sides line up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

A_SQL, B_SQL = "SELECT c_custkey % 97 AS k, c_mktsegment AS s FROM customer WHERE c_acctbal > 4000", "SELECT c_custkey % 97 AS k, c_mktsegment AS s FROM customer WHERE c_acctbal < 7000"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    pick = [(F.col("c_custkey") % 97).alias("k"), F.col("c_mktsegment").alias("s")]
    return c.filter("c_acctbal > 4000").select(*pick), c.filter("c_acctbal < 7000").select(*pick)


OPERATIONS = {
    "set_union_all": ("UNION ALL", lambda a, b: a.union(b)),
    "set_union_distinct": ("UNION", lambda a, b: a.union(b).distinct()),
    "set_intersect": ("INTERSECT", lambda a, b: a.intersect(b)),
    "set_intersect_all": ("INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    "set_except": ("EXCEPT", lambda a, b: a.subtract(b)),
    "set_except_all": ("EXCEPT ALL", lambda a, b: a.exceptAll(b)),
}  # U1, U4, U5


def _operation(f):
    return lambda spark, sf_dir: f(*_sides(spark, sf_dir))


for _name, (_sql, _f) in OPERATIONS.items():
    query(_name, f"{A_SQL} {_sql} {B_SQL}")(_operation(_f))


@query("set_union_by_name", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in another order meet by name."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))


@query("set_union_missing", "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def set_union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of one side alone are null on the other."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


def alignment(left: list[str], right: list[str], operation: str = "union") -> tuple[str, str] | None:
    """Rule id and severity for two column lists that meet by position, or nothing to say.

    Same names in another order are critical for every operation; other names only for unions; a union whose sides agree is told that
    it is fine.
    """
    a, b = [c.lower() for c in left], [c.lower() for c in right]
    rule = {"union": "CODE_UNION_002", "intersect": "CODE_INTERSECT_002", "except": "CODE_EXCEPT_002"}[operation]
    if a == b:
        return (f"{rule}_MATCH", "suggestion") if operation == "union" else None
    if sorted(a) == sorted(b) or operation == "union":
        return rule, "critical"
    return None


SCHEMAS = "(1, 'a', 'id,name'), (2, 'b', 'name,id'), (3, 'c', 'id,name'), (4, 'd', 'id,email'), (5, 'e', 'id,name,score'), (6, 'f', 'score,name,id')"


@query(
    "schema_align",
    f"""SELECT l.var AS left_var, r.var AS right_var, l.cols = r.cols AS same_order, list_sort(string_split(l.cols, ',')) = list_sort(string_split(r.cols, ',')) AS same_set,
  array_to_string(list_sort(list_filter(string_split(r.cols, ','), lambda x: NOT list_contains(string_split(l.cols, ','), x))), ',') AS extra
FROM (VALUES {SCHEMAS}) AS l(line, var, cols) JOIN (VALUES {SCHEMAS}) AS r(line, var, cols) ON r.line = l.line + 1""",
)
def schema_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a list of frames: same order, same set, and what the right one has besides."""
    s = spark.sql(f"SELECT line, var, split(cols, ',') AS cols FROM VALUES {SCHEMAS} AS t(line, var, cols)")
    l, r = s.alias("l"), s.alias("r")
    same_set = F.sort_array("l.cols") == F.sort_array("r.cols")
    extra = F.array_join(F.sort_array(F.array_except("r.cols", "l.cols")), ",")
    return l.join(r, F.col("r.line") == F.col("l.line") + 1).select(
        F.col("l.var").alias("left_var"), F.col("r.var").alias("right_var"), (F.col("l.cols") == F.col("r.cols")).alias("same_order"), same_set.alias("same_set"), extra.alias("extra")
    )


@query(
    "schema_align_pairs",
    f"""SELECT l.var AS left_var, r.var AS right_var FROM (VALUES {SCHEMAS}) AS l(line, var, cols) JOIN (VALUES {SCHEMAS}) AS r(line, var, cols)
ON l.line < r.line AND list_sort(string_split(l.cols, ',')) = list_sort(string_split(r.cols, ',')) AND l.cols <> r.cols""",
)
def schema_align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the same columns in another order. The sorted list is the join key, so only such frames meet."""
    s = spark.sql(f"SELECT line, var, split(cols, ',') AS cols, sort_array(split(cols, ',')) AS key FROM VALUES {SCHEMAS} AS t(line, var, cols)")
    l, r = s.alias("l"), s.alias("r")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.line") < F.col("r.line")) & (F.col("l.cols") != F.col("r.cols"))
    return l.join(r, on).select(F.col("l.var").alias("left_var"), F.col("r.var").alias("right_var"))
