"""Costs: points to labels and dollars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the cost model.
SECONDS_PER_POINT, CORES_PER_DBU, DBU_RATE, SERVERLESS_RATE, BYTES_PER_SECOND = 0.1, 4, 0.40, 0.70, 500 * 2.0**20
SEVERITY_POINTS = {"critical": 100, "warning": 30, "info": 5, "suggestion": 1}


def label(points: Column) -> Column:
    return F.when(points == 0, "none").when(points < 50, "low").when(points < 200, "medium").when(points < 500, "high").otherwise("very high")


def from_points(points: Column, cores: Column) -> Column:
    return points * SECONDS_PER_POINT * (cores / CORES_PER_DBU) * DBU_RATE / 3600


def from_bytes(size: Column, rate: float = SERVERLESS_RATE) -> Column:
    return size / BYTES_PER_SECOND / 3600 * rate


def from_duration(millis: Column, cores: Column) -> Column:
    return millis / 3.6e6 * (cores / CORES_PER_DBU) * DBU_RATE


def strategy(size: Column, millis: Column, points: Column, cores: Column) -> Column:
    """The first estimate that its input allows: bytes, duration, points."""
    return F.coalesce(from_bytes(F.nullif(size, F.lit(0))), from_duration(F.nullif(millis, F.lit(0)), cores), from_points(points, cores))


def breakdown(plan_issues: DataFrame, code_issues: DataFrame) -> DataFrame:
    """Join and shuffle points, code issues by severity; other plan issues do not count toward the total."""
    kind = F.col("type")
    plan = plan_issues.agg(F.coalesce(F.sum(F.when(kind == "join", F.col("points"))), F.lit(0)).alias("join_points"), F.coalesce(F.sum(F.when(kind == "shuffle", F.col("points"))), F.lit(0)).alias("shuffle_points"))
    weight = F.lit(0)
    for name, own in SEVERITY_POINTS.items():
        weight = F.when(F.col("severity") == name, own).otherwise(weight)
    code = code_issues.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("code_points"))
    out = plan.crossJoin(F.broadcast(code))  # one row each
    return out.withColumn("total", F.col("join_points") + F.col("shuffle_points") + F.col("code_points")).withColumn("label", label(F.col("total")))
