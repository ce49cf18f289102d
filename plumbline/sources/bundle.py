"""Deployment bundles: YAML files as facts ``(file, path, key, value)``, and the tasks and targets in them."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "file string, path string, key string, value string"


def _walk(value, path: str) -> Iterator[tuple[str, str, str | None]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield path, str(k), None if isinstance(v, (dict, list)) else "" if v is None else str(v)
            yield from _walk(v, f"{path}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if not isinstance(v, (dict, list)):
                yield path, str(i), "" if v is None else str(v)
            yield from _walk(v, f"{path}/{i}")


def facts_of(texts: dict[str, str]) -> list[tuple[str, str, str, str | None]]:
    import yaml

    return [(name, *fact) for name, text in texts.items() for fact in _walk(yaml.safe_load(text) or {}, "")]


def read(root: str) -> dict[str, str]:
    """The bundle file and what its ``include`` patterns match, each once."""
    import yaml

    found: dict[str, str] = {}
    todo = [root]
    while todo:
        path = os.path.normpath(todo.pop())
        if path in found or not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8") as f:
            found[path] = f.read()
        for pattern in (yaml.safe_load(found[path]) or {}).get("include", []) or []:
            todo += sorted(glob.glob(os.path.join(os.path.dirname(path), pattern), recursive=True))
    return found


def facts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(facts_of(texts), FACTS)


def tasks(found: DataFrame) -> DataFrame:
    """(file, job, task, kind, source, cluster_key, spark_version): tasks with the cluster their key names (B1)."""
    at = r"^/resources/jobs/([^/]+)/tasks/(\d+)"
    rows = found.filter(F.col("path").rlike(at)).select("file", F.regexp_extract("path", at, 1).alias("job"), F.regexp_extract("path", at, 2).alias("i"), "path", "key", "value")
    pick = lambda c: F.max(F.when(c, F.col("value")))
    kinds = ("notebook_task", "spark_python_task", "python_wheel_task", "spark_jar_task", "sql_task", "pipeline_task")
    own = F.regexp_extract("path", rf"/tasks/\d+/({'|'.join(kinds)})$", 1)
    out = rows.groupBy("file", "job", "i").agg(
        pick((F.col("key") == "task_key") & F.col("path").rlike(at + "$")).alias("task"),
        F.max(F.nullif(own, F.lit(""))).alias("kind"),
        pick(F.col("key").isin("notebook_path", "python_file", "package_name", "main_class_name")).alias("source"),
        pick(F.col("key") == "job_cluster_key").alias("cluster_key"),
    )
    return out.join(clusters(found), ["file", "job", "cluster_key"], "left").drop("i")


def clusters(found: DataFrame) -> DataFrame:
    at = r"^/resources/jobs/([^/]+)/job_clusters/(\d+)"
    rows = found.filter(F.col("path").rlike(at)).select("file", F.regexp_extract("path", at, 1).alias("job"), F.regexp_extract("path", at, 2).alias("i"), "path", "key", "value")
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return rows.groupBy("file", "job", "i").agg(pick("job_cluster_key").alias("cluster_key"), pick("spark_version").alias("spark_version"), pick("num_workers").alias("num_workers")).drop("i")


def targets(found: DataFrame) -> DataFrame:
    at = r"^/targets/([^/]+)"
    rows = found.filter(F.col("path").rlike(at)).withColumn("target", F.regexp_extract("path", at, 1))
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return rows.groupBy("file", "target").agg(pick("mode").alias("mode"), pick("host").alias("host"))
