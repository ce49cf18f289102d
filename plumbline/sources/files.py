"""Readers and writers by format, and source code as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that plans name and that open-source Spark reads without further jars.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A path as a frame. With a schema nothing is inferred, so the input is read once."""
    if kind not in FORMATS:
        raise ValueError(f"{kind}: not one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", "true")
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str, by: tuple[str, ...] = (), mode: str = "error") -> None:
    """A frame to a path, in folders by some columns. Rows are dealt by those columns first, so that a folder gets few files."""
    rows = df.repartition(*by) if by else df
    writer = rows.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def code(spark: SparkSession, path: str) -> DataFrame:
    """``code_lines(file, line, text)`` of the Python files under a path."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("line", "text"))


def notebooks(spark: SparkSession, path: str) -> DataFrame:
    """``code_lines`` of the code cells of notebooks under a path, with ``cell`` and ``line_in_cell``; lines of a file run on over its cells."""
    from pyspark.sql import Window

    schema = "cells array<struct<cell_type: string, source: array<string>>>"
    books = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ipynb").json(path)
    cell = books.select(F.col("_metadata.file_path").alias("file"), F.posexplode("cells").alias("cell", "c")).filter("c.cell_type = 'code'")
    lines = cell.select("file", "cell", F.posexplode(F.split(F.array_join("c.source", ""), "\n", -1)).alias("line_in_cell", "text"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("cell", "line_in_cell")) - 1
    return lines.select("file", order.alias("line"), "text", "cell", "line_in_cell")


def ship(spark: SparkSession, *paths: str) -> None:
    """Local modules that a job imports, to all executors."""
    for path in paths:
        spark.sparkContext.addPyFile(path)
