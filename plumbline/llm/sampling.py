"""Bounded training samples, drawn by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def bounded(rows: DataFrame, label: str, key: str, most: dict | int) -> DataFrame:
    """At most ``most`` rows of each ``label`` (a number, or one a label), those of the smallest hashes of ``key``, plus ``__rate``:
    the share of the label's rows that were drawn. Text columns can ride along: only drawn rows are moved.

    A first cut by hash keeps about an eighth more than is wanted of each label, so the ranking sees a bounded number of rows
    however large a label is.
    """
    sizes = common.materialise(rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n")), "label-sizes")
    if isinstance(most, dict):
        want = F.coalesce(*[F.when(F.col("__label") == k, F.lit(v)) for k, v in most.items()], F.lit(0))
    else:
        want = F.lit(most)
    sizes = common.maybe_broadcast(sizes.withColumn("__want", want))
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    drawn = rows.withColumn("__place", place).join(sizes, F.col(label) == F.col("__label"))
    drawn = drawn.filter(F.col("__place") <= 1.125 * F.col("__want") / F.col("__n") + 50.0 / F.col("__n"))
    ranked = drawn.withColumn("__rank", F.row_number().over(Window.partitionBy("__label").orderBy("__place", key)))
    rate = F.least(F.lit(1.0), F.col("__want") / F.col("__n")).alias("__rate")
    return ranked.filter("__rank <= __want").select(*rows.columns, rate)
