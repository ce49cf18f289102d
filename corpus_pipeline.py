"""From raw documents to packed training sequences: five stages, each one operator.

Each stage takes ``(spark, docs, sf_dir)``, reads all its predecessor kept and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Edge cases, each as the operator's docstring has it: null texts count as empty and fail the first stage's base rule; rows without an id are
judged by it too, and stay in the next three stages; rows that repeat an id are judged row by row and removed together as copies or
leaks; an empty table stays empty; extra columns are carried up to the last stage, which returns its own.

What a stage has written to shared storage for its result goes when the next stage is given files that lie elsewhere, as the result has been
written by then. It stays if the next stage reads it, or if two results of the stage are open in the application.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, decontaminate, line_dedup, near_copies, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside their cell's fences go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks seen before are cut out of texts."""
    return line_dedup.cut(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return near_copies.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of whole texts with their place in training sequences."""
    return packing.pack(docs)


ORDER = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", copies),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: For each application and stage, the tables that each of its results still reads.
_open: dict[tuple[str, int], list[list[str]]] = {}


def _in_turn(k: int, stage: Stage) -> Stage:
    """``stage``, which is the ``k``-th, with the tables of the one before removed if its result has been written elsewhere."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        before = _open.get((app, k - 1), [])
        if len(before) == 1 and (reads := common.read_from(docs)) is not None and not any(common.is_own(spark, p) for p in reads):
            common.remove(spark, before.pop())
            common.sweep(spark)
        with common.passing(spark) as keep:
            out = stage(spark, docs, sf_dir)
            _open.setdefault((app, k), []).append(keep.all())
        return out

    run.__doc__ = stage.__doc__
    return run


STAGES = [(name, _in_turn(k, stage)) for k, (name, stage) in enumerate(ORDER)]

#: XXH64, sketches and the tokenizer are out of SQL's reach; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in ORDER[:-1]:
        with common.passing(spark) as keep:
            after = keep(common.materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        common.drop(docs)
        docs = after
    return ORDER[-1][1](spark, docs, sf_dir)
