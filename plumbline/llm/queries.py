"""The operator queries ``opN_<name>`` and the pipeline, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, html_extract, language_id, line_dedup, lm_scoring, oracles, packing, quality_rules, simhash_dedup, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*[common.table(spark, sf_dir, t) for t in tables])


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_html_extract": _on(html_extract.score, "pages"),
        "op2_simhash_dedup": _on(simhash_dedup.score, "documents"),
        "op3_toxicity": _on(toxicity.score, "documents", "labels"),
        "op4_line_dedup": _on(line_dedup.score, "documents"),
        "op5_lm_scoring": _on(lm_scoring.score, "documents"),
        "op6_decontaminate": _on(decontaminate.leaks, "documents", "benchmark"),
        "op7_substring_dedup": _on(substring_dedup.score, "documents"),
        "op8_language_id": _on(language_id.score, "documents"),
        "op9_packing": _on(packing.score, "documents"),
        "op10_quality_rules": _on(quality_rules.score, "documents"),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
