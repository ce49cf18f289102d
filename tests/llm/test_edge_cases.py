"""Odd rows, empty tables and clashing names through every operator and stage."""

import corpus_pipeline
import pytest

from plumbline.llm import decontaminate, html_extract, language_id, line_dedup, lm_scoring, packing, quality_rules, simhash_dedup, substring_dedup, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None), (8, 0, 0)], "doc_id long, quality long, toxic long")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "too short"), (None, "a b c d e f g h i j k l")], "item_id long, text string")


def per_row(name):
    return {
        "op2": lambda d, b, l: simhash_dedup.score(d), "op3": lambda d, b, l: toxicity.score(d, l), "op4": lambda d, b, l: line_dedup.score(d), "op5": lambda d, b, l: lm_scoring.score(d),
        "op7": lambda d, b, l: substring_dedup.score(d), "op8": lambda d, b, l: language_id.score(d), "op10": lambda d, b, l: quality_rules.score(d),
    }[name]


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op7", "op8", "op10"])
def test_one_row_for_each_row(odd, empty, benchmark, labels, name):
    rows = per_row(name)(odd, benchmark, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert per_row(name)(empty, benchmark, labels).count() == 0


def test_other_operators(odd, empty, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, benchmark).collect()}
    assert found == {(5, 1)}
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    assert packing.pack(empty).count() == 0
    packed = packing.pack(odd).collect()
    assert sum(r["piece"] == 0 for r in packed) == odd.count()
    assert sorted(r["length"] for r in packed if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, empty, benchmark, tmp_path, k):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, str(tmp_path))
    assert (out.columns == odd.columns) or k == 4
    assert out.count() > 0
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/x", ""), (3, "http://a/y", "<p>a&nbsp;b<br>c &lt;d"), (3, "http://a/y", "<p>a&nbsp;b<br>c &lt;d"), (None, "::bad::", "<div>" * 500 + "deep"), (5, "http://a/z", "<!-- open"), (6, None, "<script>var a = '<p>no</p>'")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_extract.score(pages).collect()
    texts = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out)
    assert texts == [(0, "deep", 4), (1, "", 0), (2, "", 0), (3, "a b c <d", 8), (3, "a b c <d", 8), (5, "", 0), (6, "", 0)]
    assert html_extract.score(pages.limit(0)).count() == 0
