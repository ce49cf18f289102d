"""The pipeline against the stages taken one by one, and the entry without these folders."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, step, sizes = docs.columns, docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf_dir)
        assert step.columns == columns
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] < sizes[0] and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in step.select("doc_id").collect()}


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark_leaks", "pack"]


def test_the_rest_works_without(tmp_path):
    kept = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=kept)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_materialised_tables_can_be_forgotten(spark):
    from plumbline.llm import common

    kept = common.materialise(spark.range(5), "forgettable")
    assert kept.count() == 5
    common.forget(spark)
    import pytest

    with pytest.raises(Exception, match="(?i)not.exist|FileNotFound"):
        kept.count()


def test_a_stage_leaves_no_tables_to_the_next(spark, sf_dir, tmp_path):
    """What a stage wrote for its result goes once the result has been written elsewhere; near copies keep the list of removed ids alone."""
    from pathlib import Path

    from plumbline.llm import common

    common.forget(spark)
    corpus_pipeline._open.clear()
    held = lambda: {p.name.rsplit("-", 1)[0] for p in Path(common._own_dir(spark).removeprefix("file://")).iterdir()}
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {"quality": "quality", "lines": "line-chunks", "near_copies": "near-gone", "benchmark_leaks": "leaked", "pack": "pieces"}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, sf_dir)
        assert left[name] in held() and not {v for k, v in left.items() if k != name} & held()
        assert name != "near_copies" or held() == {"near-gone"}
        out.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    then = corpus_pipeline.STAGES[1][1](spark, first, sf_dir)  # not written in between: its tables stay
    assert then.count() == spark.read.parquet(f"{tmp_path}/lines").count()


def all_leaks(docs, items):
    """Every alignment that shares enough equal tokens, window by window."""
    import re
    from collections import Counter, defaultdict

    from plumbline.llm import decontaminate as d

    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    wanted = [(j, cut(t)) for j, t in items]
    found = set()
    for i, text in docs:
        words, at = cut(text), defaultdict(list)
        for p, w in enumerate(words):
            at[w].append(p)
        for j, item in wanted:
            span = min(len(item), d.SPAN)
            diagonals = Counter(p - k for k, w in enumerate(item) for p in at.get(w, ()))
            for diagonal, n in diagonals.items():
                if len(item) >= d.WIDTH and n >= d.AGREE * span:
                    same = [0 <= diagonal + k < len(words) and words[diagonal + k] == w for k, w in enumerate(item)]
                    if max(sum(same[s : s + span]) for s in range(len(item) - span + 1)) >= d.AGREE * span:
                        found.add(i)
    return found


def test_each_stage_against_brute_force(spark, sf_dir):
    """Each stage on its own input: quality by SQL, lines and copies over all pairs, leaks over all alignments, packing by its rules."""
    import oracle
    from test_near_copies import groups
    from test_operators import slow_cut

    from plumbline.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    good = stage["quality"](spark, docs, sf_dir).cache()
    verdicts = oracle.duck(sf_dir).execute(queries.oracle_sql()["op10_quality_rules"]).df()
    assert {i for i, _ in texts(good)} == set(verdicts[verdicts.kept].doc_id)

    cut = stage["lines"](spark, good, sf_dir).cache()
    assert dict(texts(cut)) == slow_cut(texts(good))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    apart = stage["near_copies"](spark, cut, sf_dir).cache()
    gone = {i for i, _ in texts(cut)} - {i for i, _ in texts(apart)}
    must, may = groups(texts(cut), 0.8), groups(texts(cut), 0.45)
    assert gone <= may and len(must - gone) <= 0.03 * len(must)

    clean = stage["benchmark_leaks"](spark, apart, sf_dir).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {i for i, _ in texts(clean)} == {i for i, _ in texts(apart)} - all_leaks(texts(apart), items)

    packed = stage["pack"](spark, clean, sf_dir).collect()
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert {r["doc_id"] for r in packed} == {i for i, _ in texts(clean)} and max(used.values()) <= 2048
    assert len(used) <= 1.02 * sum(used.values()) / 2048 + 1
