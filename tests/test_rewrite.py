"""Dry-run rewriting, quick fixes, files and notebooks."""

import json

import pytest

from plumbline import rewrite
from plumbline.operators import code
from plumbline.sources import files


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("x = df.collect()", "x = _capture(df)"),
        ("df.filter('a > 1').write.mode('append').save('t')", "_capture(df.filter('a > 1'))"),
        ("display(df)", "_capture(df)"),
        ('m = {"a": df[df.x == "v"].count(), "b": 1}', 'm = {"a": _capture(df[df.x == "v"]), "b": 1}'),
        ('print("(x)", df.count(), y)', 'print("(x)", _capture(df), y)'),
        ("process(df.filter('x').collect(), other)", "process(_capture(df.filter('x')), other)"),
        ("if df.count() > 0:\n    pass", "if _capture(df) > 0:\n    pass"),
        ("f = f'{df.count()}'", "f = f'{_capture(df)}'"),
        ("func(df.write.saveAsTable('t'))", "func(_capture(df))"),
        ("q.awaitTermination()", "None"),
        ("y = df.select('a')", "y = df.select('a')"),
        ("%sh echo hello", "# [skipped] % sh echo hello"),
        ("!ls", "# [skipped] !ls"),
        ("%python\ndf = 1", "\ndf = 1"),
        ("a = 1\n%sh\necho b\n# COMMAND ----------\ndf.count()", "a = 1\n# [skipped] % sh\n# [skipped] echo b\n# COMMAND ----------\n_capture(df)"),
        ("# MAGIC %sh echo", "# [skipped] % sh echo"),
    ],
)
def test_neutralised(source, want):
    assert rewrite.neutralised(source) == want


def test_chains_keep_line_numbers():
    out = rewrite.neutralised('q = (df.writeStream\n  .outputMode("append")\n  .foreachBatch(lambda b, i: b.count())\n  .start())\nx = 1').split("\n")
    assert out[4] == "x = 1" and "_capture(df" in out[0] and "start" not in "".join(out)


def test_fixes():
    assert rewrite.broadcast_hint("a.join(b, 'id')", "b").endswith("a.join(broadcast(b), 'id')")
    assert rewrite.persisted("df = x.y()\ndf.count()", "df") == "df = x.y()\ndf.persist()\ndf.count()"
    assert rewrite.watermarked("s.groupBy('a')") == "s.withWatermark('event_time', '10 minutes').groupBy('a')"
    assert rewrite.suppressed("a\nb", 1) == "a\nb  # noqa: plumbline"


def test_rules_of_other_editors(spark):
    text = "dt.merge(s, 'x').execute()\nspark.sql('INSERT INTO t SELECT 1')\nfor x in y:\n    t.merge(s)\n    spark.sql('OPTIMIZE t')"
    found = {r["id"] for r in code.analyse(code.from_source(spark, {"f": text}), more=True).collect()}
    assert {"CODE_DELTA_MERGE_001", "CODE_DELTA_OPTIMIZE_001", "CODE_OPTIMIZE_MERGE_001"} <= found
    assert set(code.ALIASES.values()) <= {r.id for r in code.RULES}


@pytest.mark.parametrize("kind", files.FORMATS)
def test_formats(spark, tmp_path, kind):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = rows.select("k") if kind == "text" else rows
    files.write(rows, str(tmp_path / "out"), kind)
    back = files.read(spark, str(tmp_path / "out"), kind, None if kind in ("parquet", "orc") else "k string" if kind == "text" else "k string, v int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="not one of"):
        files.read(spark, "x", "delta")


def test_partitioned_writes_are_pruned(spark, tmp_path):
    from plumbline.plans import walk

    files.write(spark.range(10).selectExpr("id", "id % 2 AS k"), str(tmp_path / "out"), "parquet", by=("k",))
    found = files.read(spark, str(tmp_path / "out"), "parquet").filter("k = 1")
    assert "PartitionFilters: [isnotnull(k" in walk.explained(found) and found.count() == 5


def test_code_and_notebooks(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\r\ny = df.collect()\n")
    lines = files.code(spark, str(tmp_path))
    assert [(r["line"], r["text"]) for r in lines.orderBy("line").collect()] == [(0, "x = 1"), (1, "y = df.collect()"), (2, "")]
    book = {"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "code", "source": ["c = 3"]}]}
    (tmp_path / "n.ipynb").write_text(json.dumps(book))
    rows = files.notebooks(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["cell"], r["line_in_cell"], r["text"]) for r in rows] == [(0, 1, 0, "a = 1"), (1, 1, 1, "b = 2"), (2, 2, 0, "c = 3")]


def test_running_state(spark, sf_dir, tmp_path):
    from plumbline.streaming import queries as streams

    seen = {}
    rows = streams.running_totals(streams.events(spark, sf_dir))
    rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).foreachBatch(lambda df, i: seen.update({r["user_id"]: r["n"] for r in df.collect()})).start().awaitTermination()
    want = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()}
    assert seen == want


def test_issues_under_other_ids(spark):
    from plumbline.operators import code, issues

    lines = code.from_source(spark, {"a.py": 'x = df.orderBy("a")\nspark.sql("DROP TABLE t")\nspark.sql("CREATE TABLE t AS SELECT 1")'})
    plain, more = ({r["id"] for r in code.analyse(lines, more=m).collect()} for m in (False, True))
    for other, own in code.ALIASES.items():
        assert other not in plain and (other in more) == (own in more)
    assert {"CODE_SORT_001", "CODE_DELTA_DROP_CREATE_001"} & more
    money = code.from_source(spark, {"b.py": 'StructField("spending", DoubleType())\nStructField("rate", FloatType())\nStructField("name", DoubleType())'})
    assert sorted(r["line"] for r in code.analyse(money).collect() if r["id"] == "CODE_FLOAT_FINANCIAL_001") == [0, 1]
    classes = [r["class"] for r in issues.error_class(spark, "").orderBy("id").collect()]
    assert classes == ["auth_error", "timeout", "network_error", "other", "syntax_error", "import_error", "spark_analysis_error", "other", "other", "timeout", "oom", "import_error", "other", "auth_error"]
