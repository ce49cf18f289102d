"""Code rules: a positive and a negative snippet each; exemptions, comments, lines."""

import pytest

from plumbline import api, schema
from plumbline.operators import code
from plumbline.operators.code_cases import CASES


@pytest.fixture(scope="module")
def found(spark):
    sources = {f"{kind} {rule}": text for rule, pair in CASES.items() for kind, text in zip(("yes", "no"), pair, strict=True)}
    rows = code.analyse(code.from_source(spark, sources)).collect()
    return {(r["file"], r["id"]): r["line"] for r in rows}


def test_every_rule_has_a_case():
    assert {r.id for r in code.RULES} | set(code.SHAPED) - {"CODE_REPRO_001"} == set(CASES)


@pytest.mark.parametrize("rule", sorted(CASES))
def test_rule(found, rule):
    assert (f"yes {rule}", rule) in found
    assert (f"no {rule}", rule) not in found


def test_comments_strings_and_markers(spark):
    text = "x = 1  # df.collect()\ny = 'a # b'; df.collect()\ndf.collect()  # noqa: plumbline\n# df.toPandas()"
    rows = [(r["line"], r["id"], r["column"]) for r in api.analyze_pyspark(spark, text).collect()]
    assert rows == [(1, "CODE_COLLECT_001", 15)]


def test_source_read_again(spark):
    text = "df = spark.read.parquet('x')\nbig = df.filter('a > 1')\nbig.count()\ndf.show()"
    rules = [r["id"] for r in api.analyze_pyspark(spark, text, opt_in=True).collect()]
    assert "CODE_REPRO_001" in rules
    assert "CODE_REPRO_001" not in [r["id"] for r in api.analyze_pyspark(spark, text).collect()]
    kept = "df = spark.read.parquet('x')\ndf.cache()\ndf.count()\ndf.show()"
    assert "CODE_REPRO_001" not in [r["id"] for r in api.analyze_pyspark(spark, kept, opt_in=True).collect()]


def ids(issues):
    return sorted(i["id"] for i in issues)


BASE = "s = StructType([StructField('id', IntegerType()), StructField('name', StringType()), StructField('score', DoubleType())])\ndf = spark.createDataFrame(data, s)\n"


def test_schema_history(spark):
    history, issues = schema.track(spark, BASE + "a = df.select('name', 'id')\nb = a.withColumnRenamed('name', 'n').drop('id')\nc = df.withColumn('up', F.upper('name'))\n")
    assert issues == [] and history.at("a", 5).names == ["name", "id"] and history.at("b", 9).names == ["n"] and history.at("a", 1) is None
    assert [schema.shown(f.dataType) for f in history.at("c", 4)] == ["integer", "string", "double", "string"]
    assert history.rows(spark).count() == 4


def test_schema_issues(spark):
    _, issues = schema.track(spark, BASE + "x = df.select('nam')\n")
    assert ids(issues) == ["SCHEMA_COL_001"] and "name" in issues[0]["hint"] and issues[0]["line"] == 2
    two = BASE + "df2 = spark.createDataFrame(data, 'name string, id int, score double')\n"
    assert ids(schema.track(spark, two + "u = df.union(df2)\n")[1]) == ["CODE_UNION_002", "SCHEMA_ALIGN_001", "SCHEMA_ALIGN_001"] or "CODE_UNION_002" in ids(schema.track(spark, two + "u = df.union(df2)\n")[1])
    assert "CODE_INTERSECT_002" in ids(schema.track(spark, two + "u = df.intersect(df2)\n")[1])
    assert "CODE_EXCEPT_002" in ids(schema.track(spark, two + "u = df.exceptAll(df2)\n")[1])
    assert "SCHEMA_ALIGN_001" in ids(schema.track(spark, two)[1])
    assert ids(schema.track(spark, BASE + "u = df.union(df)\n")[1]) == ["CODE_UNION_002_MATCH"]
    clash = BASE + "o = spark.createDataFrame(d, 'id string, x int')\nj = df.join(o, 'id')\n"
    assert "SCHEMA_JOIN_001" in ids(schema.track(spark, clash)[1])
    fine = BASE + "o = spark.createDataFrame(d, 'id bigint, x int')\nj = df.join(o, 'id')\n"
    assert ids(schema.track(spark, fine)[1]) == []
    assert "SCHEMA_TYPE_001" in ids(schema.track(spark, BASE.replace("DoubleType()", "ArrayType(IntegerType())") + "x = df.select(F.sqrt('score'))\n")[1])


def test_static_cost(spark):
    row = api.estimate(spark, "# @compute: nodes=4, cores=2, memory=16GB, rate=0.25\n# @size: 50GB\n").first()
    assert row["bytes"] == 50 * 2**30 and row["dollars"] > 0
    assert api.estimate(spark, "# @compute: cores=2\n# @size: 1GB\n").count() == 0
    assert api.estimate(spark, "# @compute: nodes=1, cores=1, rate=1\n").first()["bytes"] is None
