"""Snippets for each code rule: one that it fires on and one that it does not, as queries whose rows are the lines it has to name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..registry import query
from . import code

#: By rule: where it fires, where it does not.
CASES = {
    "CODE_UDF_001": ("f = udf(lambda x: x)", "f = F.upper('x')"),
    "CODE_COLLECT_001": ("x = df.collect()", "x = df.take(5)"),
    "CODE_PANDAS_001": ("p = df.toPandas()", "p = df.limit(5)"),
    "CODE_SCHEMA_001": ("spark.read.option('inferSchema', 'true').csv('x')", "spark.read.schema(s).csv('x')"),
    "CODE_FILTER_001": ("df.filter(a > 1).filter(b > 2)", "df.filter(a > 1)"),
    "CODE_COUNT_001": ("if df.count() > 0:", "n = df.count()"),
    "CODE_RDD_001": ("df.rdd.map(f)", "df.select('a')"),
    "CODE_COALESCE_001": ("df.coalesce(1)", "df.coalesce(10)"),
    "CODE_SHOW_001": ("df.show()", "df.show(5)"),
    "CODE_PERSIST_001": ("df.cache()", "df.select('cache')"),
    "CODE_CROSSJOIN_001": ("a.crossJoin(b)", "a.join(b, 'id')"),
    "CODE_ORDERBY_001": ("df.orderBy('a')", "df.groupBy('a')"),
    "CODE_REPARTITION_001": ("df.repartition(1)", "df.repartition(10)"),
    "CODE_PANDAS_UDF_001": ("@pandas_udf('int')", "@dataclass"),
    "CODE_TOPANDAS_SPARK_001": ("df.pandas_api()", "df.api()"),
    "CODE_DROP_DUP_001": ("df.dropDuplicates()", "df.dropDuplicates(['a'])"),
    "CODE_DISPLAY_001": ("display(df)", "my_display(df)"),
    "CODE_SQL_INJECT_001": ("spark.sql(f'select {x}')", "spark.sql('select 1')"),
    "CODE_WRITE_MODE_001": ("df.write.delta('t')", "df.write.mode('append').save('t')"),
    "CODE_NONDETERMINISTIC_UDF_001": ("f = udf(lambda x: random.random())", "f = udf(lambda x: x + 1)"),
    "CODE_DEPRECATED_APPEND_001": ("x.append(pd.DataFrame())", "x.append(1)"),
    "CODE_SELECT_STAR_001": ("df.select('*')", "df.select('a')"),
    "CODE_CHECKPOINT_001": ("df.checkpoint()", "df.point()"),
    "CODE_AQE_001": ("spark.conf.set('spark.sql.adaptive.enabled', 'false')", "spark.conf.set('spark.sql.adaptive.enabled', 'true')"),
    "CODE_UNION_001": ("a.union(b)", "a.unionByName(b)"),
    "CODE_ZORDER_001": ("spark.sql('OPTIMIZE t ZORDER BY (a)')", "spark.sql('OPTIMIZE t')"),
    "CODE_DYN_ALLOC_STREAM_001": ("spark.conf.set('spark.dynamicAllocation.enabled', 'true')", "spark.conf.set('spark.dynamicAllocation.enabled', 'false')"),
    "CODE_KAFKA_001": (".option('kafka.enable.auto.commit', 'true')", ".option('kafka.enable.auto.commit', 'false')"),
    "CODE_DBFS_CHECKPOINT_001": (".option('checkpointLocation', '/dbfs/x')", ".option('checkpointLocation', '/vol/x')"),
    "CODE_STREAM_DEDUP_001": ("s = spark.readStream.load()\ns.dropDuplicates(['a'])", "s = spark.read.load()\ns.dropDuplicates(['a'])"),
    "CODE_WINDOW_001": ("w = Window.orderBy('a')", "w = (Window.partitionBy('b')\n  .orderBy('a'))"),
    "CODE_DYN_PART_001": ("df.write.partitionBy('d')\n  .mode('overwrite')\n  .save('t')", "df.write\n  .mode('overwrite')\n  .save('t')"),
    "CODE_ANALYZE_001": ("spark.sql('INSERT OVERWRITE t SELECT 1')", "spark.sql('INSERT OVERWRITE t SELECT 1')\nspark.sql('ANALYZE TABLE t COMPUTE STATISTICS')"),
    "CODE_MERGE_DV_001": ("spark.sql('MERGE INTO t')", "spark.sql('MERGE INTO t')\nx = 'delta.enableDeletionVectors'"),
    "CODE_MERGE_RLC_001": ("spark.sql('MERGE INTO t')", "spark.sql('MERGE INTO t')\nx = 'delta.enableRowLevelConcurrency'"),
    "CODE_AUTOLOADER_RATE_001": ("x.format('cloudFiles')", "x.format('cloudFiles')\n.option('cloudFiles.maxBytesPerTrigger', '1g')"),
    "CODE_ROCKSDB_001": ("s = spark.readStream.load()\ns.groupBy('a')", "s = spark.readStream.load()\ns.groupBy('a')\nc = 'RocksDBStateStoreProvider'"),
    "CODE_STREAM_TRIGGER_001": ("q = df.writeStream\nq.start()", "q = df.writeStream\nq.trigger(once=True).start()"),
    "CODE_STREAM_WATERMARK_001": ("s = spark.readStream.load()\ns.groupBy('a')", "s = spark.readStream.load()\ns.withWatermark('t', '1 h')\ns.groupBy('a')"),
    "CODE_DROP_CREATE_001": ("spark.sql('DROP TABLE t')\nspark.sql('CREATE TABLE t')", "spark.sql('DROP TABLE t')"),
    "CODE_STREAM_QUERYNAME_001": ("q = df.writeStream\nq.start()", "q = df.writeStream.queryName('x')\nq.start()"),
    "CODE_FLOAT_FINANCIAL_001": ("StructField('price', DoubleType())", "StructField('unit_price', DoubleType())"),
    "CODE_MERGE_OPTIMIZE_001": ("spark.sql('MERGE INTO t')\nspark.sql('OPTIMIZE t')", "spark.sql('MERGE INTO t')"),
    "CODE_STREAM_JOIN_001": ("s = spark.readStream.load()\ns.join(d, 'id')", "s = spark.readStream.load()\ns.join(d, 'id', 'left')"),
    "CODE_DLT_PARTITION_001": ("@dlt.table(partition_cols=['a'])", "@other.table(partition_cols=['a'])"),
    "CODE_DLT_SELECT_STAR_001": ("@dlt.table\nspark.sql('SELECT * FROM t')", "spark.sql('SELECT * FROM t')"),
    "CODE_DLT_SCHEMA_HINTS_001": ("@dlt.table\nread_files('x')", "@dlt.table\nread_files('x',\n schemaHints => 'a int')"),
    "CODE_DLT_CLUSTER_AUTO_001": ("@dlt.table\nx = 'CLUSTER BY AUTO'", "x = 'CLUSTER BY AUTO'"),
    "CODE_ITER_COLLECT_001": ("for r in df.collect():", "for r in rows:"),
    "CODE_REPARTITION_WRITE_001": ("df.repartition(8)\n  .write.save('t')", "df.repartition(8)\n  .count()"),
    "CODE_FOREACH_001": ("df.foreach(f)", "df.for_each(f)"),
    "CODE_JOIN_001": ("a.join(b)", "a.join(b, 'id')"),
    "CODE_PARTITION_OVERWRITE_001": ("x.set('partitionOverwriteMode', 'static')", "x.set('partitionOverwriteMode', 'dynamic')"),
    "CODE_SHUFFLE_PARTITIONS_001": ("spark.conf.set('spark.sql.shuffle.partitions', 200)", "spark.conf.get('spark.sql.shuffle.partitions')"),
    "CODE_READ_FILES_SCHEMA_001": ("read_files('x')", "read_files('x', schema => 'a int')"),
    "CODE_WITHCOL_CHAIN_001": ("df = df.withColumn('a', x)\n\ndf = df.withColumn('b', x)\ndf = df.withColumn('c', x)", "df = df.withColumn('a', x)\ny = 1\ndf = df.withColumn('b', x)"),
    "CODE_WITHCOL_LOOP_001": ("for c in cols:\n    df = df.withColumn(c, x)", "for c in cols:\n    y = c\ndf = df.withColumn('a', x)"),
    "CODE_REPEATED_ACTIONS_001": ("sales.count()\nsales.show()", "sales.cache()\nsales.count()\nsales.show()"),
    "CODE_UDF_FILTER_001": ("f = udf(g)\ndf.filter(f('a'))", "f = udf(g)\ndf.select(f('a'))"),
    "CODE_DLT_CDC_ORDER_001": ("APPLY CHANGES INTO t\nSEQUENCE BY ts\nAPPLY AS DELETE WHEN x", "APPLY CHANGES INTO t\nAPPLY AS DELETE WHEN x\nSEQUENCE BY ts"),
}
#: Lines on which the first snippets fire, where that is not line 0.
LATER = {
    "CODE_STREAM_DEDUP_001": 1,
    "CODE_ROCKSDB_001": 1,
    "CODE_STREAM_WATERMARK_001": 1,
    "CODE_STREAM_JOIN_001": 1,
    "CODE_DLT_SELECT_STAR_001": 1,
    "CODE_DLT_SCHEMA_HINTS_001": 1,
    "CODE_DLT_CLUSTER_AUTO_001": 1,
    "CODE_DYN_PART_001": 1,
    "CODE_REPEATED_ACTIONS_001": 1,
    "CODE_UDF_FILTER_001": 1,
}
#: Statements over several lines: rule, text, line.
SPREAD = (
    ("CODE_FILTER_001", "x = 1\ndf.filter(a > 1)\n.filter(b > 2)", 1),
    ("CODE_FILTER_001", "y = (df\n  .filter(a > 1)  # first\n\n  .filter(b > 2))", 1),
    ("CODE_COLLECT_001", "rows = df.collect(\n)", 0),
    ("CODE_FLOAT_FINANCIAL_001", "s = StructType([\n  StructField('id', IntegerType()),\n  StructField(\n    'price',\n    DoubleType(),\n  ),\n])", 2),
    ("CODE_AQE_001", "spark.conf.set(\n  'spark.sql.adaptive.enabled',\n  'false'\n)", 0),
    ("CODE_SQL_INJECT_001", "spark.sql(\n  f'select {x}'\n)", 0),
    ("CODE_COALESCE_001", "df.write.mode('append') \\\n  .x().coalesce(\n 1)", 1),
    ("CODE_ITER_COLLECT_001", "for a, b in (df\n  .select('a', 'b')\n  .collect()):\n    pass", 0),
    ("CODE_MERGE_DV_001", "(t.alias('t')\n  .merge(s, 'a = b'))", 0),
)
#: Under ids of other editors: rule, text, line.
OTHERS = (
    ("CODE_SORT_001", "df.orderBy('a')", 0), ("CODE_STREAM_QUERY_NAME_001", "q = df.writeStream\nq.start()", 0), ("CODE_CHECKPOINT_DBFS_001", ".option('checkpointLocation', '/dbfs/x')", 0),
    ("CODE_KAFKA_COMMIT_001", ".option('kafka.enable.auto.commit', 'true')", 0), ("CODE_STREAMING_WATERMARK_001", "s = spark.readStream.load()\ns.groupBy('a')", 1), ("CODE_STREAMING_INNER_JOIN_001", "s = spark.readStream.load()\ns.join(d, 'id')", 1),
    ("CODE_DYNAMIC_ALLOC_001", "spark.conf.set('spark.dynamicAllocation.enabled', 'true')", 0), ("CODE_DELTA_DROP_CREATE_001", "spark.sql('DROP TABLE t')\nspark.sql('CREATE TABLE t')", 0), ("CODE_DELTA_MERGE_001", "t.merge(s, c)\\\n .execute()", 0),
    ("CODE_DELTA_OPTIMIZE_001", "spark.sql('INSERT INTO t SELECT 1')", 0), ("CODE_DLT_001", "x = dlt('t')", 0), ("CODE_OPTIMIZE_MERGE_001", "for t in ts:\n    merge(t)\n    t.optimize()", 1), ("CODE_STREAM_TRIGGER_ONCE_001", "q.trigger(once=True)", 0),
)
#: Sources read again: text, lines. The second frame is derived through eight assignments.
DERIVED = "df = spark.read.parquet('x')\n" + "".join(f"f{i + 1} = {'df' if i == 0 else f'f{i}'}.filter('a > {i}')\n" for i in range(8))
AGAIN = ((DERIVED + "f8.count()\ndf.show()", 10), ("df = spark.table('t')\ne = df\ne.count()\ne.first()", 3))


def _values(rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t(file, id, line)"


def _named(spark: SparkSession, texts: dict[str, str], **options) -> DataFrame:
    """Issues of the rule that a file is named after: ``rule`` or ``rule/more``."""
    found = code.analyse(code.from_source(spark, texts), **options)
    return found.filter(F.substring_index("file", "/", 1) == F.col("id")).select("file", "id", "line")


@query("code_rules", _values([(f"{rule}/yes", rule, LATER.get(rule, 0)) for rule in CASES]))
def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on its two snippets: a line of the first, none of the second."""
    return _named(spark, {f"{rule}/{kind}": text for rule, pair in CASES.items() for kind, text in zip(("yes", "no"), pair, strict=True)})


@query("code_rules_spread", _values([(f"{rule}/{i}", rule, line) for i, (rule, _, line) in enumerate(SPREAD)]))
def code_rules_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on statements over several lines."""
    return _named(spark, {f"{rule}/{i}": text for i, (rule, text, _) in enumerate(SPREAD)})


@query("code_rules_others", _values([(f"{rule}/x", rule, line) for rule, _, line in OTHERS]))
def code_rules_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of other editors."""
    return _named(spark, {f"{rule}/x": text for rule, text, _ in OTHERS}, more=True)


@query("code_repro", _values([(f"CODE_REPRO_001/{i}", "CODE_REPRO_001", line) for i, (_, line) in enumerate(AGAIN)]))
def code_repro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources read again, through assignments however many."""
    texts = {f"CODE_REPRO_001/{i}": text for i, (text, _) in enumerate(AGAIN)}
    return _named(spark, {**texts, "CODE_REPRO_001/cached": DERIVED + "df.cache()\nf8.count()\ndf.show()"}, opt_in=True)


FIELDS = "s = StructType([StructField('id', IntegerType()), StructField('name', StringType()), StructField('tags', ArrayType(IntegerType()))])\ndf = spark.createDataFrame(data, s)\n"
MIXED = FIELDS + "o = spark.createDataFrame(data, 'name string, id int, tags array<int>')\n"
#: Schema rules: what each stands for in a text.
SCHEMAS = {
    "SCHEMA_COL_001": FIELDS + "x = df.select('nam')\n",
    "SCHEMA_TYPE_001": FIELDS + "x = df.select(F.sqrt('tags'))\n",
    "SCHEMA_JOIN_001": FIELDS + "o = spark.createDataFrame(d, 'id string, x int')\nj = df.join(o, 'id')\n",
    "CODE_UNION_002": MIXED + "u = df.union(o)\n",
    "CODE_UNION_002_MATCH": FIELDS + "u = df.union(df)\n",
    "CODE_INTERSECT_002": MIXED + "u = df.intersect(o)\n",
    "CODE_EXCEPT_002": MIXED + "u = df.exceptAll(o)\n",
    "SCHEMA_ALIGN_001": MIXED,
}


@query("schema_rules", f"SELECT * FROM (VALUES {', '.join(f"('{rule}')" for rule in SCHEMAS)}) AS t(id)")
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that need column types: each is found in its own text."""
    found = sorted({(rule,) for rule, text in SCHEMAS.items() for issue in schema.track(spark, text)[1] if issue["id"] == rule})
    return spark.createDataFrame(found, "id string")
