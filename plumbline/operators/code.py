"""Rules over PySpark source: a table of patterns, applied to ``code_lines(file, line, text)`` as flags and line frames.

A pattern is searched for in whole statements, which may run over many lines; a find belongs to the line that it begins on. A rule that looks
around itself is a maximum of a line's flag over a row frame, a rule about the whole file a maximum over the file. So all rules together are one
scan and one exchange by file, without Python. Comments are stripped first by a quote-aware expression; a line that carries ``MARKER`` is exempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import CODE_LINES_SQL, code_lines

MARKER = r"(?i)#\s*noqa: plumbline\b"
COMMENT = r"""^((?:[^"'#]|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')*)#.*$"""
STRING = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""


@dataclass(frozen=True)
class Rule:
    """``pattern`` on the line itself; ``near`` has to be found (``wanted``) or missing between lines ``frame``; the file has to match
    all of ``gates`` and none of ``barred``; ``once``: the first line of a file only; ``spared``: a find whose last word starts with one of
    these is none."""

    id: str
    severity: str
    title: str
    pattern: str
    near: str = ""
    frame: tuple[int, int] = (0, 0)
    wanted: bool = False
    also: str = ""
    gates: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()
    once: bool = False
    spared: tuple[str, ...] = ()


def phrases(*texts: str) -> str:
    """Pattern of any of some SQL phrases, however spaced and in either case."""
    return r"(?i)\b(?:" + "|".join(r"\s+".join(t.split()) for t in texts) + r")\b"


def methods(names: tuple[str, ...]) -> str:
    """Pattern of a call of any of some methods."""
    return rf"\.(?:{'|'.join(names)})\s*\("


#: Arguments of a call, with one level of calls inside.
ARGUMENTS = r"\([^()]*(?:\([^()]*\)[^()]*)*\)"
C, W, I = "critical", "warning", "info"
STREAM = r"\breadStream\b"
#: What tells a file of pipeline tables, stateful calls, join types, and what a writer may be asked without a mode.
PIPELINE_DECORATORS = ("table", "view", "temporary_view", "expect", "expect_or_drop", "expect_or_fail")
PIPELINE_PHRASES = (
    "APPLY CHANGES INTO", "CREATE LIVE", "CREATE STREAMING LIVE", "CREATE OR REPLACE LIVE", "CREATE OR REPLACE STREAMING LIVE",
    "CREATE MATERIALIZED VIEW", "CREATE STREAMING MATERIALIZED VIEW", "CREATE OR REPLACE MATERIALIZED VIEW", "CREATE OR REPLACE STREAMING MATERIALIZED VIEW",
)
STATEFUL = ("groupBy", "dropDuplicates", "flatMapGroupsWithState", "mapGroupsWithState")
JOIN_TYPES = ("left", "right", "outer", "full", "left_outer", "leftouter", "cross", "semi", "anti")
WRITER_METHODS = ("mode", "format", "option", "save", "partitionBy", "bucketBy", "sortBy", "insertInto", "jdbc", "json", "csv", "parquet", "orc", "text", "trigger", "outputMode")
PIPELINE = rf"@(?:dlt|dp)\.(?:{'|'.join(PIPELINE_DECORATORS)})\b|{phrases(*PIPELINE_PHRASES)}"
MERGE = rf"{phrases('MERGE INTO')}|\.alias\s*{ARGUMENTS}\s*\.merge\s*\("
#: Names of columns that hold money.
MONEY = "price|amount|revenue|cost|fee|total|balance|salary|rate|tax|discount|charge|payment|income|profit|loss|budget|spend|spending"
#: Rule ids, severities and the spellings they look for.
RULES = (
    Rule("CODE_UDF_001", I, "Python UDF", r"(?i)@udf|udf\s*\(|\.udf\.|F\.udf"),
    Rule("CODE_COLLECT_001", C, "All rows are pulled to the driver", r"\.collect\s*\(\s*\)"),
    Rule("CODE_PANDAS_001", W, "The frame is copied into the driver's memory", r"\.toPandas\s*\(\s*\)"),
    Rule("CODE_SCHEMA_001", I, "Schema inference reads the input twice", r"(?i)\.option\s*\(\s*[\"']inferSchema[\"']\s*,\s*[\"']true[\"']\s*\)"),
    Rule("CODE_FILTER_001", I, "Filters in a row can be one", r"\.filter\s*\([^)]+\)\s*\.filter\s*\("),
    Rule("CODE_COUNT_001", W, "A count only to compare it", r"\.count\s*\(\s*\)\s*[><=!]"),
    Rule("CODE_RDD_001", W, "RDD calls bypass the optimizer", r"\.rdd\."),
    Rule("CODE_COALESCE_001", W, "One partition does all the work", r"\.coalesce\s*\(\s*1\s*\)"),
    Rule("CODE_SHOW_001", I, "show() runs a job", r"\.show\s*\(\s*\)"),
    Rule("CODE_PERSIST_001", I, "A cache that has to be released", r"\.cache\s*\(\s*\)|\.persist\s*\("),
    Rule("CODE_CROSSJOIN_001", C, "Cross join", r"\.crossJoin\s*\("),
    Rule("CODE_ORDERBY_001", I, "A sort of all rows", r"\.orderBy\s*\(|\.sort\s*\("),
    Rule("CODE_REPARTITION_001", W, "All rows are shuffled into one partition", r"\.repartition\s*\(\s*1\s*\)"),
    Rule("CODE_PANDAS_UDF_001", I, "Pandas UDF", r"@pandas_udf|pandas_udf\s*\("),
    Rule("CODE_TOPANDAS_SPARK_001", I, "pandas API on Spark", r"\.to_pandas_on_spark\s*\(\s*\)|\.pandas_api\s*\(\s*\)"),
    Rule("CODE_DROP_DUP_001", W, "Duplicates over all columns", r"\.dropDuplicates\s*\(\s*\)|\.drop_duplicates\s*\(\s*\)"),
    Rule("CODE_DISPLAY_001", I, "display() runs a job", r"(?<!\w)display\s*\(\s*\w"),
    Rule("CODE_SQL_INJECT_001", C, "SQL text built from values", r"spark\.sql\s*\(\s*f['\"]|spark\.sql\s*\(\s*['\"].*\.format\s*\(|spark\.sql\s*\(\s*['\"].*%\s"),
    Rule("CODE_WRITE_MODE_001", I, "A write without a mode", r"\.write\s*\.\s*\w+", spared=WRITER_METHODS),
    Rule("CODE_NONDETERMINISTIC_UDF_001", W, "A UDF that answers differently each time", r"(?:udf|pandas_udf)\s*\(", r"random\.|rand\(|uuid|datetime\.now|time\.time", (0, 3), True),
    Rule("CODE_DEPRECATED_APPEND_001", W, "pandas append", r"\.append\s*\(\s*(?:pd\.|pandas\.)"),
    Rule("CODE_SELECT_STAR_001", I, "All columns are read", r"\.select\s*\(\s*['\"]?\*['\"]?\s*\)"),
    Rule("CODE_CHECKPOINT_001", W, "A checkpoint needs its folder", r"\.checkpoint\s*\(\s*\)"),
    Rule("CODE_AQE_001", W, "Adaptive execution is switched off", r"(?i)spark\.conf\.set\s*\(\s*[\"']spark\.sql\.adaptive\.enabled[\"']\s*,\s*(?:[\"']false[\"']|False)\s*\)"),
    Rule("CODE_UNION_001", W, "A union by position", r"\.union(?!ByName)\s*\("),
    Rule("CODE_ZORDER_001", I, "Z-ordering where clustering would do", r"(?i)\bZORDER\s+BY\b|\bZ-ORDER\s+BY\b"),
    Rule("CODE_DYN_ALLOC_STREAM_001", W, "Dynamic allocation under a stream", r"(?i)spark\.conf\.set\s*\(\s*[\"']spark\.dynamicAllocation\.enabled[\"']\s*,\s*(?:[\"']true[\"']|True\b)"),
    Rule("CODE_KAFKA_001", C, "Kafka commits offsets by itself", r"[\"']kafka\.enable\.auto\.commit[\"']\s*,\s*(?:[\"']true[\"']|True\b)"),
    Rule("CODE_DBFS_CHECKPOINT_001", W, "A stream checkpoint on DBFS", r"(?i)\.option\s*\(\s*[\"']checkpointLocation[\"']\s*,\s*[\"'](?:/dbfs/|dbfs:/)"),
    Rule("CODE_STREAM_DEDUP_001", I, "Stream duplicates are kept in state for ever", r"\.dropDuplicates\s*\(", gates=(STREAM,)),
    Rule("CODE_WINDOW_001", W, "A window without partitions", r"\bWindow\.orderBy\s*\(", r"\.partitionBy\s*\(", (-5, 0)),
    Rule("CODE_DYN_PART_001", I, "An overwrite of all partitions", r"\.mode\s*\(\s*[\"']overwrite[\"']\s*\)", r"\.partitionBy\s*\(", (-4, 4), True, also=r"\.write\b", barred=(r"(?i)partitionOverwriteMode[\"']\s*,\s*[\"']dynamic",)),
    Rule("CODE_ANALYZE_001", I, "Statistics are not renewed after an overwrite", r"(?i)INSERT\s+OVERWRITE\b|\.mode\s*\(\s*[\"']overwrite[\"']\s*\).*\.(?:saveAsTable|insertInto|save)\s*\(", r"(?i)\bANALYZE\s+TABLE\b", (0, 5)),
    Rule("CODE_MERGE_DV_001", I, "Merges without deletion vectors", MERGE, barred=(r"(?i)delta\.enableDeletionVectors",), once=True),
    Rule("CODE_MERGE_RLC_001", I, "Merges without row-level concurrency", MERGE, barred=(r"(?i)delta\.enableRowLevelConcurrency",), once=True),
    Rule("CODE_AUTOLOADER_RATE_001", I, "File ingestion without a rate limit", r"\.format\s*\(\s*[\"']cloudFiles[\"']\s*\)|\.option\s*\(\s*[\"']cloudFiles\.format[\"']", r"(?i)maxBytesPerTrigger", (-5, 10)),
    Rule("CODE_ROCKSDB_001", I, "Large state in executor memory", methods(STATEFUL), gates=(STREAM,), barred=(r"(?i)RocksDBStateProvider|RocksDBStateStoreProvider",), once=True),
    Rule("CODE_STREAM_TRIGGER_001", W, "A stream without a trigger", r"\.writeStream\b", r"\.trigger\s*\(", (0, 15), also=r"\.start\s*\(\s*\)"),
    Rule("CODE_STREAM_WATERMARK_001", W, "A stream aggregate without a watermark", r"\.groupBy\s*\(", r"\.withWatermark\s*\(", (-10, 0), gates=(STREAM,)),
    Rule("CODE_DROP_CREATE_001", W, "A table dropped to be created again", r"(?i)\bDROP\s+TABLE\b", r"(?i)\bCREATE\s+TABLE\b", (0, 5), True),
    Rule("CODE_STREAM_QUERYNAME_001", I, "A stream without a name", r"\.writeStream\b", r"\.option\s*\(\s*[\"']queryName[\"']|\.queryName\s*\(", (0, 15), also=r"\.start\s*\(\s*\)"),
    Rule("CODE_FLOAT_FINANCIAL_001", W, "Money in floating point", rf"(?i)StructField\s*\(\s*[\"'](?:{MONEY})[\"']\s*,\s*(?:Float|Double)Type\s*\(\s*\)"),
    Rule("CODE_MERGE_OPTIMIZE_001", W, "A merge with OPTIMIZE right after", r"(?i)\bMERGE\s+INTO\b", r"(?i)\bOPTIMIZE\b", (0, 5), True),
    Rule("CODE_STREAM_JOIN_001", W, "A stream joined so that rows drop", r"\.join\s*\(\s*\w+\s*,", phrases(*JOIN_TYPES), (0, 3), gates=(STREAM,)),
    Rule("CODE_DLT_PARTITION_001", W, "Partitioned pipeline table", r"(?i)\bPARTITION(?:ED)?\s+BY\b|\bpartition_cols\s*=", gates=(PIPELINE,)),
    Rule("CODE_DLT_SELECT_STAR_001", I, "SELECT * in a pipeline", r"(?i)\bSELECT\s+\*", gates=(PIPELINE,)),
    Rule("CODE_DLT_SCHEMA_HINTS_001", W, "read_files without schema hints", r"\bread_files\s*\(", r"schemaHints", (0, 5), gates=(PIPELINE,)),
    Rule("CODE_DLT_CLUSTER_AUTO_001", I, "Automatic clustering", r"(?i)\bCLUSTER\s+BY\s+AUTO\b", gates=(PIPELINE,)),
    Rule("CODE_ITER_COLLECT_001", C, "A loop over collected rows", r"\bfor\b[^:]+?\bin\b[^:]+?\.collect\s*\(\s*\)"),
    Rule("CODE_REPARTITION_WRITE_001", W, "A shuffle just before a write", r"\.repartition\s*\(\s*\d+", r"\.(?:write\b|saveAsTable\s*\(|insertInto\s*\()", (0, 4), True),
    Rule("CODE_FOREACH_001", I, "Rows are handled one by one", r"\.foreach\s*\("),
    Rule("CODE_JOIN_001", C, "A join without a condition", r"\.join\s*\(\s*\w+\s*\)"),
    Rule("CODE_PARTITION_OVERWRITE_001", I, "Static partition overwrite", r"(?i)partitionOverwriteMode[\"']\s*,\s*[\"']static"),
    Rule("CODE_SHUFFLE_PARTITIONS_001", I, "A fixed number of shuffle partitions", r"spark\.sql\.shuffle\.partitions[\"']\s*,"),
    Rule("CODE_READ_FILES_SCHEMA_001", I, "read_files without a schema", r"\bread_files\s*\(", r"(?i)schema", (0, 5)),
)
#: Ids under which editors of another kind report the same findings.
ALIASES = {
    "CODE_SORT_001": "CODE_ORDERBY_001", "CODE_STREAM_QUERY_NAME_001": "CODE_STREAM_QUERYNAME_001", "CODE_CHECKPOINT_DBFS_001": "CODE_DBFS_CHECKPOINT_001", "CODE_KAFKA_COMMIT_001": "CODE_KAFKA_001",
    "CODE_STREAMING_WATERMARK_001": "CODE_STREAM_WATERMARK_001", "CODE_STREAMING_INNER_JOIN_001": "CODE_STREAM_JOIN_001", "CODE_DYNAMIC_ALLOC_001": "CODE_DYN_ALLOC_STREAM_001", "CODE_DELTA_DROP_CREATE_001": "CODE_DROP_CREATE_001",
}
#: Rules of those editors alone; ``analyse`` adds them, and the other ids, on request.
MORE_RULES = (
    Rule("CODE_DELTA_MERGE_001", W, "A merge executed without clauses", r"\.merge\s*\([^)]*\)\s*\.execute\s*\("),
    Rule("CODE_DELTA_OPTIMIZE_001", I, "Inserts without OPTIMIZE", r"(?i)spark\.sql\s*\(.*INSERT\s+INTO\b(?!.*OPTIMIZE)"),
    Rule("CODE_DLT_001", I, "Pipeline tables want a schema and expectations", r"(?<![\w@.])dlt\s*\("),
    Rule("CODE_OPTIMIZE_MERGE_001", W, "OPTIMIZE after each merge of a loop", r"\bmerge\s*\(", gates=(r"OPTIMIZE|optimize\(", r"for\s+\w[\w,\s]*\s+in\s+|while\s+"), once=True),
    Rule("CODE_STREAM_TRIGGER_ONCE_001", I, "trigger(once=True) is deprecated", r"\.trigger\s*\(\s*once\s*="),
)
#: Rules that need more than one pattern and a frame; each has its own function below.
SHAPED = ("CODE_WITHCOL_LOOP_001", "CODE_WITHCOL_CHAIN_001", "CODE_REPRO_001", "CODE_UDF_FILTER_001", "CODE_REPEATED_ACTIONS_001", "CODE_DLT_CDC_ORDER_001")


def stripped(lines: DataFrame) -> DataFrame:
    """``code``: the line without its comment, empty for a null; ``exempt``: it carries the marker."""
    text = F.coalesce("text", F.lit(""))
    return lines.withColumns({"code": F.regexp_replace(text, COMMENT, "$1"), "exempt": text.rlike(MARKER)})


def statements(code: DataFrame) -> DataFrame:
    """``statement``: which one of its file a line belongs to. It goes on while a bracket outside strings is open, after a backslash, and on
    lines that are empty or start with a dot; a bracket that closes nothing counts as none."""
    w = Window.partitionBy("file").orderBy("line")
    bare = F.regexp_replace("code", STRING, "")
    opened = F.length(F.translate(bare, ")]}", "")) - F.length(F.translate(bare, "([{", ""))
    rows = code.withColumn("__sum", F.sum(opened).over(w))
    rows = rows.withColumn("__open", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w)))
    inside = (F.lag("__open", 1, 0).over(w) > 0) | F.lag("code", 1, "").over(w).endswith("\\") | F.col("code").rlike(r"^\s*(?:\.|$)")
    rows = rows.withColumn("__begins", (~inside).cast("int"))
    return rows.withColumn("statement", F.sum("__begins").over(w)).drop("__sum", "__open", "__begins")


def _around(flag: Column, frame: tuple[int, int]) -> Column:
    """Whether the flag is up on any line of the frame around this one."""
    return F.max(flag).over(Window.partitionBy("file").orderBy("line").rowsBetween(*frame))


def _anywhere(flag: Column) -> Column:
    return F.max(flag).over(Window.partitionBy("file"))


def allows(rule: Rule) -> Column:
    """Whether the lines around a line, and its file, let the rule fire on it."""
    own = ~F.col("exempt")
    if rule.near:
        found = _around(F.col("code").rlike(rule.near), rule.frame)
        own &= found if rule.wanted else ~found
    if rule.also:
        own &= _around(F.col("code").rlike(rule.also), rule.frame)
    for gate in rule.gates:
        own &= _anywhere(F.col("code").rlike(gate))
    for bar in rule.barred:
        own &= ~_anywhere(F.col("code").rlike(bar))
    return own


def finds(rule: Rule) -> Column:
    """Offsets in the statement ``code`` at which the rule's pattern is found."""
    between = F.split("code", rule.pattern, -1)
    hits = F.regexp_extract_all("code", F.lit(rule.pattern), F.lit(0))

    def step(done: Column, k: Column) -> Column:
        at = done["end"] + F.length(between[k])
        hit = hits[k]
        spared = F.lit(False)
        if rule.spared:
            spared = F.regexp_extract(hit, r"(\w+)$", 1).rlike(f"^(?:{'|'.join(rule.spared)})")
        return F.struct((at + F.length(hit)).alias("end"), F.when(spared, done["at"]).otherwise(F.concat(done["at"], F.array(at))).alias("at"))

    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    places = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), nothing, step)["at"]
    return F.when(F.col("code").rlike(rule.pattern), places).otherwise(F.array().cast("array<int>"))


def table_issues(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Issues of the table's rules: (file, line, column, id, severity, title), one a rule and line."""
    joined = F.regexp_replace("code", r"\\$", " ").alias("code")  # a backslash before a line break is white space
    code = statements(stripped(lines)).select("file", "line", "statement", joined, F.array(*[allows(r) for r in rules]).alias("allowed"))
    rows = code.groupBy("file", "statement").agg(F.sort_array(F.collect_list(F.struct("line", "code", "allowed"))).alias("rows"))
    whole = rows.select("file", "rows", F.array_join(F.col("rows.code"), "\n").alias("code"))

    def found(k: int, r: Rule) -> Column:
        def issue(at: Column) -> Column:
            before = F.left(F.col("code"), at)
            row = F.col("rows")[F.length(before) - F.length(F.translate(before, "\n", ""))]
            up = row["allowed"][k]
            return F.struct(row["line"].alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("column"), F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), F.lit(r.once).alias("once"), up.alias("up"))

        return F.transform(finds(r), issue)

    each = whole.select("file", F.inline(F.concat(*[found(k, r) for k, r in enumerate(rules)]))).filter("up")
    each = each.groupBy("file", "line", "id", "severity", "title", "once").agg(F.min("column").alias("column"))
    first = F.row_number().over(Window.partitionBy("file", "id").orderBy("line"))
    return each.withColumn("k", first).filter(~F.col("once") | (F.col("k") == 1)).select("file", "line", "column", "id", "severity", "title")


def _issue(rows: DataFrame, rule: str, severity: str, title: str) -> DataFrame:
    return rows.select("file", "line", F.lit(0).alias("column"), F.lit(rule).alias("id"), F.lit(severity).alias("severity"), F.lit(title).alias("title"))


def islands(rows: DataFrame, flag: Column, ignored: Column, least: int) -> DataFrame:
    """First lines of runs of at least ``least`` flagged lines (gaps and islands); lines of ``ignored`` do not break a run."""
    kept = rows.filter(~ignored)
    w = Window.partitionBy("file").orderBy("line")
    run = F.row_number().over(w) - F.sum(flag.cast("int")).over(w)
    runs = kept.withColumn("__flag", flag).withColumn("__run", run).filter("__flag")
    return runs.groupBy("file", "__run").agg(F.min("line").alias("line"), F.count("*").alias("length")).filter(F.col("length") >= least).select("file", "line", "length")


REASSIGN = r"^\s*(\w+)\s*=\s*\1\s*\.withColumn\s*\("


def withcol_chain(code: DataFrame) -> DataFrame:
    """Three withColumn calls or more: on one line, or by reassigning in consecutive statements (blank lines do not part them)."""
    runs = islands(code, F.col("code").rlike(REASSIGN), F.trim("code") == "", 3).select("file", "line")
    calls = F.size(F.regexp_extract_all("code", F.lit(r"(\.withColumn\s*\()"), F.lit(1)))
    starts = F.col("code").rlike(r"^\s*\.withColumn\s*\(")
    split_ = islands(code, starts, F.trim("code") == "", 3).select("file", "line")
    found = runs.union(code.filter(calls >= 3).select("file", "line")).union(split_).distinct()
    return _issue(found, "CODE_WITHCOL_CHAIN_001", W, "Columns are added one projection at a time")


def withcol_loop(code: DataFrame) -> DataFrame:
    """A withColumn inside the indented block of a for or while."""
    indent = F.length("code") - F.length(F.ltrim("code"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    loop = F.when(F.col("code").rlike(r"^\s*(?:for|while)\b.*:\s*$"), F.struct("line", indent.alias("indent")))
    shallow = lambda at: at
    rows = code.filter(F.trim("code") != "").withColumn("indent", indent).withColumn("loop", F.last(loop, ignorenulls=True).over(w))
    # the block ends at the first later line that is indented no deeper than the loop
    blocks = rows.withColumn("low", F.min("indent").over(Window.partitionBy("file", "loop").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    hit = shallow(blocks.filter(F.col("loop").isNotNull() & (F.col("low") > F.col("loop.indent")) & F.col("code").rlike(r"\.withColumn\s*\(")))
    return _issue(hit.select("file", F.col("loop.line").alias("line")).distinct(), "CODE_WITHCOL_LOOP_001", W, "A projection is added in each turn of a loop")


SOURCE = r"^\s*(\w+)\s*=\s*(?:\w+\.read\.|spark\.table\s*\(|spark\.sql\s*\(|spark\.createDataFrame\s*\()"
ACTION = r"\.(?:count|show|collect|first|take|toPandas|head|isEmpty|toLocalIterator|write|foreach|foreachPartition)\b"


def assignments(code: DataFrame) -> DataFrame:
    """(file, line, var, parent): ``var = parent.…`` or ``var = parent``; parent null for sources."""
    var = F.regexp_extract("code", r"^\s*(\w+)\s*=\s*[^=]", 1)
    parent = F.nullif(F.regexp_extract("code", r"^\s*\w+\s*=\s*(\w+)\s*(?:\.|\[|$)", 1), F.lit(""))
    rows = code.filter(var != "").select("file", "line", var.alias("var"), F.when(~F.col("code").rlike(SOURCE), parent).alias("parent"), F.col("code").rlike(SOURCE).alias("source"))
    return rows


def lineage(code: DataFrame) -> DataFrame:
    """(file, root, var): which variables are lazily derived from which source, through any number of assignments in the order of their lines."""
    a = assignments(code).filter("source OR parent IS NOT NULL")
    steps = a.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "var", "parent", "source"))).alias("steps"))

    def follow(known: Column, step: Column) -> Column:
        none = F.array().cast("array<string>")
        kept = F.coalesce(known[step["var"]], none)
        more = F.when(step["source"], F.array(step["var"])).otherwise(F.coalesce(known[step["parent"]], none))
        others = F.map_filter(known, lambda k, _: k != step["var"])
        return F.map_concat(others, F.create_map(step["var"], F.array_union(kept, more)))

    known = F.aggregate("steps", F.create_map().cast("map<string,array<string>>"), follow)
    pairs = steps.select("file", F.explode(known).alias("var", "roots"))
    return pairs.select("file", F.explode("roots").alias("root"), "var")


def repeated_reads(code: DataFrame) -> DataFrame:
    """Two actions or more on what derives from one read, unless it was cached before the second (opt-in)."""
    used = code.select("file", "line", F.col("code").rlike(ACTION).alias("action"), F.col("code").rlike(r"\.(?:cache|persist)\s*\(").alias("cached"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b(\w+)\s*\."), F.lit(1)))).alias("var"))
    hits = used.join(lineage(code), ["file", "var"]).groupBy("file", "root", "line").agg(F.max("action").alias("action"), F.max("cached").alias("cached"))
    w = Window.partitionBy("file", "root").orderBy("line")
    nth = hits.withColumn("n", F.sum(F.col("action").cast("int")).over(w)).withColumn("safe", F.max("cached").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    second = nth.filter("action AND n = 2 AND NOT safe").select("file", "line")
    return _issue(second, "CODE_REPRO_001", W, "The source is read again for each action")


def repeated_actions(code: DataFrame, near: int = 50) -> DataFrame:
    """A second action on one variable within ``near`` lines, without a cache before. Common names are left out."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b(\w+)\.(?:count|show|collect|first|take|toPandas|head|isEmpty|toLocalIterator)\s*[(\[]"), F.lit(1)))).alias("var")
    acts = code.select("file", "line", "exempt", found).filter(~F.col("var").isin("spark", "sc", "df", "self", "cls", "super", "True", "False", "None"))
    cached = code.select("file", F.col("line").alias("cache_line"), F.regexp_extract("code", r"\b(\w+)\b[^#]*\.(?:cache|persist)\s*\(", 1).alias("var")).filter("var <> ''").groupBy("file", "var").agg(F.min("cache_line").alias("cache_line"))
    w = Window.partitionBy("file", "var").orderBy("line")
    second = acts.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("line").over(w)).filter(f"n = 2 AND line - before <= {near} AND NOT exempt")
    open_ = second.join(cached, ["file", "var"], "left").filter("cache_line IS NULL OR cache_line > line").select("file", "line").distinct()
    return _issue(open_, "CODE_REPEATED_ACTIONS_001", W, "Each action computes the frame again")


def udf_names_of(code: DataFrame) -> DataFrame:
    """(file, name) of UDFs, assigned or decorated (the definition may be a docstring's line further down)."""
    assigned = F.regexp_extract("code", r"^\s*(\w+)\s*=\s*(?:udf|F\.udf|pandas_udf|functions\.udf)\s*\(", 1)
    decorated = code.withColumn("mark", F.max(F.col("code").rlike(r"@(?:F\.)?(?:udf|pandas_udf)\b")).over(Window.partitionBy("file").orderBy("line").rowsBetween(-2, -1)))
    defined = F.when(F.col("mark"), F.regexp_extract("code", r"^\s*def\s+(\w+)", 1))
    both = code.select("file", assigned.alias("name")).union(decorated.select("file", defined))
    return both.filter("name IS NOT NULL AND name <> ''").distinct()


def udf_in_filter(code: DataFrame) -> DataFrame:
    """A UDF called within two lines of a filter: nothing is pushed down."""
    calls = code.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("name"))
    hits = calls.join(udf_names_of(code), ["file", "name"]).select("file", F.explode(F.sequence(F.greatest(F.col("line") - 2, F.lit(0)), F.col("line"))).alias("line")).distinct()
    filters = code.filter(F.col("code").rlike(r"\.(?:filter|where)\s*\(") & ~F.col("exempt")).select("file", "line")
    return _issue(filters.join(hits, ["file", "line"], "left_semi"), "CODE_UDF_FILTER_001", W, "A UDF keeps the filter from being pushed down")


def cdc_order(code: DataFrame) -> DataFrame:
    """APPLY CHANGES INTO whose SEQUENCE BY stands before APPLY AS DELETE WHEN, in the next twenty lines."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(0, 20)
    place = lambda p: F.min(F.when(F.col("code").rlike(p), F.col("line") * 10_000 + F.regexp_instr("code", F.lit(p)))).over(w)
    rows = code.withColumns({"deleted": place(r"(?i)APPLY\s+AS\s+DELETE\s+WHEN"), "ordered": place(r"(?i)SEQUENCE\s+BY")})
    hit = rows.filter(F.col("code").rlike(r"(?i)\bAPPLY\s+CHANGES\s+INTO\b") & ~F.col("exempt") & (F.col("ordered") < F.col("deleted")))
    return _issue(hit, "CODE_DLT_CDC_ORDER_001", C, "Clauses of APPLY CHANGES out of order")


def analyse(lines: DataFrame, opt_in: bool = False, more: bool = False) -> DataFrame:
    """All code issues, one a rule and line; ``more``: with the rules of other editors."""
    code = stripped(lines)
    out = table_issues(lines, RULES + MORE_RULES * more)
    for shaped in (withcol_chain, withcol_loop, repeated_actions, udf_in_filter, cdc_order, *((repeated_reads,) if opt_in else ())):
        out = out.unionByName(shaped(code))
    if more:
        out = out.unionByName(renamed(out))
    return out.dropDuplicates(["file", "line", "id"])


def renamed(issues: DataFrame) -> DataFrame:
    """Issues that editors of another kind report under an id of their own, under that id."""
    own = F.create_map(*[F.lit(x) for other, id_ in ALIASES.items() for x in (id_, other)])
    return issues.withColumn("id", own[F.col("id")]).filter("id IS NOT NULL")


def from_source(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """``code_lines`` of some source texts."""
    rows = [(name, i, line) for name, text in sources.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line int, text string")


# --- the same machinery over the lines of whole documents, where DuckDB can follow it ---


@query("rule_point", f"WITH {CODE_LINES_SQL} SELECT file, line, CAST(len(regexp_extract_all(text, '\\bthe\\b')) AS INTEGER) AS hits FROM code_lines WHERE regexp_matches(text, '\\bthe\\b')")
def rule_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_lines(spark, sf_dir).filter(F.col("text").rlike(r"\bthe\b"))
    return rows.select("file", "line", F.size(F.regexp_extract_all("text", F.lit(r"(\bthe\b)"), F.lit(1))).alias("hits"))


def _frame(name: str, a: int, b: int, wanted: bool):
    near = "" if wanted else "NOT "
    at = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    sql = f"""WITH {CODE_LINES_SQL}, flagged AS (SELECT file, line, regexp_matches(text, '\\bthat\\b') AS own,
  MAX(CAST(regexp_matches(text, '\\bwith\\b') AS INTEGER)) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN {at(a)} AND {at(b)}) = 1 AS near FROM code_lines)
SELECT file, line FROM flagged WHERE own AND {near}near"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        near_ = _around(F.col("text").rlike(r"\bwith\b"), (a, b))
        rows = code_lines(spark, sf_dir).withColumn("near", near_ if wanted else ~near_)
        return rows.filter(F.col("near") & F.col("text").rlike(r"\bthat\b")).select("file", "line")

    return run


rule_lookback = _frame("rule_lookback", -5, 0, False)
rule_lookahead = _frame("rule_lookahead", 0, 4, True)


@query("rule_file_gate", f"WITH {CODE_LINES_SQL} SELECT file, line FROM (SELECT *, MAX(CAST(contains(text, 'the') AS INTEGER)) OVER (PARTITION BY file) AS gate FROM code_lines) AS t WHERE gate = 1 AND contains(text, ' of ')")
def rule_file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lines(spark, sf_dir).withColumn("gate", _anywhere(F.col("text").contains("the"))).filter(F.col("gate") & F.col("text").contains(" of ")).select("file", "line")


@query(
    "rule_withcol_islands",
    f"""WITH {CODE_LINES_SQL}, numbered AS (SELECT file, line, regexp_matches(text, 'ing\\b') AS flag, ROW_NUMBER() OVER (PARTITION BY file ORDER BY line) AS k FROM code_lines WHERE trim(text) <> ''),
runs AS (SELECT *, k - SUM(CAST(flag AS INTEGER)) OVER (PARTITION BY file ORDER BY line) AS run FROM numbered)
SELECT file, MIN(line) AS line, COUNT(*) AS length FROM runs WHERE flag GROUP BY file, run HAVING COUNT(*) >= 3""",
)
def rule_withcol_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(code_lines(spark, sf_dir), F.col("text").rlike(r"ing\b"), F.trim("text") == "", 3)


@query("first_assignment", f"WITH {CODE_LINES_SQL} SELECT file, word, MIN(line) AS line FROM (SELECT file, line, regexp_extract(text, '^([A-Z][a-z]+) ', 1) AS word FROM code_lines) AS t WHERE word <> '' GROUP BY file, word")
def first_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that starts with a name."""
    rows = code_lines(spark, sf_dir).select("file", "line", F.regexp_extract("text", r"^([A-Z][a-z]+) ", 1).alias("word"))
    return rows.filter("word <> ''").groupBy("file", "word").agg(F.min("line").alias("line"))


@query(
    "cell_remap",
    f"""WITH {CODE_LINES_SQL}, cells AS (SELECT file, CAST(line / 4 AS INTEGER) AS cell, COUNT(*) AS n FROM (SELECT file, line - line % 4 AS line FROM code_lines) AS a GROUP BY 1, 2),
starts AS (SELECT file, cell, n, SUM(n) OVER (PARTITION BY file ORDER BY cell) - n AS start FROM cells)
SELECT c.file, c.line, s.cell, CAST(c.line - s.start AS BIGINT) AS line_in_cell FROM code_lines c JOIN starts s ON c.file = s.file AND c.line >= s.start AND c.line < s.start + s.n""",
)
def cell_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of joined cells back to their cell: running sizes, then the cell whose range holds the line."""
    lines = code_lines(spark, sf_dir).select("file", "line")
    cells = lines.groupBy("file", F.floor(F.col("line") / 4).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    starts = cells.withColumn("start", F.sum("n").over(Window.partitionBy("file").orderBy("cell")) - F.col("n"))
    inside = (F.col("line") >= F.col("start")) & (F.col("line") < F.col("start") + F.col("n"))
    return lines.join(starts, "file").filter(inside).select("file", "line", "cell", (F.col("line") - F.col("start")).alias("line_in_cell"))


@query(
    "schema_asof",
    f"""WITH {CODE_LINES_SQL}, bindings AS (SELECT file, line, len(text) AS width FROM code_lines WHERE line % 3 = 0), uses AS (SELECT file, line FROM code_lines WHERE line % 2 = 1)
SELECT u.file, u.line, CAST(b.width AS INTEGER) AS width FROM uses u ASOF LEFT JOIN bindings b ON u.file = b.file AND u.line >= b.line""",
)
def schema_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest binding at or before a line."""
    from .joins import asof

    lines = code_lines(spark, sf_dir)
    bound = lines.filter("line % 3 = 0").select("file", "line", F.length("text").alias("width"))
    return asof(lines.filter("line % 2 = 1").select("file", "line"), bound, ["file"], "line", "line", "width", lambda n: F.floor(n / 256))


DESTINATION = r"\.(?:saveAsTable|insertInto|parquet|json|csv|orc|text|delta|avro|save|start|toTable)\s*\(\s*(?:path\s*=\s*)?[\"']([^\"']+)[\"']"


def write_operations(lines: DataFrame) -> DataFrame:
    """(file, line, var, is_streaming, destination) of ``.write`` and ``.writeStream``; the destination may stand up to five lines on."""
    code = stripped(lines)
    ahead = F.first(F.nullif(F.regexp_extract("code", DESTINATION, 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(0, 5))
    rows = code.withColumn("destination", ahead).withColumn("var", F.regexp_extract("code", r"\b(\w+)(?:\.\w+\([^)]*\))*\.write(?:Stream)?\b(?!\s*\()", 1))
    return rows.filter("var <> ''").select("file", "line", "var", F.col("code").rlike(r"\.writeStream\b").alias("is_streaming"), "destination")


SNIPPET = [
    "sales.write.mode('overwrite').parquet('/out/sales')", "log.write('x')", "clicks.writeStream", "  .format('delta').start('/out/clicks')", "clean = udf(lambda x: x)",
    "items.write.saveAsTable('db.items')", "rows = sales.collect()", "one = sales.repartition(1)", "if sales.count() > 0:", "    sales.show()",
]
SNIPPET_SQL = ", ".join("('f', {}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(SNIPPET))


def _snippet(spark: SparkSession) -> DataFrame:
    return from_source(spark, {"f": "\n".join(SNIPPET)})


@query("write_ops", "SELECT * FROM (VALUES ('f', 0, 'sales', false, '/out/sales'), ('f', 2, 'clicks', true, '/out/clicks'), ('f', 5, 'items', false, 'db.items')) AS t(file, line, var, is_streaming, destination)")
def write_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_operations(_snippet(spark))


@query("udf_names", f"SELECT file, regexp_extract(text, '^\\s*(\\w+)\\s*=\\s*udf\\s*\\(', 1) AS name FROM (VALUES {SNIPPET_SQL}) AS t(file, line, text) WHERE regexp_matches(text, '^\\s*\\w+\\s*=\\s*udf\\s*\\(')")
def udf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return udf_names_of(stripped(_snippet(spark)))


#: K1, K2, K5: what a quick fix replaces, by rule.
FIXES = {
    "CODE_COLLECT_001": (r"\.collect\s*\(\s*\)", ".take(1000)"),
    "CODE_REPARTITION_001": (r"\.repartition\s*\(\s*1\s*\)", ".coalesce(1)"),
    "CODE_COUNT_001": (r"(\w+)\.count\s*\(\s*\)\s*>\s*0", "not $1.isEmpty()"),
    "CODE_SHOW_001": (r"^(\s*)\w+\.show\s*\(\s*\)", "$1pass"),
    "CODE_DISPLAY_001": (r"^(\s*)display\s*\(.*\)", "$1pass"),
    "CODE_CROSSJOIN_001": (r"\.crossJoin\s*\(\s*(\w+)\s*\)", ".join($1, on='id')"),
    "CODE_AQE_001": (r"(spark\.sql\.adaptive\.enabled[\"']\s*,\s*)[\"']?[Ff]alse[\"']?", "$1'true'"),
}


def quick_fixes(lines: DataFrame) -> DataFrame:
    """Lines that some fix changes: (file, line, id, fixed)."""
    fixes = F.array(*[F.struct(F.lit(r).alias("id"), F.regexp_replace("text", p, to).alias("fixed")) for r, (p, to) in FIXES.items()])
    return lines.select("file", "line", "text", F.inline(fixes)).filter("fixed <> text").select("file", "line", "id", "fixed")


_FIX_SQL = " UNION ALL ".join(
    "SELECT file, line, '{}' AS id, regexp_replace(text, '{}', '{}', 'g') AS fixed, text FROM lines".format(r, p.replace("'", "''"), to.replace("$1", "\\1").replace("'", "''")) for r, (p, to) in FIXES.items()
)


@query("quick_fix", f"WITH lines(file, line, text) AS (VALUES {SNIPPET_SQL}) SELECT file, line, id, fixed FROM ({_FIX_SQL}) AS t WHERE fixed <> text")
def quick_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quick_fixes(_snippet(spark))


ANNOTATED = ["# @compute: nodes=4, cores=2, memory=16GB, rate=0.25", "a = spark.table('a')  # @size: 50GB", "# @size: 200MB", "b = spark.table('b')", "c = a.join(b, 'id')"]
ANNOTATED_SQL = ", ".join("({}, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(ANNOTATED))


def sizes(lines: DataFrame) -> DataFrame:
    """``@size`` notes with the variable of their line or else of the next one, in bytes (units are powers of 1024)."""
    w = Window.partitionBy("file").orderBy("line")
    note = r"@size:\s*([0-9.]+)\s*(KB|MB|GB|TB)"
    unit = F.regexp_extract("text", note, 2)
    factor = F.when(unit == "KB", 2.0**10).when(unit == "MB", 2.0**20).when(unit == "GB", 2.0**30).otherwise(2.0**40)
    name = lambda c: F.nullif(F.regexp_extract(c, r"^\s*(\w+)\s*=", 1), F.lit(""))
    rows = lines.withColumn("next", F.lead("text").over(w)).filter(F.col("text").rlike(note))
    return rows.select("file", "line", F.coalesce(name(F.col("text")), name(F.col("next"))).alias("var"), (F.regexp_extract("text", note, 1).cast("double") * factor).cast("long").alias("bytes"))


@query(
    "size_annotations",
    f"""WITH lines(line, text) AS (VALUES {ANNOTATED_SQL}), ahead AS (SELECT *, LEAD(text) OVER (ORDER BY line) AS next FROM lines)
SELECT 'f' AS file, line, COALESCE(NULLIF(regexp_extract(text, '^\\s*(\\w+)\\s*=', 1), ''), NULLIF(regexp_extract(next, '^\\s*(\\w+)\\s*=', 1), '')) AS var,
  CAST(CAST(regexp_extract(text, '@size:\\s*([0-9.]+)', 1) AS DOUBLE) * CASE regexp_extract(text, '@size:\\s*[0-9.]+\\s*(KB|MB|GB|TB)', 1) WHEN 'KB' THEN 1024.0 WHEN 'MB' THEN 1048576.0 WHEN 'GB' THEN 1073741824.0 ELSE 1099511627776.0 END AS BIGINT) AS bytes
FROM ahead WHERE regexp_matches(text, '@size:')""",
)
def size_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(from_source(spark, {"f": "\n".join(ANNOTATED)}))


@query(
    "static_cost",
    """SELECT 'f' AS file, 4 AS nodes, 2 AS cores, 0.25 AS rate, CAST(53896806400 AS BIGINT) AS bytes, ROUND(53896806400.0 * 2.0 / (500 * 1048576.0 * 4) / 3600, 9) AS hours,
  ROUND(53896806400.0 * 2.0 / (500 * 1048576.0 * 4) / 3600 * 4 * 0.25, 9) AS dollars""",
)
def static_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static_estimate(from_source(spark, {"f": "\n".join(ANNOTATED)}))


def static_estimate(lines: DataFrame, overhead: float = 2.0, mib_per_second: float = 500.0) -> DataFrame:
    """The ``@compute`` note priced over the sum of ``@size`` notes; no row without both ``nodes`` and ``rate``."""
    pairs = F.str_to_map(F.regexp_replace(F.regexp_extract("text", r"@compute:\s*(.*)$", 1), r"\s+", ""), F.lit(","), F.lit("="))
    spec = lines.filter(F.col("text").contains("@compute:")).select("file", pairs.alias("m")).select("file", F.expr("try_cast(m['nodes'] AS int)").alias("nodes"), F.expr("try_cast(m['cores'] AS int)").alias("cores"), F.expr("try_cast(m['rate'] AS double)").alias("rate"))
    total = sizes(lines).groupBy("file").agg(F.sum("bytes").alias("bytes"))
    hours = F.col("bytes") * overhead / (mib_per_second * 2.0**20 * F.col("nodes")) / 3600
    out = spec.dropna(subset=["nodes", "cores", "rate"]).join(total, "file", "left")
    return out.select("file", "nodes", "cores", "rate", "bytes", F.round(hours, 9).alias("hours"), F.round(hours * F.col("nodes") * F.col("rate"), 9).alias("dollars"))
