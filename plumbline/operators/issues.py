"""Issues as rows: severities, suppression, roll-ups, suggestions, error classes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query

#: Severities by priority.
SEVERITIES = ("critical", "warning", "info", "suggestion")
ISSUES_SQL = """(VALUES (1, 'f', 10, 'CODE_UNION_001', 'warning', 0), (2, 'f', 10, 'CODE_UNION_002', 'critical', 0), (3, 'f', 12, 'CODE_UNION_001', 'warning', 0), (4, 'f', 14, 'CODE_UNION_002_MATCH', 'suggestion', 0),
  (5, 'f', 14, 'CODE_UNION_001', 'warning', 0), (6, 'f', 20, 'CODE_SHOW_001', 'info', 0), (7, 'f', 20, 'CODE_SHOW_001', 'info', 0), (8, 'g', 10, 'CODE_UNION_001', 'warning', 0), (9, 'g', 3, 'CODE_COLLECT_001', 'critical', 50)) AS t(seq, file, line, id, severity, points)"""


def _issues(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {ISSUES_SQL}".replace("(VALUES", "VALUES", 1).replace("50)) AS t", "50) AS t"))


def rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], 1)
    for i, s in enumerate(SEVERITIES[1:], 2):
        out = out.when(severity == s, i)
    return out


RANK_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES, 1)) + " END"


def suppressed(issues: DataFrame) -> DataFrame:
    """One a file, rule and line; the general union warning goes where a precise union finding stands on the line."""
    precise = issues.filter(F.col("id").startswith("CODE_UNION_002")).select("file", "line").distinct()
    general = F.col("id") == "CODE_UNION_001"
    kept = issues.filter(~general).unionByName(issues.filter(general).join(precise, ["file", "line"], "left_anti").select(*issues.columns))
    return kept.groupBy("file", "id", "line").agg(F.min_by("severity", "seq").alias("severity"), F.min("seq").alias("seq"))


@query(
    "issue_suppression",
    f"""SELECT file, id, line, arg_min(severity, seq) AS severity, MIN(seq) AS seq FROM {ISSUES_SQL}
WHERE NOT (id = 'CODE_UNION_001' AND (file, line) IN (SELECT (file, line) FROM {ISSUES_SQL} WHERE starts_with(id, 'CODE_UNION_002'))) GROUP BY file, id, line""",
)
def issue_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppressed(_issues(spark))


@query(
    "severity_rollup",
    f"SELECT file, COUNT(*) FILTER (WHERE severity = 'critical') AS critical, COUNT(*) FILTER (WHERE severity = 'warning') AS warning, COUNT(*) FILTER (WHERE severity IN ('info', 'suggestion')) AS info FROM {ISSUES_SQL} GROUP BY file",
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14."""
    s = F.col("severity")
    return _issues(spark).groupBy("file").agg(F.count_if(s == "critical").alias("critical"), F.count_if(s == "warning").alias("warning"), F.count_if(s.isin("info", "suggestion")).alias("info"))


@query("issues_by_severity", f"SELECT severity, {RANK_SQL} AS priority, COUNT(*) AS n, string_agg(id, ',' ORDER BY seq) AS ids FROM {ISSUES_SQL} GROUP BY severity")
def issues_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order of priority."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]), ",")
    return _issues(spark).groupBy("severity").agg(F.count("*").alias("n"), ids.alias("ids")).withColumn("priority", rank(F.col("severity"))).orderBy("priority")


NAMES = "('custmer_id'), ('amont'), ('nation'), ('xyz'), ('id'), ('regon')"
COLUMNS = "('customer_id'), ('amount'), ('nations'), ('nation'), ('region'), ('reason'), ('ids')"


def suggestions(unknown: DataFrame, known: DataFrame, most: int = 3, distance: int = 2) -> DataFrame:
    """The closest known names within ``distance`` edits, not the name itself. Names that can match differ in length by at most
    ``distance``, so the join is on the length, spread over that range."""
    k = known.select(F.col("name").alias("suggestion"), F.length("name").alias("size"))
    u = unknown.select("name", F.explode(F.sequence(F.length("name") - distance, F.length("name") + distance)).alias("size"))
    pairs = u.join(k, "size").withColumn("edits", F.levenshtein("name", "suggestion")).filter(f"edits BETWEEN 1 AND {distance}")
    place = F.row_number().over(Window.partitionBy("name").orderBy("edits", "suggestion"))
    return pairs.withColumn("place", place).filter(f"place <= {most}").select("name", "suggestion", "edits", "place")


@query(
    "did_you_mean",
    f"""SELECT name, suggestion, CAST(edits AS INTEGER) AS edits, CAST(place AS INTEGER) AS place FROM (SELECT name, suggestion, edits, ROW_NUMBER() OVER (PARTITION BY name ORDER BY edits, suggestion) AS place FROM (
  SELECT a.name, b.name AS suggestion, levenshtein(a.name, b.name) AS edits FROM (VALUES {NAMES}) AS a(name), (VALUES {COLUMNS}) AS b(name)) AS p WHERE edits BETWEEN 1 AND 2) AS q WHERE place <= 3""",
)
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions(spark.sql(f"SELECT * FROM VALUES {NAMES} AS t(name)"), spark.sql(f"SELECT * FROM VALUES {COLUMNS} AS t(name)"))


#: M36. Classes of error messages in lower case, in order; the first whose words occur counts.
ERRORS = {
    "import_error": ("modulenotfounderror", "importerror", "no module named"),
    "syntax_error": ("syntaxerror",),
    "spark_analysis_error": ("analysisexception", "unresolvedattribute", "cannotresolvecolumn"),
    "auth_error": ("permissiondenied", "unauthorized", "403 forbidden", "access denied"),
    "timeout": ("timeouterror", "timed out", "timeout"),
    "oom": ("memoryerror", "out of memory", "oom"),
    "network_error": ("connectionerror", "connectionrefused", "network"),
}
MESSAGES = "(1, 'HTTP 403 Forbidden'), (2, 'Request timed out'), (3, 'ConnectionRefused by 127.0.0.1'), (4, 'Cluster 12 is terminated'), (5, 'SyntaxError: invalid syntax'), (6, 'No module named foo'), (7, 'AnalysisException: cannot resolve x'), (8, 'disk full'), (9, NULL), (10, 'network timeout'), (11, 'java.lang.OutOfMemoryError'), (12, 'ImportError after 403 Forbidden'), (13, 'HTTP 401'), (14, 'Access denied')"
#: Written out apart from ``ERRORS``, class by class.
ERROR_CLASS_SQL = f"""SELECT id, CASE
  WHEN m LIKE '%modulenotfounderror%' OR m LIKE '%importerror%' OR m LIKE '%no module named%' THEN 'import_error'
  WHEN m LIKE '%syntaxerror%' THEN 'syntax_error'
  WHEN m LIKE '%analysisexception%' OR m LIKE '%unresolvedattribute%' OR m LIKE '%cannotresolvecolumn%' THEN 'spark_analysis_error'
  WHEN m LIKE '%permissiondenied%' OR m LIKE '%unauthorized%' OR m LIKE '%403 forbidden%' OR m LIKE '%access denied%' THEN 'auth_error'
  WHEN m LIKE '%timeouterror%' OR m LIKE '%timed out%' OR m LIKE '%timeout%' THEN 'timeout'
  WHEN m LIKE '%memoryerror%' OR m LIKE '%out of memory%' OR m LIKE '%oom%' THEN 'oom'
  WHEN m LIKE '%connectionerror%' OR m LIKE '%connectionrefused%' OR m LIKE '%network%' THEN 'network_error'
  ELSE 'other' END AS class FROM (SELECT id, lower(COALESCE(message, '')) AS m FROM (VALUES {MESSAGES}) AS t(id, message)) AS x"""


def error_class_of(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    any_of = lambda words: reduce(or_, [low.contains(w) for w in words])
    return F.coalesce(*[F.when(any_of(words), name) for name, words in ERRORS.items()], F.lit("other"))


@query("error_class", ERROR_CLASS_SQL)
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {MESSAGES} AS t(id, message)").select("id", error_class_of(F.col("message")).alias("class"))


def nudge(spark: SparkSession, runs: int, shown: bool, dismissed: bool, threshold: int = 5) -> DataFrame:
    """Whether a reminder is due: enough runs, not shown yet, never dismissed."""
    return spark.sql(f"SELECT {runs} AS runs, {runs} >= {threshold} AND NOT {str(shown).lower()} AND NOT {str(dismissed).lower()} AS due")


def selection_offset(issues: DataFrame, start: int) -> DataFrame:
    """Lines of a selection as lines of its file."""
    return issues.withColumn("line", F.col("line") + start)


JOINS = "(1, 'id', 'integer', 'bigint'), (2, 'name', 'string', 'integer'), (3, 'day', 'date', 'string'), (4, 'price', 'double', 'decimal'), (5, 'code', 'string', 'string'), (6, 'x', 'unknown', 'string')"
NUMERIC = ("integer", "bigint", "long", "double", "float", "decimal")


@query("join_type_check", f"SELECT id, key, l, r FROM (VALUES {JOINS}) AS t(id, key, l, r) WHERE l <> r AND l <> 'unknown' AND r <> 'unknown' AND NOT (l IN {NUMERIC} AND r IN {NUMERIC})")
def join_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key pairs whose types differ; numbers go with numbers, and what is not known is not judged."""
    rows = spark.sql(f"SELECT * FROM VALUES {JOINS} AS t(id, key, l, r)")
    numbers = F.col("l").isin(*NUMERIC) & F.col("r").isin(*NUMERIC)
    return rows.filter((F.col("l") != F.col("r")) & (F.col("l") != "unknown") & (F.col("r") != "unknown") & ~numbers)
