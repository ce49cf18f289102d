"""Scalar functions by family. Each table names the result, the Spark expression and the DuckDB one; results are rounded alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

Family = dict[str, tuple[Column | str, str]]


def _round(sql: str) -> str:
    return f"ROUND({sql}, 6)"


def family(name: str, source: str, keys: str, columns: dict[str, tuple], base: str = "") -> None:
    """Register a query that evaluates ``columns`` over a table: name -> (function giving a Column, DuckDB SQL)."""
    inner = base or f"SELECT * FROM {source}"
    sql = f"SELECT {keys}, {', '.join(f'{d} AS {k}' for k, (_, d) in columns.items())} FROM ({inner}) AS b"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        if base:
            rows = spark.sql(base.replace(f"FROM {source}", "FROM {src}"), src=rows)
        return rows.select(*keys.split(", "), *[f().alias(k) for k, (f, _) in columns.items()])

    query(name, sql)(run)





def r(c: Column) -> Column:
    return F.round(c, 6)


def x() -> Column:
    return F.col("x")


def y() -> Column:
    return F.col("y")


def i() -> Column:
    return F.col("i")


def n() -> Column:
    return F.col("c_name")


def m() -> Column:
    return F.col("c_mktsegment")


def d() -> Column:
    return F.col("d")


NUMBERS = "SELECT o_orderkey, o_totalprice / 1000 AS x, CAST(o_custkey % 17 AS DOUBLE) + 1 AS y, CAST(o_orderkey % 13 AS INTEGER) AS i, CAST(o_orderkey % 401 AS DOUBLE) / 8 - 25 AS s FROM orders"

family(
    "fn_math", "orders", "o_orderkey",
    {
        "abs_": (lambda: F.abs("s"), "ABS(s)"), "bin_": (lambda: F.bin("i"), "format('{:b}', i)"), "bround_": (lambda: F.bround("s", 1), "round_even(s, 1)"), "cbrt_": (lambda: r(F.cbrt("x")), _round("cbrt(x)")),
        "ceil_": (lambda: F.ceil("s"), "CAST(ceil(s) AS BIGINT)"), "floor_": (lambda: F.floor("s"), "CAST(floor(s) AS BIGINT)"), "exp_": (lambda: r(F.exp(y() / 4)), _round("exp(y / 4)")), "expm1_": (lambda: r(F.expm1(y() / 4)), _round("exp(y / 4) - 1")),
        "factorial_": (lambda: F.factorial("i"), "CAST(factorial(i) AS BIGINT)"), "ln_": (lambda: r(F.log("x")), _round("ln(x)")), "log_base": (lambda: r(F.log(3.0, x())), _round("ln(x) / ln(3)")), "log10_": (lambda: r(F.log10("x")), _round("log10(x)")),
        "log1p_": (lambda: r(F.log1p("x")), _round("ln(1 + x)")), "log2_": (lambda: r(F.log2("x")), _round("log2(x)")), "negative_": (lambda: F.negative("s"), "-s"), "positive_": (lambda: F.positive("s"), "s"), "pmod_": (lambda: F.pmod(i() - 6, F.lit(5)), "CAST(((i - 6) % 5 + 5) % 5 AS INTEGER)"),
        "pow_": (lambda: r(F.pow("y", F.lit(1.5))), _round("pow(y, 1.5)")), "rint_": (lambda: F.rint("s"), "round_even(s, 0)"), "round_": (lambda: F.round("s", 1), "ROUND(s, 1)"), "signum_": (lambda: F.signum("s"), "CAST(sign(s) AS DOUBLE)"), "sqrt_": (lambda: r(F.sqrt("x")), _round("sqrt(x)")),
    },
    NUMBERS,
)
UNIT = "SELECT o_orderkey, (CAST(o_orderkey % 199 AS DOUBLE) - 99) / 100 AS u, CAST(o_custkey % 31 AS DOUBLE) / 4 + 1 AS v FROM orders"
family(
    "fn_trig", "orders", "o_orderkey",
    {f"{n}_": ((lambda name=n: r(getattr(F, name)("u"))), _round(f"{n}(u)")) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians")}
    | {"acosh_": (lambda: r(F.acosh("v")), _round("acosh(v)")), "atan2_": (lambda: r(F.atan2("u", "v")), _round("atan2(u, v)")), "hypot_": (lambda: r(F.hypot("u", "v")), _round("sqrt(u * u + v * v)"))},
    UNIT,
)
TEXT = "SELECT c_custkey, c_name, c_mktsegment, '  ' || c_mktsegment || ' ' AS padded, 'a.b.' || c_name AS dotted FROM customer"

family(
    "fn_string", "customer", "c_custkey",
    {
        "concat_": (lambda: F.concat("c_name", F.lit("/"), "c_mktsegment"), "concat(c_name, '/', c_mktsegment)"), "concat_ws_": (lambda: F.concat_ws("-", "c_name", "c_mktsegment"), "concat_ws('-', c_name, c_mktsegment)"), "contains_": (lambda: F.contains(m(), F.lit("UIL")), "contains(c_mktsegment, 'UIL')"),
        "endswith_": (lambda: F.endswith(n(), F.lit("7")), "suffix(c_name, '7')"), "startswith_": (lambda: F.startswith(m(), F.lit("B")), "starts_with(c_mktsegment, 'B')"), "initcap_": (lambda: F.initcap("c_mktsegment"), "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"), "instr_": (lambda: F.instr("c_mktsegment", "I"), "CAST(instr(c_mktsegment, 'I') AS INTEGER)"),
        "length_": (lambda: F.length("c_name"), "CAST(length(c_name) AS INTEGER)"), "locate_": (lambda: F.locate("1", n(), 6), "CAST(CASE WHEN instr(c_name[6:], '1') > 0 THEN instr(c_name[6:], '1') + 5 ELSE 0 END AS INTEGER)"), "lower_": (lambda: F.lower("c_name"), "lower(c_name)"), "upper_": (lambda: F.upper("c_name"), "upper(c_name)"),
        "lpad_": (lambda: F.lpad("c_mktsegment", 12, "*"), "lpad(c_mktsegment, 12, '*')"), "rpad_": (lambda: F.rpad("c_mktsegment", 12, "*"), "rpad(c_mktsegment, 12, '*')"), "ltrim_": (lambda: F.ltrim("padded"), "ltrim(padded)"), "rtrim_": (lambda: F.rtrim("padded"), "rtrim(padded)"), "trim_": (lambda: F.trim("padded"), "trim(padded)"),
        "repeat_": (lambda: F.repeat("c_mktsegment", 2), "repeat(c_mktsegment, 2)"), "reverse_": (lambda: F.reverse("c_name"), "reverse(c_name)"), "substr_": (lambda: F.substr(n(), F.lit(3), F.lit(4)), "substr(c_name, 3, 4)"), "substring_": (lambda: F.substring("c_name", 2, 5), "substring(c_name, 2, 5)"),
        "substring_index_": (lambda: F.substring_index("dotted", ".", 2), "array_to_string(string_split(dotted, '.')[1:2], '.')"), "translate_": (lambda: F.translate("c_mktsegment", "ABI", "xy"), "translate(c_mktsegment, 'ABI', 'xy')"), "replace_": (lambda: F.replace(m(), F.lit("BUILDING"), F.lit("house")), "replace(c_mktsegment, 'BUILDING', 'house')"), "levenshtein_": (lambda: F.levenshtein("c_mktsegment", F.lit("BUILDING")), "CAST(levenshtein(c_mktsegment, 'BUILDING') AS INTEGER)"),
    },
    TEXT,
)
family(
    "fn_regex", "customer", "c_custkey",
    {
        "extract_": (lambda: F.regexp_extract("c_name", r"([A-Za-z]+)\D*(\d+)", 2), r"regexp_extract(c_name, '([A-Za-z]+)\D*(\d+)', 2)"), "replace_": (lambda: F.regexp_replace("c_name", r"\d", "#"), r"regexp_replace(c_name, '\d', '#', 'g')"), "split_": (lambda: F.array_join(F.split("dotted", r"\."), "|"), "array_to_string(string_split(dotted, '.'), '|')"),
        "like_": (lambda: m().rlike("^(AUTO|BUILD)"), "regexp_matches(c_mktsegment, '^(AUTO|BUILD)')"), "count_": (lambda: F.regexp_count("c_mktsegment", F.lit("[AEIOU]")), "CAST(len(regexp_extract_all(c_mktsegment, '[AEIOU]')) AS INTEGER)"),
    },
    TEXT,
)

DATES = "SELECT event_id, ts, CAST(ts AS DATE) AS d, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS txt FROM events"
family(
    "fn_date", "events", "event_id",
    {
        "add_months_": (lambda: F.add_months("d", 1), "CAST(d + INTERVAL 1 MONTH AS DATE)"), "date_add_": (lambda: F.date_add("d", 10), "CAST(d + INTERVAL 10 DAY AS DATE)"), "date_sub_": (lambda: F.date_sub("d", 10), "CAST(d - INTERVAL 10 DAY AS DATE)"), "date_format_": (lambda: F.date_format("ts", "yyyy/MM/dd HH:mm"), "strftime(ts, '%Y/%m/%d %H:%M')"),
        "date_trunc_": (lambda: F.date_trunc("hour", "ts").cast("timestamp_ntz"), "date_trunc('hour', ts)"), "datediff_": (lambda: F.datediff(F.lit("2024-02-01").cast("date"), d()), "CAST(DATE '2024-02-01' - d AS INTEGER)"), "dayofmonth_": (lambda: F.dayofmonth("d"), "CAST(day(d) AS INTEGER)"), "dayofweek_": (lambda: F.dayofweek("d"), "CAST(dayofweek(d) + 1 AS INTEGER)"), "dayofyear_": (lambda: F.dayofyear("d"), "CAST(dayofyear(d) AS INTEGER)"),
        "hour_": (lambda: F.hour("ts"), "CAST(hour(ts) AS INTEGER)"), "minute_": (lambda: F.minute("ts"), "CAST(minute(ts) AS INTEGER)"), "second_": (lambda: F.second("ts"), "CAST(second(ts) AS INTEGER)"), "month_": (lambda: F.month("d"), "CAST(month(d) AS INTEGER)"), "year_": (lambda: F.year("d"), "CAST(year(d) AS INTEGER)"), "quarter_": (lambda: F.quarter("d"), "CAST(quarter(d) AS INTEGER)"), "weekofyear_": (lambda: F.weekofyear("d"), "CAST(weekofyear(d) AS INTEGER)"),
        "last_day_": (lambda: F.last_day("d"), "last_day(d)"), "next_day_": (lambda: F.next_day("d", "Sunday"), "CAST(d + CAST(7 - dayofweek(d) AS INTEGER) AS DATE)"),
        "months_between_": (lambda: F.months_between(F.lit("2024-04-15").cast("date"), d()), "ROUND(CASE WHEN day(d) = 15 THEN 4 - month(d) ELSE 4 - month(d) + (15 - day(d)) / 31 END, 8)"), "to_date_": (lambda: F.to_date("txt", "yyyy-MM-dd"), "CAST(txt AS DATE)"), "to_timestamp_": (lambda: F.to_timestamp("txt", "yyyy-MM-dd").cast("timestamp_ntz"), "CAST(txt AS TIMESTAMP)"), "trunc_": (lambda: F.trunc("d", "month"), "CAST(date_trunc('month', d) AS DATE)"),
    },
    DATES,
)


@query(
    "fn_explode",
    """SELECT o_custkey, 'inner' AS kind, p AS part FROM (SELECT o_custkey, unnest(CASE WHEN o_custkey % 3 = 0 THEN [] ELSE string_split(o_orderpriority, '-') END) AS p FROM orders) AS a
UNION ALL SELECT o_custkey, 'outer', p FROM (SELECT o_custkey, unnest(CASE WHEN o_custkey % 3 = 0 THEN [NULL] ELSE string_split(o_orderpriority, '-') END) AS p FROM orders) AS b""",
)
def fn_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("o_orderpriority", "-")).alias("parts"))
    inner = rows.select("o_custkey", F.lit("inner").alias("kind"), F.explode("parts").alias("part"))
    return inner.union(rows.select("o_custkey", F.lit("outer").alias("kind"), F.explode_outer("parts").alias("part")))


LISTS = "SELECT o_orderkey, [o_custkey % 5, o_orderkey % 7, 3] AS a, [o_orderkey % 7, 9] AS b FROM orders"


@query(
    "fn_array",
    f"""SELECT o_orderkey, array_to_string(list_sort(a), ',') AS sorted, len(list_distinct(a)) AS n_distinct, a[1] AS first_, a[-1] AS last_, list_contains(a, 3) AS has3, array_to_string(a[2:3], ',') AS sliced,
  array_to_string(list_concat(a, b), ',') AS joined, list_max(a) AS most, CAST(list_position(a, 3) AS BIGINT) AS place, array_to_string(range(1, 4), ',') AS seq, array_to_string(flatten([a, b]), ',') AS flat FROM ({LISTS}) AS t""",
)
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = F.array(F.col("o_custkey") % 5, F.col("o_orderkey") % 7, F.lit(3).cast("long")), F.array(F.col("o_orderkey") % 7, F.lit(9).cast("long"))
    s = o.select("o_orderkey", a.alias("a"), b.alias("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return s.select(
        "o_orderkey", text(F.sort_array("a")).alias("sorted"), F.size(F.array_distinct("a")).cast("long").alias("n_distinct"), F.element_at("a", 1).alias("first_"), F.element_at("a", -1).alias("last_"),
        F.array_contains("a", 3).alias("has3"), text(F.slice("a", 2, 2)).alias("sliced"), text(F.concat("a", "b")).alias("joined"), F.array_max("a").alias("most"), F.array_position("a", 3).alias("place"),
        text(F.sequence(F.lit(1), F.lit(3))).alias("seq"), text(F.flatten(F.array("a", "b"))).alias("flat"),
    )


@query(
    "fn_map",
    """SELECT o_orderkey, array_to_string(map_keys(m), ',') AS keys, array_to_string(map_values(m), ',') AS vals, m['p'] AS p, CAST(cardinality(m) AS INTEGER) AS n, map_contains(m, 'z') AS has_z
FROM (SELECT o_orderkey, MAP {'s': o_orderstatus, 'p': o_orderpriority} AS m FROM orders) AS t""",
)
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("s"), "o_orderstatus", F.lit("p"), "o_orderpriority").alias("m"))
    return s.select(
        "o_orderkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.array_join(F.map_values("m"), ",").alias("vals"), F.element_at("m", "p").alias("p"), F.size("m").alias("n"), F.map_contains_key("m", "z").alias("has_z")
    )


@query("fn_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc, json_extract_string(props, '$.none') AS missing FROM events""")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), doc.alias("doc"), F.get_json_object("props", "$.none").alias("missing"))


@query(
    "fn_hof",
    f"""SELECT o_orderkey, array_to_string(list_transform(a, lambda v: v * 2), ',') AS doubled, array_to_string(list_filter(a, lambda v: v > 2), ',') AS big, CAST(list_sum(a) AS BIGINT) AS total, len(list_filter(a, lambda v: v = 3)) > 0 AS any3,
  len(list_filter(a, lambda v: v < 0)) = 0 AS all_positive, array_to_string([a[1] + b[1], a[2] + b[2]], ',') AS zipped FROM ({LISTS}) AS t""",
)
def fn_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = o.select("o_orderkey", F.array(F.col("o_custkey") % 5, F.col("o_orderkey") % 7, F.lit(3).cast("long")).alias("a"), F.array(F.col("o_orderkey") % 7, F.lit(9).cast("long")).alias("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return s.select(
        "o_orderkey", text(F.transform("a", lambda v: v * 2)).alias("doubled"), text(F.filter("a", lambda v: v > 2)).alias("big"), F.aggregate("a", F.lit(0).cast("long"), lambda p, v: p + v).alias("total"), F.exists("a", lambda v: v == 3).alias("any3"),
        F.forall("a", lambda v: v >= 0).alias("all_positive"), text(F.zip_with(F.slice("a", 1, 2), "b", lambda p, q: p + q)).alias("zipped"),
    )


@query("udf_scalar", "SELECT c_custkey, upper(c_mktsegment) || '!' AS shout FROM customer")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorized UDF with a declared type, beside what a built-in would give."""
    @F.pandas_udf("string")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper() + "!"

    return table(spark, sf_dir, "customer").select("c_custkey", shout("c_mktsegment").alias("shout"))
