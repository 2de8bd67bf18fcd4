"""Registered queries of the profiling engine, and the same in SQL over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import classic, columns, insights, profile, relations, reports
from quillon.plans.analysis import analyze, small
from quillon.sources.scratch import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Derived columns of lineitem on which rules fire that the tables themselves don't trigger.
V1 = "nullif(l_discount, 0) AS discount"
V2 = "l_extendedprice AS gross, l_extendedprice * (1 - l_discount) AS net"
V3 = "CASE WHEN l_quantity > 10 THEN 'bulk' ELSE 'small' END AS size_class"
V4 = "CAST(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS DOUBLE) AS large"
V5 = "CAST(1 AS DOUBLE) AS one"


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _typed(spark: SparkSession, sf_dir: str, table: str, *cells: str) -> columns.Typed:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return columns.classify(df.selectExpr(*cells) if cells else df)


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _numeric_sql(source: str, names: list[str]) -> str:
    """The statistics of each column, unrounded; quartiles are elements of the sorted values."""
    one = """SELECT {ord} AS ord, '{c}' AS "column", count({c}) AS n, (count(*) - count({c})) * 100.0 / count(*) AS missing_pct, avg({c}) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max,
 list({c} ORDER BY {c})[CAST(floor(count({c}) * 0.25) AS INT) + 1] AS q1, list({c} ORDER BY {c})[CAST(floor(count({c}) * 0.75) AS INT) + 1] AS q3, stddev_pop({c}) AS std, stddev_pop({c}) / nullif(avg({c}), 0) * 100 AS cv
 FROM {source} WHERE true"""
    return _union([one.format(ord=i, c=c, source=f"(SELECT CAST({c} AS DOUBLE) AS {c} FROM {source})") for i, c in enumerate(names)])


STATS = ("missing_pct", "mean", "median", "min", "max", "q1", "q3", "std", "cv")
_round_stats = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in STATS)


@query(f'SELECT "column", n, {_round_stats} FROM ({_numeric_sql("lineitem", LINE_NUMBERS)})')
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.numeric_profile(_typed(spark, sf_dir, "lineitem", *LINE_NUMBERS)), 4, *STATS).drop("ord")


@query(f'SELECT "column", q1, median, q3 FROM ({_numeric_sql("orders", ["o_totalprice"])} UNION ALL {_numeric_sql("events", ["value"])})')
def floor_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [profile.numeric_profile(_typed(spark, sf_dir, t, c)) for t, c in (("orders", "o_totalprice"), ("events", "value"))]
    return both[0].union(both[1]).select("column", "q1", "median", "q3")


#: Numbers that doubles don't hold.
_LONG = {"big": "9007199254740993 + CAST(l_orderkey AS BIGINT) * 3", "exact": "CAST(concat(CAST(l_partkey AS VARCHAR(20)), '123456789012345.', lpad(CAST(l_orderkey AS VARCHAR(20)), 10, '0')) AS DECIMAL(38, 10))"}


def _order_sql(c: str) -> str:
    at = lambda i: f"CAST(list({c} ORDER BY {c})[{i} + 1] AS VARCHAR)"
    n = f"count({c})"
    return f"""SELECT '{c}' AS "column", {n} AS n, CAST(min({c}) AS VARCHAR) AS min, {at(f"{n} // 4")} AS q1, {at(f"({n} - 1) // 2")} AS median_low, {at(f"{n} // 2")} AS median_high, {at(f"{n} * 3 // 4")} AS q3, CAST(max({c}) AS VARCHAR) AS max FROM (SELECT {_LONG[c]} AS {c} FROM lineitem)"""


@query(_union([_order_sql(c) for c in _LONG]))
def exact_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*(f"{e} AS {c}" for c, e in _LONG.items()))
    return profile.order_statistics(df)


def _histogram_sql(table: str, c: str, bins: int) -> str:
    return f"""WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / {bins} AS step FROM {table}),
 h AS (SELECT least(CAST(floor(({c} - lo) / step) AS INT), {bins - 1}) AS bin, count(*) AS n FROM {table}, e WHERE {c} IS NOT NULL GROUP BY 1)
 SELECT '{c}' AS "column", CAST(b.bin AS INT) AS bin, round(lo + b.bin * step, 4) AS range_start, CAST(coalesce(n, 0) AS BIGINT) AS "count" FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN e LEFT JOIN h ON h.bin = b.bin"""


@query(_histogram_sql("events", "value", 15))
def histogram15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.histogram(_typed(spark, sf_dir, "events", "value")), 4, "range_start").drop("range")


@query(_histogram_sql("lineitem", "l_extendedprice", 30))
def histogram30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.histogram(_typed(spark, sf_dir, "lineitem", "l_extendedprice"), 30), 4, "range_start").drop("range")


def _counts_sql(table: str, names: list[str]) -> str:
    return _union([f"""SELECT {i} AS ord, '{c}' AS "column", CAST({c} AS VARCHAR) AS name, count(*) AS value FROM {table} WHERE {c} IS NOT NULL GROUP BY 3""" for i, c in enumerate(names)])


def _frequency_sql(table: str, names: list[str]) -> str:
    return f"""SELECT ord, "column", CAST(row_number() OVER (PARTITION BY ord ORDER BY value DESC, name) AS INT) AS rank, substring(name, 1, 20) AS name, value, value * 100.0 / sum(value) OVER (PARTITION BY ord) AS percentage FROM ({_counts_sql(table, names)})"""


@query(f'SELECT "column", rank, name, value, round(CAST(percentage AS DOUBLE), 4) AS percentage FROM ({_frequency_sql("events", ["event_type"])})')
def category_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.frequencies(profile.value_counts(_typed(spark, sf_dir, "events", "event_type")))
    return found.select("column", "rank", "name", "value", F.round(F.col("percentage").cast("double"), 4).alias("percentage"))


ORDER_CATEGORIES = ["o_orderstatus", "o_orderpriority"]


@query(f'SELECT "column", name AS mode, value AS "count" FROM ({_frequency_sql("orders", ORDER_CATEGORIES)}) WHERE rank = 1')
def category_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profile.frequencies(profile.value_counts(_typed(spark, sf_dir, "orders", *ORDER_CATEGORIES)), top=1)
    return top.select("column", F.col("name").alias("mode"), F.col("value").alias("count"))


def _categorical_sql(table: str, names: list[str]) -> str:
    return _union([f"""SELECT {i} AS ord, '{c}' AS "column", count(DISTINCT {c}) AS "unique", (SELECT substring(name, 1, 20) FROM (SELECT {c} AS name, count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY k DESC, name LIMIT 1) AS mode, CAST((count(*) - count({c})) * 100.0 / count(*) AS DOUBLE) AS missing_pct FROM {table}""" for i, c in enumerate(names)])


def _categories(spark: SparkSession, sf_dir: str, table: str, *cells: str) -> DataFrame:
    typed = _typed(spark, sf_dir, table, *cells)
    return profile.categorical_profile(typed, profile.value_counts(typed))


CUSTOMER_CATEGORIES = ["c_name", "c_mktsegment"]


@query(f'SELECT "column", "unique", mode, missing_pct FROM ({_categorical_sql("orders", ORDER_CATEGORIES)} UNION ALL {_categorical_sql("customer", CUSTOMER_CATEGORIES)})')
def categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir, "orders", *ORDER_CATEGORIES).union(_categories(spark, sf_dir, "customer", *CUSTOMER_CATEGORIES)).drop("ord")


@query('SELECT "column", CAST("unique" AS BIGINT) AS "unique" FROM (' + _categorical_sql("part", ["p_name", "p_brand", "p_type"]) + ') WHERE "unique" < 15')
def low_cardinality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.low_cardinality(_categories(spark, sf_dir, "part", "p_name", "p_brand", "p_type")).select("column", "unique")


def _pairs_sql(source: str, names: list[str]) -> str:
    r = "CASE WHEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) IS NULL OR isnan(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) THEN 0 ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END"
    return _union([f"SELECT {i} AS ord1, {j} AS ord2, '{a}' AS col1, '{b}' AS col2, {r.format(a=a, b=b)} AS correlation FROM {source}" for i, a in enumerate(names) for j, b in enumerate(names) if i < j])


@query(f'SELECT ord1, ord2, col1, col2, round(correlation, 6) AS correlation FROM ({_pairs_sql("lineitem", LINE_NUMBERS)})')
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(relations.correlations(_typed(spark, sf_dir, "lineitem", *LINE_NUMBERS)), 6, "correlation")


PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]


@query(f"""WITH p AS ({_pairs_sql("part", PART_NUMBERS)}), m AS (SELECT col1, col2, correlation FROM p UNION ALL SELECT col2, col1, correlation FROM p {" ".join(f"UNION ALL SELECT '{c}', '{c}', 1.0" for c in PART_NUMBERS)})
SELECT col1 AS "column", {", ".join(f"round(max(CASE WHEN col2 = '{c}' THEN correlation END), 6) AS {c}" for c in PART_NUMBERS)} FROM m GROUP BY 1""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "part", *PART_NUMBERS)
    return _rounded(relations.correlation_matrix(typed, relations.correlations(typed)), 6, *PART_NUMBERS).drop("ord1")


@query(f"""WITH p AS ({_pairs_sql("part", PART_NUMBERS)}) SELECT col1, col2, CAST(floor(abs(r) * 9 + 0.5) * 10 AS INT) AS intensity, CASE WHEN r = 1 THEN 'full' WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'neutral' END AS hue FROM (SELECT col1, col2, round(correlation, 2) AS r FROM p)""")
def correlation_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.correlations(_typed(spark, sf_dir, "part", *PART_NUMBERS)).select("col1", "col2", *relations.heat())


@query(f'SELECT col1, col2, round(CAST(correlation AS DOUBLE), 6) AS correlation FROM ({_pairs_sql(f"(SELECT l_quantity, {V5} FROM lineitem)", ["l_quantity", "one"])})')
def corr_guard_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.correlations(_typed(spark, sf_dir, "lineitem", "l_quantity", V5)).select("col1", "col2", F.round("correlation", 6).alias("correlation"))


V2_NUMBERS = ["l_quantity", "gross", "net", "l_discount"]
_V2_SOURCE = f"(SELECT l_quantity, {V2}, l_discount FROM lineitem)"


@query(f"""SELECT col1, col2, round(correlation, 6) AS correlation FROM ({_pairs_sql(_V2_SOURCE, V2_NUMBERS)}) WHERE abs(round(correlation, 2)) > 0.5 ORDER BY abs(round(correlation, 2)) DESC, ord1, ord2 LIMIT 5""")
def top_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relations.correlations(_typed(spark, sf_dir, "lineitem", "l_quantity", *V2.split(", "), "l_discount"))
    return reports.top_correlations(pairs).select("col1", "col2", F.round("correlation", 6).alias("correlation"))


@query(f"""SELECT col1, col2, round(correlation, 6) AS correlation FROM ({_pairs_sql(_V2_SOURCE, V2_NUMBERS)}) WHERE abs(correlation) >= 0.7 ORDER BY abs(correlation) DESC, ord1, ord2 LIMIT 3""")
def decision_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relations.correlations(_typed(spark, sf_dir, "lineitem", "l_quantity", *V2.split(", "), "l_discount"))
    return reports.drivers(pairs).select("col1", "col2", F.round("correlation", 6).alias("correlation"))


@query(f"""SELECT col1, col2, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS sign, round(correlation, 6) AS correlation FROM ({_pairs_sql(_V2_SOURCE, V2_NUMBERS)}) WHERE abs(correlation) > 0.7""")
def strong_pair_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relations.correlations(_typed(spark, sf_dir, "lineitem", "l_quantity", *V2.split(", "), "l_discount"))
    return insights.strong_pairs(pairs).select("col1", "col2", F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("sign"), F.round("correlation", 6).alias("correlation"))


#: 21 columns, each with missing cells of its own.
WIDE = [f"CASE WHEN (l_orderkey + {i}) % 11 <> 0 THEN CAST((l_partkey * {i + 3} + l_suppkey * {i * i + 1} + l_linenumber * {7 * i}) % 101 AS DOUBLE) * l_quantity END AS w{i}" for i in range(21)]
_WIDE_R = ", ".join(f'corr(w{i}, w{j}) AS "w{i}|w{j}"' for i in range(len(WIDE)) for j in range(i + 1, len(WIDE)))


@query(f"""WITH w AS MATERIALIZED (SELECT {", ".join(WIDE)} FROM lineitem), r AS (SELECT {_WIDE_R} FROM w)
SELECT split_part(name, '|', 1) AS col1, split_part(name, '|', 2) AS col2, round(value, 9) AS correlation FROM (UNPIVOT r ON COLUMNS(*))""")
def wide_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More pairs than one aggregation takes."""
    return relations.correlations(_typed(spark, sf_dir, "lineitem", *WIDE)).select("col1", "col2", F.round("correlation", 9).alias("correlation"))


def _groups_sql(source: str, categories: list[str], names: list[str]) -> str:
    return _union([f"SELECT '{k}' AS cat_col, '{x}' AS num_col, substring(CAST({k} AS VARCHAR), 1, 15) AS category, avg({x}) AS mean, median({x}) AS median, min({x}) AS min, max({x}) AS max, count({x}) AS \"count\" FROM {source} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count({x}) > 0" for k in categories for x in names])


def _groups(typed: columns.Typed) -> DataFrame:
    low = relations.low_cardinality(profile.categorical_profile(typed, profile.value_counts(typed))).orderBy("ord").select("column").collect()
    return relations.group_summary(typed, [r["column"] for r in low])


@query(f'SELECT cat_col, num_col, category, round(mean, 4) AS mean, round(median, 4) AS median, min, max, "count" FROM ({_groups_sql("lineitem", ["l_returnflag", "l_linestatus"], LINE_NUMBERS)})')
def group_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_groups(_typed(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", *LINE_NUMBERS)), 4, "mean", "median")


_FLAG_SOURCES = [("events", "value", "value"), ("lineitem", V4, "large"), ("documents", "n_chars", "n_chars")]


@query("SELECT \"column\", rule FROM (" + _union([f"SELECT \"column\", 'skew' AS rule FROM ({_numeric_sql(f'(SELECT {e} FROM {t})', [c])}) WHERE std > 0 AND n > 30 AND abs(mean - median) / std > 0.5 UNION ALL SELECT \"column\", 'outlier' FROM ({_numeric_sql(f'(SELECT {e} FROM {t})', [c])}) WHERE std > 0 AND max > mean + 3 * std" for t, e, c in _FLAG_SOURCES]) + ")")
def skew_outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, cell, _ in _FLAG_SOURCES:
        numeric = profile.numeric_profile(_typed(spark, sf_dir, table, cell))
        part = insights.skewed(numeric).select("column", F.lit("skew").alias("rule")).union(insights.outlying(numeric).select("column", F.lit("outlier").alias("rule")))
        out = part if out is None else out.union(part)
    return out


@query(f"""SELECT "column", name, round(CAST(percentage AS DOUBLE), 4) AS percentage FROM ({_frequency_sql(f"(SELECT {V3}, l_linestatus FROM lineitem)", ["size_class", "l_linestatus"])}) f WHERE rank = 1 AND percentage > 70""")
def dominance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.frequencies(profile.value_counts(_typed(spark, sf_dir, "lineitem", V3, "l_linestatus")), top=2)
    return insights.dominated(found).select("column", "name", F.round(F.col("percentage").cast("double"), 4).alias("percentage"))


def _all_insights(typed: columns.Typed) -> DataFrame:
    counts = table(profile.value_counts(typed), "value_counts")
    low = relations.low_cardinality(profile.categorical_profile(typed, counts)).count()
    return insights.insights(small(profile.numeric_profile(typed)), small(profile.frequencies(counts, 2)), small(relations.correlations(typed)), typed.rows, len(typed.df.columns), len(typed.numeric), low)


def _insight_sql() -> str:
    source, names = f"(SELECT {V2}, {V3}, {V4} FROM lineitem)", ["gross", "net", "large"]
    stats = _numeric_sql(source, names)
    at = "CASE \"column\" WHEN 'gross' THEN 0 WHEN 'net' THEN 1 ELSE 3 END"
    return f"""WITH s AS ({stats}), f AS ({_frequency_sql(source, ["size_class"])}), p AS ({_pairs_sql(source, names)}), found AS (
 SELECT 0 AS part, {at} AS a, 0 AS b, 'Analyst' AS agent, 'warning' AS type, 'skew' AS rule, "column" AS col1, NULL AS col2, abs(mean - median) / std AS metric FROM s WHERE std > 0 AND n > 30 AND abs(mean - median) / std > 0.5
 UNION ALL SELECT 0, {at}, 1, 'Analyst', 'warning', 'outlier', "column", NULL, max FROM s WHERE std > 0 AND max > mean + 3 * std
 UNION ALL SELECT 0, 2, 0, 'Insight', 'info', 'dominance', "column", NULL, percentage FROM f WHERE rank = 1 AND percentage > 70 AND (SELECT count(*) FROM f) > 1
 UNION ALL SELECT 1, CASE WHEN ord1 = 2 THEN 3 ELSE ord1 END, CASE WHEN ord2 = 2 THEN 3 ELSE ord2 END, 'Analyst', 'info', 'strong_pair', col1, col2, correlation FROM p WHERE abs(correlation) > 0.7
 UNION ALL SELECT 2, 0, 0, 'Insight', 'success', 'completion', NULL, NULL, count(*) FROM lineitem HAVING count(*) > 10)
 SELECT CAST(row_number() OVER (ORDER BY part, a, b) AS INT) AS seq, agent, type, rule, col1, col2, round(CAST(metric AS DOUBLE), 4) AS metric FROM found"""


@query(_insight_sql())
def all_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_all_insights(_typed(spark, sf_dir, "lineitem", *V2.split(", "), V3, V4)), 4, "metric").drop("text")


@query(f"SELECT seq, rule, col1 FROM ({_insight_sql()}) WHERE type = 'warning'")
def critical_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.critical_insights(_all_insights(_typed(spark, sf_dir, "lineitem", *V2.split(", "), V3, V4))).select("seq", "rule", "col1")


@query(f"SELECT seq, rule FROM ({_insight_sql()}) ORDER BY seq LIMIT 5")
def snapshot_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.snapshot(_all_insights(_typed(spark, sf_dir, "lineitem", *V2.split(", "), V3, V4))).select("seq", "rule")


def _insight_texts_sql() -> str:
    """(seq, agent, type, text) of the insights."""
    source, names = f"(SELECT {V2}, {V3}, {V4} FROM lineitem)", ["gross", "net", "large"]
    number = lambda e, places: f"printf('%.{places}f', CAST({e} AS DOUBLE))"
    return f"""SELECT i.seq, i.agent, i.type, CASE i.rule WHEN 'skew' THEN '**' || col1 || '** looks **skewed**: mean ' || {number("s.mean", 0)} || ' against median ' || {number("s.median", 0)} || '.'
 WHEN 'outlier' THEN '**' || col1 || '** has an extreme maximum of ' || {number("s.max", 0)} || ': an outlier, or a premium segment.'
 WHEN 'dominance' THEN '**' || f.name || '** makes up ' || {number("f.percentage", 1)} || '% of **' || col1 || '**.'
 WHEN 'strong_pair' THEN '**' || col1 || '** and **' || col2 || '** have a strong **' || CASE WHEN metric > 0 THEN 'positive' ELSE 'negative' END || '** correlation (r = ' || {number("metric", 2)} || ').'
 ELSE 'Profiled **' || CAST(metric AS BIGINT) || ' records** with **4 columns**: **3** numeric and **1** categorical ones of few values.' END AS text
 FROM ({_insight_sql()}) i LEFT JOIN ({_numeric_sql(source, names)}) s ON s."column" = i.col1 LEFT JOIN (SELECT * FROM ({_frequency_sql(source, ["size_class"])}) WHERE rank = 1) f ON f."column" = i.col1"""


@query(f"SELECT seq, text FROM ({_insight_texts_sql()})")
def insight_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_insights(_typed(spark, sf_dir, "lineitem", *V2.split(", "), V3, V4)).select("seq", "text")


@query(f"SELECT 'any patterns?' AS question, string_agg('**' || agent || '**: ' || text, chr(10) || chr(10) ORDER BY seq) AS answer FROM ({_insight_texts_sql()}) WHERE type <> 'success'")
def insight_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.plans.ask import ask

    found = analyze(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*V2.split(", "), V3, V4), "lineitem.csv")
    return spark.createDataFrame([("any patterns?", ask(found, "any patterns?"))], "question string, answer string")


@query("SELECT 'lineitem' AS name, count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS BIGINT) AS columns FROM lineitem UNION ALL SELECT 'part', count(*), CAST((SELECT count(*) FROM (DESCRIBE part)) AS BIGINT) FROM part")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, *classic.shape(spark.read.parquet(f"{sf_dir}/{t}.parquet"))) for t in ("lineitem", "part")]
    return spark.createDataFrame(found, "name string, rows bigint, columns bigint")


#: Lines of a CSV file of which some have too few cells and some too many.
_LINE = "concat_ws(',', CAST(o_orderkey AS VARCHAR(20)), o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR(20)) END, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'more' END)"


@query(f"SELECT {_LINE} AS row, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def malformed_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources import files

    path = scratch(spark, "csv")
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{_LINE} AS `o_orderkey,o_orderstatus,o_custkey`")
    lines.write.options(header=True, sep="\x01").csv(path)
    return files.malformed_rows(spark, path).select("row", "cells.o_orderkey", "cells.o_custkey")


LABELS = ["quality", "toxic"]


@query(f'SELECT "column", round(cv, 4) AS cv FROM ({_numeric_sql("labels", LABELS)} UNION ALL {_numeric_sql("events", ["value"])}) WHERE round(cv, 2) > 50')
def unstable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = profile.numeric_profile(_typed(spark, sf_dir, "labels", *LABELS)).union(profile.numeric_profile(_typed(spark, sf_dir, "events", "value")))
    return reports.unstable_columns(both).select("column", F.round("cv", 4).alias("cv"))


@query(f'SELECT "column", round(cv, 4) AS cv FROM ({_numeric_sql("labels", LABELS)}) WHERE round(cv, 2) > 75')
def inconsistent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric = profile.numeric_profile(_typed(spark, sf_dir, "labels", *LABELS))
    return reports.unstable_columns(numeric, 75).select("column", F.round("cv", 4).alias("cv"))


@query("""WITH m AS (SELECT count(*) AS rows, count(*) - count(nullif(l_discount, 0)) AS gone FROM lineitem)
SELECT 'discount' AS "column", round(gone * 100.0 / rows, 1) AS missing_pct, gone AS missing_rows, CAST(floor(CAST(round(gone * 100.0 / rows, 1) AS DOUBLE) * rows / 100 + 0.5) AS BIGINT) AS affected_records FROM m WHERE round(gone * 100.0 / rows, 1) > 0""")
def missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "lineitem", V1, "l_tax")
    profiles = profile.missing_shares(typed, typed.columns)
    present = spark.createDataFrame(list(typed.present.items()), "column string, present bigint")
    return reports.missing_summary(profiles, typed.rows, present).drop("ord")


@query("""SELECT 'text' AS "column", count(DISTINCT text) AS "unique" FROM documents HAVING count(DISTINCT text) / CAST(count(*) AS DOUBLE) > 0.8
UNION ALL SELECT 'source', count(DISTINCT source) FROM documents HAVING count(DISTINCT source) / CAST(count(*) AS DOUBLE) > 0.8""")
def key_like_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "documents", "text", "source")
    return reports.key_like_columns(profile.categorical_profile(typed, profile.value_counts(typed)), typed.rows).drop("ord")


@query(f"""WITH t AS (SELECT {V1}, l_tax, l_returnflag FROM lineitem), m AS (UNPIVOT (SELECT round((count(*) - count(COLUMNS(*))) * 100.0 / count(*), 1) FROM t) ON COLUMNS(*)),
n AS (SELECT count(*) FILTER (column_type = 'DOUBLE') AS num, count(*) FILTER (column_type = 'VARCHAR') AS cat FROM (DESCRIBE t)), i AS (SELECT count(*) FILTER (value > 0) AS gone FROM m)
SELECT (SELECT count(*) FROM t) AS records, num AS numeric_columns, cat AS categorical_columns, gone AS incomplete_columns, CASE WHEN gone = 0 THEN 'Clean' ELSE gone || ' Columns Affected' END AS status FROM n, i""")
def quality_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "lineitem", V1, "l_tax", "l_returnflag")
    return reports.quality_overview(profile.missing_shares(typed, typed.numeric), profile.missing_shares(typed, typed.categorical), typed.rows)


@query(f"""WITH s AS ({_numeric_sql("part", PART_NUMBERS)}), p AS ({_pairs_sql("part", PART_NUMBERS)}), m AS (SELECT col1, col2, correlation FROM p UNION ALL SELECT col2, col1, correlation FROM p)
SELECT "column", round(abs(correlation), 4) AS correlation, round(cv, 2) AS cv, round(abs(correlation) / (round(cv, 2) / 100), 3) AS score FROM s JOIN m ON m.col1 = "column" AND m.col2 = 'p_retailprice' WHERE round(cv, 2) <> 0 ORDER BY score DESC, ord LIMIT 5""")
def risk_adjusted_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "part", *PART_NUMBERS)
    target = reports.choose_target(typed.numeric)
    return reports.risk_adjusted(profile.numeric_profile(typed), relations.correlations(typed), target).select("column", F.round("correlation", 4).alias("correlation"), "cv", "score")


@query(f"""WITH g AS ({_groups_sql("events", ["event_type"], ["value"])}), s AS (SELECT round(stddev_pop(value), 2) AS std FROM events)
SELECT cat_col, category, round(mean - median, 0) AS gain FROM g, s WHERE mean - median > 0.2 * std AND mean > 0 ORDER BY gain DESC, cat_col, category LIMIT 3""")
def leveraged_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "events", "event_type", "value")
    return reports.leveraged_gain(_groups(typed), profile.numeric_profile(typed), "value").select("cat_col", "category", "gain")


_PART_GROUPS = _groups_sql("part", ["p_type"], ["p_retailprice"])


@query(f"""WITH g AS ({_PART_GROUPS}) SELECT * FROM (SELECT 'best' AS role, cat_col, category, round(mean, 4) AS mean FROM g ORDER BY g.mean DESC, cat_col, category LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'worst', cat_col, category, round(mean, 4) FROM g WHERE g.mean > 0 ORDER BY g.mean, cat_col, category LIMIT 1)""")
def best_worst_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.best_and_worst(_groups(_typed(spark, sf_dir, "part", "p_type", "p_retailprice")), "p_retailprice"), 4, "mean")


@query(f"SELECT cat_col, num_col, category, round(mean, 4) AS mean FROM ({_PART_GROUPS}) g ORDER BY g.mean DESC, cat_col, category LIMIT 1")
def premium_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.premium_segment(_groups(_typed(spark, sf_dir, "part", "p_type", "p_retailprice")), ["p_retailprice"]), 4, "mean")


@query(f"""WITH p AS ({_pairs_sql("part", PART_NUMBERS)}), b AS (SELECT * FROM p WHERE col1 LIKE '%price%' OR col2 LIKE '%price%' ORDER BY abs(correlation) DESC, ord1, ord2 LIMIT 1)
SELECT col1, round(correlation, 6) AS chosen_r, (SELECT round(correlation, 6) FROM p WHERE p.col1 = b.col1 ORDER BY ord1, ord2 LIMIT 1) AS shown_r FROM b""")
def price_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.price_driver(relations.correlations(_typed(spark, sf_dir, "part", *PART_NUMBERS))), 6, "chosen_r", "shown_r")


@query(f"""SELECT "column", mode, "unique" FROM ({_categorical_sql("part", ["p_name", "p_brand", "p_type"])}) WHERE "unique" > 1 ORDER BY "unique" DESC, ord LIMIT 1""")
def core_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.core_segment(_categories(spark, sf_dir, "part", "p_name", "p_brand", "p_type"))


@query(_union([f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max FROM lineitem""" for c in LINE_NUMBERS]))
def describe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(classic.describe(_typed(spark, sf_dir, "lineitem", *LINE_NUMBERS)), 4, "mean", "std", "p25", "p50", "p75")


@query("SELECT o_orderstatus AS category, count(o_totalprice) AS \"count\", round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(stddev_samp(o_totalprice), 2) AS std, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classic.group_aggregate(_typed(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice"), "o_totalprice")


@query(f'SELECT "column", name, round(CAST(percentage AS DOUBLE), 2) AS pct FROM ({_frequency_sql("orders", ORDER_CATEGORIES)})')
def value_counts_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classic.value_shares(profile.frequencies(profile.value_counts(_typed(spark, sf_dir, "orders", *ORDER_CATEGORIES))))
    return found.withColumn("pct", F.col("pct").cast("double"))


@query(_union([f"""SELECT '{c}' AS "column", round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 2) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 2) AS upper_fence FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in LINE_NUMBERS]))
def boxplot_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _rounded(classic.boxplot(_typed(spark, sf_dir, "lineitem", *LINE_NUMBERS)), 4, "q1", "q2", "q3")
    return _rounded(boxes, 2, "lower_fence", "upper_fence")


@query("SELECT 'discount' AS \"column\", count(*) - count(nullif(l_discount, 0)) AS nulls FROM lineitem UNION ALL SELECT 'l_tax', count(*) - count(l_tax) FROM lineitem")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classic.null_counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(V1, "l_tax"))


@query(f"""WITH p AS ({_pairs_sql("lineitem", LINE_NUMBERS)}) SELECT DISTINCT round(correlation, 6) AS correlation FROM (SELECT correlation FROM p UNION SELECT 1.0) ORDER BY 1 DESC LIMIT 5""")
def distinct_corr_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(classic.highest_correlations(relations.correlations(_typed(spark, sf_dir, "lineitem", *LINE_NUMBERS))), 6, "correlation")


@query(f"""SELECT (SELECT count(*) FROM lineitem) AS records, CAST({len(V2_NUMBERS)} AS BIGINT) AS numeric_columns, CAST(1 AS BIGINT) AS categorical_columns, count(*) FILTER (abs(correlation) > 0.7) AS strong_pairs FROM ({_pairs_sql(_V2_SOURCE, V2_NUMBERS)})""")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "lineitem", "l_quantity", *V2.split(", "), "l_discount", "l_returnflag")
    return reports.panel_counts(profile.numeric_profile(typed), profile.categorical_profile(typed, profile.value_counts(typed)), relations.correlations(typed), typed.rows)


@query(f"""SELECT "column", rank, name, value FROM ({_frequency_sql("part", ["p_type"])})""")
def category_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed(spark, sf_dir, "part", "p_name", "p_brand", "p_type")
    counts = table(profile.value_counts(typed), "value_counts")
    low = small(relations.low_cardinality(profile.categorical_profile(typed, counts)))
    return reports.category_cards(counts, low).select("column", "rank", "name", "value")


def _types_sql(name: str) -> str:
    """Analytic types by the columns' declared types; numeric ones have at least one number in them, as all numeric columns of these tables do."""
    return f"""SELECT CAST(row_number() OVER () - 1 AS INT) AS ord, column_name AS "column", CASE WHEN column_type LIKE '%[]' THEN 'unsupported' WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS type FROM (DESCRIBE {name}) WHERE (SELECT count(*) FROM {name}) > 0"""


@query(_types_sql("events"))
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_types(_typed(spark, sf_dir, "events"))


@query(f"SELECT type, count(*) AS columns FROM ({_types_sql('embeddings')} UNION ALL {_types_sql('orders')}) GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = columns.column_types(_typed(spark, sf_dir, "embeddings")).union(columns.column_types(_typed(spark, sf_dir, "orders")))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("columns"))


@query("SELECT * FROM customer")
def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources.catalog import Catalog

    catalog = Catalog(spark, scratch(spark, "catalog"))
    return catalog.load(catalog.save(spark.read.parquet(f"{sf_dir}/customer.parquet"), "customer.csv"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def csv_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources import files

    path = scratch(spark, "csv")
    files.write_csv(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return files.read_csv(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type FROM part")
def csv_named_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, named after the data set."""
    from quillon.sources import files

    return files.read_csv(spark, files.export_csv(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type"), scratch(spark, "exports"), "Part.csv"))


@query("SELECT 'orders.csv' AS name, ['o_orderkey', 'o_orderstatus'] AS columns, count(*) AS row_count FROM orders")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets saved, one of them deleted."""
    from quillon.sources.catalog import Catalog

    catalog = Catalog(spark, scratch(spark, "catalog"))
    gone = catalog.save(spark.read.parquet(f"{sf_dir}/nation.parquet"), "nation.csv")
    catalog.save(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), "orders.csv")
    catalog.delete(gone)
    return catalog.list().select("name", "columns", "row_count")


#: Cells of a CSV file made of orders: numbers as text, some of them no numbers, and empty cells.
_CELLS = "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END"


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources import files

    path = scratch(spark, "csv")
    files.write_csv(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", f"{_CELLS} AS mixed", "o_orderstatus"), path)
    return files.read_csv(spark, path)


@query(f"""WITH t AS (SELECT o_orderkey, {_CELLS} AS mixed, o_orderstatus FROM orders), n AS (SELECT o_orderkey, try_cast(mixed AS DOUBLE) AS x, mixed FROM t)
SELECT 'o_orderkey' AS "column", count(o_orderkey) AS n, 0.0 AS missing_pct, round(avg(o_orderkey), 4) AS mean, CAST(max(o_orderkey) AS DOUBLE) AS max FROM t
UNION ALL SELECT 'mixed', count(x), round(CAST((count(*) - count(mixed)) * 100.0 / count(*) AS DOUBLE), 4), round(avg(x), 4), max(x) FROM n""")
def typed_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found per cell: a column with any number is numeric, cells that are none don't count."""
    numeric = profile.numeric_profile(columns.classify(_csv(spark, sf_dir), dynamic=True))
    return _rounded(numeric.select("column", "n", "missing_pct", "mean", "max"), 4, "missing_pct", "mean")


@query(f"WITH g AS ({_groups_sql('lineitem', ['l_returnflag'], ['l_extendedprice', 'l_discount'])}) SELECT cat_col, num_col, category, round(mean, 4) AS mean FROM g WHERE num_col LIKE 'l\\_ext%' ESCAPE '\\'")
def prefix_target_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(_typed(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_discount"))
    return _rounded(reports.of_target(groups, "l_ext", prefix=True), 4, "mean").select("cat_col", "num_col", "category", "mean")


#: A cell of three lines with quotes and commas in it.
_NOTE = "concat('status ', o_orderstatus, chr(10), '\"', o_orderpriority, '\", ', chr(10), CAST(o_custkey AS VARCHAR(20)))"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {_NOTE} AS note, o_orderstatus FROM orders")
def csv_quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file whose cells hold newlines, read in many splits."""
    from quillon.sources import files

    path, most = scratch(spark, "csv"), "spark.sql.files.maxPartitionBytes"
    files.write_csv(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", f"{_NOTE} AS note", "o_orderstatus"), path)
    before = spark.conf.get(most)
    spark.conf.set(most, "256k")
    try:
        return files.read_csv(spark, path)
    finally:
        spark.conf.set(most, before)


def _halves(spark: SparkSession, sf_dir: str, *cells: str):
    """States of both halves of lineitem, as one."""
    from quillon.plans import incremental

    paths, df = [], spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for half in (0, 1):
        paths.append(scratch(spark, "state"))
        incremental.save_state(df.where(f"l_orderkey % 2 = {half}").selectExpr(*cells), paths[-1])
    return incremental.Merged(spark, paths)


@query(f'SELECT "column", n, {_round_stats} FROM ({_numeric_sql("lineitem", LINE_NUMBERS)})')
def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, quartiles included, from the states of two halves."""
    return _rounded(_halves(spark, sf_dir, *LINE_NUMBERS).numeric_profile(), 4, *STATS).drop("ord")


@query(f"""SELECT 'group' AS kind, cat_col AS a, num_col AS b, category, round(mean, 4) AS value, round(median, 4) AS median, "count" AS n FROM ({_groups_sql("lineitem", ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])})
UNION ALL SELECT 'pair', col1, col2, NULL, round(correlation, 6), NULL, NULL FROM ({_pairs_sql("lineitem", ["l_quantity", "l_extendedprice"])})""")
def incremental_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and correlations from the states of two halves."""
    m = _halves(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    groups = m.group_summary(["l_returnflag", "l_linestatus"]).select(F.lit("group").alias("kind"), F.col("cat_col").alias("a"), F.col("num_col").alias("b"), "category", F.round("mean", 4).alias("value"), F.round("median", 4).alias("median"), F.col("count").alias("n"))
    pairs = m.correlations().select(F.lit("pair"), "col1", "col2", F.lit(None).cast("string"), F.round("correlation", 6), F.lit(None).cast("double"), F.lit(None).cast("bigint"))
    return groups.union(pairs)


QUESTIONS = ("summarize", "average of p_retailprice", "maximum of p_size", "distribution of p_size", "most frequent category of p_type", "correlation", "which columns", "hello")


def _answers_sql() -> str:
    number = lambda e: f"printf('%.2f', CAST({e} AS DOUBLE))"
    stats = f"(SELECT * FROM ({_numeric_sql('part', PART_NUMBERS)}) WHERE \"column\" = '{{}}')"
    parts = [
        f"""SELECT '{QUESTIONS[0]}' AS question, '**' || (SELECT count(*) FROM part) || ' records** in **4 columns**: 3 numeric, 1 categorical. Strongest correlation: ' || col1 || ' and ' || col2 || ' (' || {number("correlation")} || ').' AS answer FROM (SELECT * FROM ({_pairs_sql("part", PART_NUMBERS)}) ORDER BY abs(correlation) DESC, ord1, ord2 LIMIT 1)""",
        f"""SELECT '{QUESTIONS[1]}', 'The mean of **p_retailprice** is **' || {number("mean")} || '**, its median ' || {number("median")} || '.' FROM {stats.format("p_retailprice")}""",
        f"""SELECT '{QUESTIONS[2]}', 'The maximum of **p_size** is **' || {number("max")} || '**.' FROM {stats.format("p_size")}""",
        f"""SELECT '{QUESTIONS[3]}', '**p_size** lies between **' || {number("min")} || '** and **' || {number("max")} || '** (range ' || {number("max - min")} || '); its middle half between ' || {number("q1")} || ' and ' || {number("q3")} || ' (IQR **' || {number("q3 - q1")} || '**).' FROM {stats.format("p_size")}""",
        f"""SELECT '{QUESTIONS[4]}', '**' || max(name) FILTER (rank = 1) || '** is the most frequent category of **p_type** (' || max(printf('%.1f%%', CAST(percentage AS DOUBLE))) FILTER (rank = 1) || '), then ' || string_agg(name || ' (' || printf('%.1f%%', CAST(percentage AS DOUBLE)) || ')', ', ' ORDER BY rank) FILTER (rank IN (2, 3)) || '.' FROM ({_frequency_sql("part", ["p_type"])})""",
        f"""SELECT '{QUESTIONS[5]}', CASE WHEN count(*) = 0 THEN 'No correlation is above 0.6.' ELSE 'Correlations above 0.6:' || chr(10) || string_agg('- **' || col1 || '** and **' || col2 || '**: ' || {number("correlation")}, chr(10) ORDER BY ord1, ord2) END FROM (SELECT * FROM ({_pairs_sql("part", PART_NUMBERS)}) WHERE abs(correlation) > 0.6 ORDER BY ord1, ord2 LIMIT 3)""",
        f"""SELECT '{QUESTIONS[6]}', '**Numeric:** ' || string_agg(column_name, ', ' ORDER BY nth) FILTER (column_type <> 'VARCHAR') || chr(10) || chr(10) || '**Categorical:** ' || string_agg(column_name, ', ' ORDER BY nth) FILTER (column_type = 'VARCHAR') FROM (SELECT *, row_number() OVER () AS nth FROM (DESCRIBE SELECT p_partkey, p_size, p_retailprice, p_type FROM part))""",
        f"""SELECT '{QUESTIONS[7]}', 'Ask for a summary, the columns, correlations, the distribution, maximum or average of a numeric column, the most frequent category of another, or insights.' FROM (SELECT count(*) AS n FROM part) WHERE n > 0""",
    ]
    return _union(parts)


@query(_answers_sql())
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.plans.ask import ask

    found = analyze(spark.read.parquet(f"{sf_dir}/part.parquet").select(*PART_NUMBERS, "p_type"), "part.csv")
    return spark.createDataFrame([(q, ask(found, q)) for q in QUESTIONS], "question string, answer string")


def _markdown_sql() -> str:
    two = lambda e: f"printf('%.2f', CAST({e} AS DOUBLE))"
    lines = {"Mean": two("mean"), "Median": two("median"), "Std Dev": two("std"), "CV (%)": two("cv"), "Range": f"{two('min')} || ' - ' || {two('max')}"}
    stats = _numeric_sql("part", ["p_size", "p_retailprice"])
    return _union([f"""SELECT '- **{name}:** ' || {value} AS line FROM ({stats})""" for name, value in lines.items()] + [f"""SELECT '### ' || "column" || ' (numeric)' FROM ({stats})""", "SELECT '**Records:** ' || count(*) FROM part", """SELECT '### p_type (categorical)' FROM (SELECT count(*) AS n FROM part) WHERE n > 0""", "SELECT '- **Unique Values:** ' || count(DISTINCT p_type) FROM part", f"""SELECT '- **Mode:** ' || name FROM ({_frequency_sql("part", ["p_type"])}) WHERE rank = 1""", f"""SELECT '- **Top Categories:** ' || string_agg(name || ' (' || printf('%.1f%%', CAST(percentage AS DOUBLE)) || ')', ', ' ORDER BY rank) FROM ({_frequency_sql("part", ["p_type"])}) WHERE rank <= 3"""])


@query(_markdown_sql())
def markdown_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the Markdown export that state a value of a column."""
    from quillon.plans import render

    text = render.markdown(analyze(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice", "p_type"), "part.csv"))
    kept = ("### ", "- **Mean", "- **Median", "- **Std", "- **CV", "- **Range", "**Records", "- **Unique", "- **Mode", "- **Top")
    return spark.createDataFrame([(line,) for line in text.splitlines() if line.startswith(kept)], "line string")


@query(_union([f"""SELECT '{c}' AS "column", CAST(b.bin AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS "count" FROM (SELECT unnest(range(15)) AS bin) b LEFT JOIN (SELECT least(CAST(floor(({c} - lo) / ((hi - lo) / 15)) AS INT), 14) AS bin, count(*) AS n FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM part), (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM part) GROUP BY 1) h ON h.bin = b.bin""" for c in ("p_size", "p_retailprice")]))
def analysis_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", "p_retailprice", "p_type"), "part.csv").histograms
    return spark.createDataFrame([(c, r["bin"], r["count"]) for c, rows in found.items() for r in rows], "column string, bin int, count bigint")


@query(_frequency_sql("part", ["p_name"]).replace("SELECT ord, ", "SELECT ", 1).replace(", value * 100.0 / sum(value) OVER (PARTITION BY ord) AS percentage", ""))
def every_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All categories of a column of very many, in order."""
    typed = _typed(spark, sf_dir, "part", "p_name")
    return profile.frequencies(profile.value_counts(typed)).select("column", "rank", "name", "value")
