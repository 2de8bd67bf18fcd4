"""Rules that turn profiles into findings. Conditions use unrounded values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKEW, SKEW_ROWS, SIGMAS, DOMINANT, STRONG, ENOUGH = 0.5, 30, 3, 70, 0.7, 10


def skewed(numeric: DataFrame) -> DataFrame:
    return numeric.where((F.col("std") > 0) & (F.col("n") > SKEW_ROWS) & (F.try_divide(F.abs(F.col("mean") - F.col("median")), F.col("std")) > SKEW))


def outlying(numeric: DataFrame) -> DataFrame:
    return numeric.where((F.col("std") > 0) & (F.col("max") > F.col("mean") + SIGMAS * F.col("std")))


def dominated(frequencies: DataFrame) -> DataFrame:
    """The first category of columns that have at least two of which it covers more than 70 %."""
    several = frequencies.where("rank = 2").select("ord")
    return frequencies.where((F.col("rank") == 1) & (F.col("percentage") > DOMINANT)).join(several, "ord", "left_semi")


def strong_pairs(pairs: DataFrame, threshold: float = STRONG) -> DataFrame:
    return pairs.where(F.abs("correlation") > threshold)


def _number(column: str, places: int):
    return F.format_string(f"%.{places}f", F.col(column))


def insights(numeric: DataFrame, frequencies: DataFrame, pairs: DataFrame, rows: int, columns: int, n_numeric: int, n_low: int) -> DataFrame:
    """(seq, agent, type, rule, col1, col2, metric, text) in order of columns, then pairs, then the closing remark."""
    none = F.lit(None).cast("string")

    def found(df: DataFrame, part: int, at: list, agent: str, kind: str, rule: str, col1, col2, metric, text) -> DataFrame:
        return df.select(F.struct(F.lit(part).alias("part"), *(v.alias(f"at{i}") for i, v in enumerate(at))).alias("at"), F.lit(agent).alias("agent"), F.lit(kind).alias("type"), F.lit(rule).alias("rule"), col1.alias("col1"), col2.alias("col2"), metric.cast("double").alias("metric"), text.alias("text"))

    c, zero = F.col("column"), F.lit(0)
    parts = [
        found(skewed(numeric), 0, [F.col("ord"), zero], "Analyst", "warning", "skew", c, none, F.try_divide(F.abs(F.col("mean") - F.col("median")), F.col("std")), F.concat(F.lit("**"), c, F.lit("** looks **skewed**: mean "), _number("mean", 0), F.lit(" against median "), _number("median", 0), F.lit("."))),
        found(outlying(numeric), 0, [F.col("ord"), F.lit(1)], "Analyst", "warning", "outlier", c, none, F.col("max"), F.concat(F.lit("**"), c, F.lit("** has an extreme maximum of "), _number("max", 0), F.lit(": an outlier, or a premium segment."))),
        found(dominated(frequencies), 0, [F.col("ord"), zero], "Insight", "info", "dominance", c, none, F.col("percentage"), F.concat(F.lit("**"), F.col("name"), F.lit("** makes up "), _number("percentage", 1), F.lit("% of **"), c, F.lit("**."))),
        found(strong_pairs(pairs), 1, [F.col("ord1"), F.col("ord2")], "Analyst", "info", "strong_pair", F.col("col1"), F.col("col2"), F.col("correlation"), F.concat(F.lit("**"), F.col("col1"), F.lit("** and **"), F.col("col2"), F.lit("** have a strong **"), F.when(F.col("correlation") > 0, "positive").otherwise("negative"), F.lit("** correlation (r = "), _number("correlation", 2), F.lit(")."))),
    ]
    if rows > ENOUGH:
        text = f"Profiled **{rows} records** with **{columns} columns**: **{n_numeric}** numeric and **{n_low}** categorical ones of few values."
        one = numeric.sparkSession.range(1)
        parts.append(found(one, 2, [zero, zero], "Insight", "success", "completion", none, none, F.lit(rows), F.lit(text)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # as many rows as columns and pairs of columns
    return every.select(F.row_number().over(Window.orderBy("at")).alias("seq"), "agent", "type", "rule", "col1", "col2", "metric", "text")
