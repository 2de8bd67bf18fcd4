"""Operations that the exported scripts use: they differ from the profile in deviation, quantiles and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import quoted
from quillon.operators import quantiles
from quillon.operators.columns import Typed
from quillon.operators.quantiles import MEDIAN
from quillon.operators.relations import mirrored
from quillon.sources.scratch import table


QUARTILES = ((0.25, "linear"), (0.5, "linear"), (0.75, "linear"))


def describe(typed: Typed) -> DataFrame:
    """count, mean, sample deviation, min, interpolated quartiles, max of each numeric column."""
    x = F.col
    rows = quantiles.column_records(typed, lambda _, c: {"count": F.count(x(c)), "mean": F.avg(x(c)), "std": F.stddev_samp(x(c)), "min": F.min(x(c)), "max": F.max(x(c))}, QUARTILES, ("p25", "p50", "p75"))
    return rows.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def boxplot(typed: Typed) -> DataFrame:
    """Interpolated quartiles and the fences at 1.5 times their distance."""
    q = quantiles.column_records(typed, lambda _, c: {}, QUARTILES, ("q1", "q2", "q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select("*", (F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence"))


def null_counts(df: DataFrame) -> DataFrame:
    records = [F.struct(F.lit(c).alias("column"), F.count_if(quoted(c).isNull()).alias("nulls")) for c in df.columns]
    return df.agg(F.array(*records).alias("records")).select(F.inline("records"))


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def value_shares(frequencies: DataFrame) -> DataFrame:
    """Percentages of non-null cells with two decimals."""
    return frequencies.select("column", "name", F.round("percentage", 2).alias("pct"))


def highest_correlations(pairs: DataFrame, limit: int = 5) -> DataFrame:
    """The highest distinct values of the whole matrix, its diagonal included."""
    one = pairs.sparkSession.createDataFrame([(1.0,)], "correlation double")
    return mirrored(pairs).select("correlation").union(one).distinct().orderBy(F.desc("correlation")).limit(limit)


def group_aggregate(typed: Typed, target: str, by: str | None = None) -> DataFrame:
    """count, mean, median, sample deviation, min, max of a column by the first categorical one, with two decimals."""
    by = by or typed.categorical[0]
    x = F.col("x")
    rows = typed.df.select(typed.k(by).alias("category"), typed.x(target).alias("x")).where("category is not null")
    stats = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    if typed.rows <= quantiles.DIRECT:
        out = rows.groupBy("category").agg(F.percentile(x, F.lit(0.5)).alias("median"), *stats)
    else:
        first = table(rows.groupBy("category").agg(*stats, quantiles.brackets(x, MEDIAN).alias("ends_0")), "groups")
        medians = quantiles.selected(rows, ["category"], {0: "x"}, MEDIAN, first.select("category", "ends_0"))
        out = first.join(medians.select("category", quantiles.middle().alias("median")), "category", "left")
    return out.select("category", "count", *(F.round(c, 2).alias(c) for c in ("mean", "median", "std", "min", "max")))
