"""Univariate profiles: numeric statistics, category frequencies and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.numbers import fixed, number, plain, quoted, variation
from quillon.operators import quantiles
from quillon.operators.columns import Typed
from quillon.sources.scratch import table

NAME_CHARS = 20


def missing_percent(typed: Typed, name: str) -> float:
    return (typed.rows - typed.present[name]) * 100.0 / typed.rows if typed.rows else 0.0


def missing_shares(typed: Typed, names: list[str]) -> DataFrame:
    """(ord, column, missing_pct) of columns, known from their types' scan."""
    return typed.df.sparkSession.createDataFrame([(typed.ord(c), c, missing_percent(typed, c)) for c in names], "ord int, column string, missing_pct double")


QUARTILES = ((0.25, "floor"), (0.5, "middle"), (0.75, "floor"))


def numeric_profile(typed: Typed) -> DataFrame:
    """(ord, column, n, missing_pct, mean, median, min, max, q1, q3, std, cv): one aggregation for all columns."""
    names = ["ord", "column", "n", "missing_pct", "mean", "median", "min", "max", "q1", "q3", "std"]
    if not typed.numeric:
        return typed.df.sparkSession.createDataFrame([], "ord int, column string, n bigint, missing_pct double, mean double, median double, min double, max double, q1 double, q3 double, std double, cv double")

    def stats(name: str, cell: str) -> dict[str, Column]:
        x = F.col(cell)
        return {"ord": F.lit(typed.ord(name)), "n": F.count(x), "missing_pct": F.lit(missing_percent(typed, name)), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.stddev_pop(x)}

    rows = quantiles.column_records(typed, stats, QUARTILES, ("q1", "median", "q3")).select(*names)
    return rows.withColumn("cv", variation(F.col("std"), F.col("mean")))


def order_statistics(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, n, min, q1, median_low, median_high, q3, max) of numeric columns, each as the text of a value of the column's own type: integers and decimals of
    any length are as exact as they are in the data. The medians are the two middle elements; NaN and infinities don't count."""
    own: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if (names is None or f.name in names) and isinstance(f.dataType, T.NumericType):
            own.setdefault("bigint" if isinstance(f.dataType, T.IntegralType) else f.dataType.simpleString() if isinstance(f.dataType, T.DecimalType) else "double", []).append(f.name)
    out = {}
    for kind, mine in own.items():
        rows = df.select(*((number(quoted(c), T.DoubleType()) if kind == "double" else quoted(c).cast(kind)).alias(f"x{i}") for i, c in enumerate(mine)))
        text = lambda c: c.cast("string")
        ends = rows.agg(*(text(f(f"x{i}")).alias(f"{k}{i}") for i in range(len(mine)) for k, f in (("min", F.min), ("max", F.max)))).first()
        found = quantiles.selected(rows, [], {i: f"x{i}" for i in range(len(mine))}, QUARTILES, kind=kind)
        values = {r["col"]: r for r in found.select("col", "n", F.transform("low", text).alias("low"), F.transform("high", text).alias("high")).collect()}  # a row for each column
        for i, c in enumerate(mine):
            r = values.get(i)
            out[c] = (c, r["n"], ends[f"min{i}"], r["low"][0], r["low"][1], r["high"][1], r["low"][2], ends[f"max{i}"]) if r else (c, 0, *[None] * 6)
    schema = "column string, n bigint, min string, q1 string, median_low string, median_high string, q3 string, max string"
    return df.sparkSession.createDataFrame([out[c] for c in df.columns if c in out], schema)


def value_counts(typed: Typed) -> DataFrame:
    """(ord, column, name, value): rows of each non-null value of each categorical column; the value whole."""
    if not typed.categorical:
        return typed.df.sparkSession.createDataFrame([], "ord int, column string, name string, value bigint")
    cells = F.array(*(F.struct(F.lit(typed.ord(c)).alias("ord"), F.lit(c).alias("column"), F.col(f"k{i}").alias("name")) for i, c in enumerate(typed.categorical)))
    return typed.wide().select(F.inline(cells)).where("name is not null").groupBy("ord", "column", "name").agg(F.count(F.lit(1)).alias("value"))


def frequencies(counts: DataFrame, top: int | None = None) -> DataFrame:
    """(ord, column, rank, name, value, percentage) by falling value; ties by name. Percentages are of non-null cells, names are cut to 20 characters after grouping.

    top keeps that many of each column, which is decided before the shuffle. Without it every category has its rank: where there are many, they
    are sorted in ranges and written, and a rank is a place within its range, after all that come before.
    """
    totals = counts.groupBy("ord").agg(F.sum("value").alias("total"))
    if top is not None or counts.count() <= quantiles.DIRECT:
        order = Window.partitionBy("ord", "column").orderBy(F.desc("value"), "name")
        ranks = counts.withColumn("rank", F.row_number().over(order))
        ranks = ranks if top is None else ranks.where(F.col("rank") <= top)
    else:
        ranks = _ranks_by_range(counts)
    shares = ranks.join(F.broadcast(totals), "ord")  # as many rows as columns
    return shares.select("ord", "column", "rank", F.substring("name", 1, NAME_CHARS).alias("name"), "value", (F.col("value") * 100.0 / F.col("total")).alias("percentage"))


def _ranks_by_range(counts: DataFrame) -> DataFrame:
    ordered = table(counts.orderBy("ord", F.desc("value"), "name").withColumn("at", F.monotonically_increasing_id()), "frequencies")
    part = F.shiftright("at", 33)  # the number of the range, as monotonically_increasing_id() has it
    firsts = ordered.groupBy("ord", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("ord", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each range and column
    ranks = ordered.withColumn("part", part).join(F.broadcast(firsts), ["ord", "part"])
    return ranks.select(*counts.columns, (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("rank"))


def categorical_profile(typed: Typed, counts: DataFrame) -> DataFrame:
    """(ord, column, unique, mode, missing_pct): the mode is the first of the frequencies, N/A if there is none or it is empty."""
    first = F.min(F.struct((-F.col("value")).alias("minus"), "name"))["name"]
    found = counts.groupBy("ord").agg(F.count(F.lit(1)).alias("unique"), first.alias("mode"))
    columns = typed.df.sparkSession.createDataFrame([(typed.ord(c), c, missing_percent(typed, c)) for c in typed.categorical], "ord int, column string, missing_pct double")
    mode = F.coalesce(F.nullif(F.substring("mode", 1, NAME_CHARS), F.lit("")), F.lit("N/A"))
    return columns.join(found, "ord", "left").select("ord", "column", F.coalesce("unique", F.lit(0)).alias("unique"), mode.alias("mode"), "missing_pct")


def bins_of(low: float, high: float, bins: int) -> tuple[list[tuple[int, str, float]], float, float, float]:
    """(bin, range, start) of each bin, and low, step and unit with which a value's bin is floor((value * unit - low) / step)."""
    if low == high:
        return [(0, plain(low), low)], low, 1.0, 1.0
    unit = 1.0 if high - low < float("inf") else 0.25  # the width may be more than a double holds
    low, step = low * unit, (high * unit - low * unit) / bins
    starts = [(low + b * step) / unit for b in range(bins)]
    ends = [*starts[1:], (low + bins * step) / unit if unit == 1 else high]
    return [(b, f"{fixed(s, 0)}-{fixed(e, 0)}", s) for b, (s, e) in enumerate(zip(starts, ends, strict=True))], low, step, unit


def histogram(typed: Typed, bins: int = 15, names: list[str] | None = None, ends: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, bin, range, range_start, count): equal widths, the last bin closed, empty bins kept; a constant column has one bin. ends: least and greatest values, if they are known."""
    spark = typed.df.sparkSession
    names = [c for c in (names or typed.numeric) if c in typed.numeric]
    wide = typed.wide()
    at = {c: f"x{typed.numeric.index(c)}" for c in names}
    if not names:
        return spark.createDataFrame([], "column string, bin int, range string, range_start double, count bigint")
    if ends is None:
        row = wide.agg(*(f for x in at.values() for f in (F.min(x).alias(f"{x}_low"), F.max(x).alias(f"{x}_high")))).first()
        ends = {c: (row[f"{x}_low"], row[f"{x}_high"]) for c, x in at.items()}
    frame, cells = [], []
    for c, x in at.items():
        low, high = ends[c]
        mine, low, step, unit = bins_of(low, high, bins)
        frame += [(c, *m) for m in mine]
        bin_ = F.when(F.col(x).isNotNull(), F.lit(0) if len(mine) == 1 else F.least(F.floor((F.col(x) * unit - low) / step), F.lit(bins - 1)).cast("int"))
        cells.append(F.struct(F.lit(c).alias("column"), bin_.alias("bin")))
    counted = wide.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    every = spark.createDataFrame(frame, "column string, bin int, range string, range_start double")
    return every.join(counted, ["column", "bin"], "left").select("column", "bin", "range", "range_start", F.coalesce("count", F.lit(0)).alias("count"))
