"""Relations between columns: correlations, and numeric columns by category."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import pearson
from quillon.operators import gram, quantiles
from quillon.operators.columns import Typed
from quillon.sources.scratch import table

#: Pairs in one aggregation.
PAIRS = 200
LOW_CARDINALITY = 15
CATEGORY_CHARS = 15


_PAIRS = "ord1 int, ord2 int, col1 string, col2 string, correlation double"


def _of_pairs(typed: Typed, pairs: list[tuple[int, int]]) -> DataFrame:
    """One aggregation for every PAIRS pairs."""
    wide, out = typed.wide(), None
    for at in range(0, len(pairs), PAIRS):
        records = [F.struct(F.lit(typed.ord(typed.numeric[i])).alias("ord1"), F.lit(typed.ord(typed.numeric[j])).alias("ord2"), F.lit(typed.numeric[i]).alias("col1"), F.lit(typed.numeric[j]).alias("col2"), pearson(F.col(f"x{i}"), F.col(f"x{j}")).alias("correlation")) for i, j in pairs[at : at + PAIRS]]
        part = wide.agg(F.array(*records).alias("records")).select(F.inline("records"))
        out = part if out is None else out.union(part)
    return out if out is not None else typed.df.sparkSession.createDataFrame([], _PAIRS)


def correlations(typed: Typed) -> DataFrame:
    """(ord1, ord2, col1, col2, correlation) of all pairs in column order. More than PAIRS are found by matrix products (`gram`), but for the
    pairs that these leave in doubt."""
    pairs = list(combinations(range(len(typed.numeric)), 2))
    if len(pairs) <= PAIRS:
        return _of_pairs(typed, pairs)
    found = table(gram.correlations(typed), "correlations")
    doubtful = [(r["i"], r["j"]) for r in found.where("doubtful").select("i", "j").collect()]  # pairs of columns
    names = typed.df.sparkSession.createDataFrame([(i, typed.ord(c), c) for i, c in enumerate(typed.numeric)], "nth int, ord int, column string")
    first, second = (names.select(F.col("nth").alias(at), F.col("ord").alias(f"ord{k}"), F.col("column").alias(f"col{k}")) for at, k in (("i", 1), ("j", 2)))
    clear = found.where("not doubtful").join(F.broadcast(first), "i").join(F.broadcast(second), "j").select("ord1", "ord2", "col1", "col2", "correlation")
    return clear.union(_of_pairs(typed, doubtful)) if doubtful else clear


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders."""
    turned = pairs.select(F.col("ord2").alias("ord1"), F.col("ord1").alias("ord2"), F.col("col2").alias("col1"), F.col("col1").alias("col2"), "correlation")
    return pairs.select("ord1", "ord2", "col1", "col2", "correlation").union(turned)


def correlation_matrix(typed: Typed, pairs: DataFrame) -> DataFrame:
    """One row and one column per numeric column; 1 on the diagonal."""
    own = typed.df.sparkSession.createDataFrame([(typed.ord(c), typed.ord(c), c, c, 1.0) for c in typed.numeric], "ord1 int, ord2 int, col1 string, col2 string, correlation double")
    return mirrored(pairs).union(own).groupBy("ord1", "col1").pivot("col2", typed.numeric).agg(F.first("correlation")).withColumnRenamed("col1", "column")


def heat(correlation: str = "correlation") -> list:
    """Intensity (0 to 90 in tens) and hue of a heat map's cell, by the value as printed; 1 and 0 have hues of their own."""
    r = F.round(correlation, 2)
    hue = F.when(r == 1, "full").when(r > 0, "positive").when(r < 0, "negative").otherwise("neutral")
    return [(F.floor(F.abs(r) * 9 + 0.5) * 10).cast("int").alias("intensity"), hue.alias("hue")]


def low_cardinality(categorical: DataFrame) -> DataFrame:
    return categorical.where(F.col("unique") < LOW_CARDINALITY)


def group_summary(typed: Typed, categories: list[str], names: list[str] | None = None) -> DataFrame:
    """(cat_col, num_col, category, mean, median, min, max, count) of numeric columns by category.

    Every row goes once to each categorical column's group; groups are aggregated before the shuffle. Medians of more rows
    than one task may hold are ranked exactly by `quantiles`.
    """
    names = typed.numeric if names is None else names
    schema = "cat_col string, num_col string, category string, mean double, median double, min double, max double, count bigint"
    if not categories or not names:
        return typed.df.sparkSession.createDataFrame([], schema)
    x = {c: f"x{typed.numeric.index(c)}" for c in names}
    cells = F.array(*(F.struct(F.lit(c).alias("cat_col"), F.col(f"k{typed.categorical.index(c)}").alias("category")) for c in categories))
    groups = typed.wide().select(F.inline(cells), *x.values()).where("category is not null")
    small = typed.rows <= quantiles.DIRECT
    numbers = {i: (c, v) for i, (c, v) in enumerate(x.items())}
    stats = {i: [F.lit(i).alias("col"), F.lit(c).alias("num_col"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"), *([F.percentile(F.col(v), F.lit(0.5)).alias("median")] if small else [])] for i, (c, v) in numbers.items()}
    records = F.array(*(F.struct(*s) for s in stats.values())).alias("records")
    key = ["cat_col", "category"]
    if small:
        out = groups.groupBy(*key).agg(records).select(*key, F.inline("records"))
    else:
        first = table(groups.groupBy(*key).agg(records, *(quantiles.brackets(F.col(v), quantiles.MEDIAN).alias(f"ends_{i}") for i, (_, v) in numbers.items())), "groups")
        medians = quantiles.selected(groups, key, {i: v for i, (_, v) in numbers.items()}, quantiles.MEDIAN, first.drop("records"))
        out = first.select(*key, F.inline("records")).join(medians.select(*key, "col", quantiles.middle().alias("median")), [*key, "col"], "left")
    return out.where("count > 0").select("cat_col", "num_col", F.substring("category", 1, CATEGORY_CHARS).alias("category"), "mean", "median", "min", "max", "count")
