"""Reports derived from profiles. Inputs have as many rows as the data set has columns, pairs of columns, or groups.

Thresholds on statistics apply to values as printed (two decimals, one for missing shares).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.profile import frequencies
from quillon.operators.relations import mirrored


def top_correlations(pairs: DataFrame, limit: int = 5, threshold: float = 0.5) -> DataFrame:
    """Pairs whose printed |r| is above the threshold, strongest first."""
    r = pairs.withColumn("printed", F.round("correlation", 2)).where(F.abs("printed") > threshold)
    return r.orderBy(F.desc(F.abs("printed")), "ord1", "ord2").limit(limit).drop("printed")


def drivers(pairs: DataFrame, limit: int = 3, threshold: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("correlation") >= threshold).orderBy(F.desc(F.abs("correlation")), "ord1", "ord2").limit(limit)


def critical_insights(insights: DataFrame) -> DataFrame:
    return insights.where("type = 'warning'").orderBy("seq")


def unstable_columns(numeric: DataFrame, threshold: float = 50) -> DataFrame:
    """(ord, column, cv, reason): variation above the threshold. A mean of 0 makes it infinite, which is above any."""
    cv = F.round("cv", 2)
    endless = F.col("cv").isNull() & (F.col("std") > 0)
    return numeric.where((cv > threshold) | endless).select("ord", "column", "cv", F.when(endless, "zero mean").otherwise("high variation").alias("reason")).orderBy(F.desc_nulls_first("cv"), "ord")


def missing_summary(profiles: DataFrame, rows: int, present: DataFrame) -> DataFrame:
    """(column, missing_pct, missing_rows, affected_records) of columns whose printed share is above 0.

    profiles: (ord, column, missing_pct); present: (column, present). missing_rows is exact, affected_records follows from the printed share.
    """
    printed = F.round("missing_pct", 1)
    out = profiles.where(printed > 0).join(present, "column")
    return out.select("ord", "column", printed.alias("missing_pct"), (F.lit(rows) - F.col("present")).alias("missing_rows"), F.floor(printed * rows / 100 + 0.5).alias("affected_records")).orderBy(F.desc("missing_pct"), "ord")


def key_like_columns(categorical: DataFrame, rows: int, threshold: float = 0.8) -> DataFrame:
    return categorical.where(F.try_divide(F.col("unique").cast("double"), F.lit(rows)) > threshold).select("ord", "column", "unique").orderBy("ord")


def quality_overview(numeric: DataFrame, categorical: DataFrame, rows: int) -> DataFrame:
    """One row: records, columns of each type, incomplete columns and the verdict."""
    every = numeric.select("missing_pct", F.lit("numeric").alias("type")).union(categorical.select("missing_pct", F.lit("categorical").alias("type")))
    counts = every.agg(F.count_if(F.col("type") == "numeric").alias("numeric_columns"), F.count_if(F.col("type") == "categorical").alias("categorical_columns"), F.count_if(F.round("missing_pct", 1) > 0).alias("incomplete_columns"))
    verdict = F.when(F.col("incomplete_columns") == 0, "Clean").otherwise(F.concat(F.col("incomplete_columns"), F.lit(" Columns Affected")))
    return counts.select(F.lit(rows).cast("long").alias("records"), "*", verdict.alias("status"))


def price_driver(pairs: DataFrame, word: str = "price") -> DataFrame:
    """(col1, chosen_r, shown_r): the first column of the strongest pair that names a price; shown_r belongs to the first pair of that column."""
    named = pairs.where(F.lower("col1").contains(word) | F.lower("col2").contains(word))
    best = named.orderBy(F.desc(F.abs("correlation")), "ord1", "ord2").limit(1).select("col1", F.col("correlation").alias("chosen_r"))
    first = pairs.groupBy("col1").agg(F.min_by("correlation", F.struct("ord1", "ord2")).alias("shown_r"))
    return best.join(first, "col1")


def of_target(groups: DataFrame, target: str, prefix: bool = False) -> DataFrame:
    """Groups of a numeric column; prefix also takes columns whose names begin with it."""
    return groups.where(F.col("num_col").startswith(target) if prefix else F.col("num_col") == target)


def premium_segment(groups: DataFrame, targets: list[str]) -> DataFrame:
    """(cat_col, num_col, category, mean): the group of the highest mean of any target."""
    mine = groups.where(F.col("num_col").isin(targets))
    return mine.orderBy(F.desc("mean"), "cat_col", "num_col", "category").limit(1).select("cat_col", "num_col", "category", "mean")


def core_segment(categorical: DataFrame) -> DataFrame:
    """(column, mode) of the categorical column of the most values, at least two."""
    return categorical.where("unique > 1").orderBy(F.desc("unique"), "ord").limit(1).select("column", "mode", "unique")


def choose_target(numeric: list[str]) -> str | None:
    """First numeric column that names a price, else a salary, else the first; none if there are fewer than two."""
    if len(numeric) < 2:
        return None
    for word in ("price", "salary"):
        for c in numeric:
            if word in c.lower():
                return c
    return numeric[0]


def risk_adjusted(numeric: DataFrame, pairs: DataFrame, target: str, limit: int = 5) -> DataFrame:
    """(column, correlation, cv, score): |r| with the target over the printed variation."""
    cv = F.round("cv", 2)
    r = mirrored(pairs).where(F.col("col2") == target).select(F.col("col1").alias("column"), F.abs("correlation").alias("correlation"))
    scored = numeric.where((F.col("column") != target) & (cv != 0)).select("ord", "column", cv.alias("cv")).join(F.broadcast(r), "column", "left")
    scored = scored.withColumn("correlation", F.coalesce("correlation", F.lit(0.0))).withColumn("score", F.round(F.col("correlation") / (F.col("cv") / 100), 3))
    return scored.orderBy(F.desc("score"), "ord").limit(limit).select("ord", "column", "correlation", "cv", "score")


def leveraged_gain(groups: DataFrame, numeric: DataFrame, target: str, limit: int = 3) -> DataFrame:
    """(cat_col, category, gain): groups whose mean is far above their median."""
    std = numeric.where(F.col("column") == target).select(F.round("std", 2).alias("std"))
    far = of_target(groups, target).crossJoin(F.broadcast(std))  # one row
    far = far.where((F.col("mean") - F.col("median") > 0.2 * F.col("std")) & (F.col("mean") > 0)).withColumn("gain", F.round(F.col("mean") - F.col("median"), 0))
    return far.orderBy(F.desc("gain"), "cat_col", "category").limit(limit).select("cat_col", "category", "mean", "median", "gain")


def best_and_worst(groups: DataFrame, target: str) -> DataFrame:
    """(role, cat_col, category, mean): the groups of the highest mean, and of the lowest above 0."""
    mine = of_target(groups, target)
    best = mine.orderBy(F.desc("mean"), "cat_col", "category").limit(1).withColumn("role", F.lit("best"))
    worst = mine.where("mean > 0").orderBy("mean", "cat_col", "category").limit(1).withColumn("role", F.lit("worst"))
    return best.union(worst).select("role", "cat_col", "category", "mean")


def snapshot(insights: DataFrame, limit: int = 5) -> DataFrame:
    return insights.orderBy("seq").limit(limit)


def panel_counts(numeric: DataFrame, categorical: DataFrame, pairs: DataFrame, rows: int, threshold: float = 0.7) -> DataFrame:
    """One row: records, columns of each type, pairs whose |r| is above the threshold."""
    n, c = numeric.agg(F.count(F.lit(1)).alias("numeric_columns")), categorical.agg(F.count(F.lit(1)).alias("categorical_columns"))
    strong = pairs.agg(F.count_if(F.abs("correlation") > threshold).alias("strong_pairs"))
    return n.crossJoin(c).crossJoin(strong).select(F.lit(rows).cast("long").alias("records"), "*")  # one row each


def category_cards(counts: DataFrame, low: DataFrame) -> DataFrame:
    """Frequencies of the columns that `relations.low_cardinality` keeps; the others' counts are left out before they are ranked."""
    return frequencies(counts.join(F.broadcast(low.select("ord")), "ord", "left_semi"))
