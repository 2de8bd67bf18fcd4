"""Analyses of data that grow: what has been read once isn't read again.

A state is what an analysis needs of some rows: of each column how often it has each number or text, of pairs of numeric columns their means, squares and products, of
columns of few categories how often each number comes with each category. States are tables in a folder. States of parts add up to the state of the whole, so when files are appended only they
are scanned, and the analysis of all is made of states: exact, medians, quartiles and frequencies included. A state is at most as large as the distinct cells of its rows.

A column is numeric if any part has a number in it. A column that a part lacks has no cells there; columns keep the order in which the parts bring them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import columns, gram, insights, profile, quantiles, relations
from quillon.plans.analysis import Profile, analysis_of, small
from quillon.sources.scratch import table

TABLES = ("columns", "numbers", "labels", "pairs", "groups")


def save_state(df: DataFrame, path: str, dynamic: bool = False) -> None:
    """Writes the state of df's rows. dynamic: see `columns.classify`."""
    spark, typed = df.sparkSession, columns.classify(df, dynamic)
    wide = typed.wide()
    facts = [(i, c, c not in typed.unsupported, typed.rows, typed.present.get(c, 0), typed.numbers.get(c, 0)) for i, c in enumerate(df.columns)]
    spark.createDataFrame(facts, "ord int, column string, supported boolean, rows bigint, present bigint, numbers bigint").coalesce(1).write.parquet(f"{path}/columns")
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"x{i}").cast("double").alias("value")) for i, c in enumerate(typed.numeric)]
    numbers = wide.select(F.inline(F.array(*cells))).where("value is not null") if cells else spark.createDataFrame([], "column string, value double")
    numbers.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/numbers")
    profile.value_counts(typed).select("column", "name", F.col("value").alias("n")).write.parquet(f"{path}/labels")
    names = F.array(*map(F.lit, typed.numeric))
    pairs = gram.sums(typed) if len(typed.numeric) > 1 else spark.createDataFrame([], "i int, j int, n bigint, mean1 double, mean2 double, m11 double, m22 double, m12 double")
    pairs.where("n > 0").select(F.get(names, "i").alias("col1"), F.get(names, "j").alias("col2"), "n", "mean1", "mean2", "m11", "m22", "m12").write.parquet(f"{path}/pairs")
    low = spark.read.parquet(f"{path}/labels").groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    few = [r["column"] for r in relations.low_cardinality(low).collect()]  # columns
    by = [F.struct(F.lit(c).alias("cat_col"), F.col(f"k{typed.categorical.index(c)}").alias("category")) for c in few]
    groups = spark.createDataFrame([], "cat_col string, category string, column string, value double")
    if by and cells:
        groups = wide.select(F.explode(F.array(*by)).alias("by"), F.array(*cells).alias("cells")).select("by.*", F.inline("cells")).where("category is not null and value is not null")
    groups.groupBy("cat_col", "category", F.col("column").alias("num_col"), "value").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/groups")


class Merged:
    """States of parts as one."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        parts = {t: [spark.read.parquet(f"{p}/{t}") for p in paths] for t in TABLES}
        facts: dict[str, list] = {}
        for part in parts["columns"]:
            for r in part.orderBy("ord").collect():  # a row for each column
                f = facts.setdefault(r["column"], [True, 0, 0])
                f[0], f[1], f[2] = f[0] and r["supported"], f[1] + r["present"], f[2] + r["numbers"]
        rows = sum(part.agg(F.max("rows")).first()[0] or 0 for part in parts["columns"])
        numeric = [c for c, f in facts.items() if f[0] and f[2]]
        categorical = [c for c, f in facts.items() if f[0] and not f[2]]
        empty = spark.createDataFrame([], ", ".join("`" + c.replace("`", "``") + "` string" for c in facts))
        #: What the parts' columns are; it has no rows of them.
        self.typed = columns.Typed(empty, numeric, categorical, [c for c, f in facts.items() if not f[0]], rows, {c: f[1] for c, f in facts.items() if f[0]}, {c: f[2] for c, f in facts.items() if f[2]})
        self.spark = spark

        def added(name: str, *by: str) -> DataFrame:
            every = parts[name][0]
            for p in parts[name][1:]:
                every = every.unionByName(p)
            return table(every.groupBy(*by).agg(F.sum("n").alias("n")), f"merged_{name}")

        ords = spark.createDataFrame([(i, c) for i, c in enumerate(empty.columns)], "ord int, column string")
        of = lambda df, names, column: df.where(F.col(column).isin(names)) if names else df.limit(0)
        self.numbers = of(added("numbers", "column", "value"), numeric, "column").join(F.broadcast(ords), "column")
        self.counts = of(added("labels", "column", "name"), categorical, "column").join(F.broadcast(ords), "column").select("ord", "column", "name", F.col("n").alias("value"))
        self._groups = added("groups", "cat_col", "category", "num_col", "value")
        self._pairs, self._ords = parts["pairs"], ords

    def numeric_profile(self) -> DataFrame:
        """As `profile.numeric_profile`."""
        if not self.typed.numeric:
            return profile.numeric_profile(self.typed)
        n, v = F.col("n"), F.col("value")
        stats = table(self.numbers.groupBy("ord", "column").agg((F.sum(n * v) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(n).alias("n")), "numeric_states")
        spread = self.numbers.join(F.broadcast(stats.select("ord", "mean")), "ord").groupBy("ord").agg(F.sqrt(F.sum(n * (v - F.col("mean")) ** 2) / F.sum(n)).alias("std"))
        ranks = self._quantiles(self.numbers.select(F.col("ord").alias("col"), "value", "n"), [], profile.QUARTILES)
        at = lambda side, i: F.get(side, F.lit(i))
        quartiles = ranks.select(F.col("col").alias("ord"), at("low", 0).alias("q1"), (at("low", 1) + (at("high", 1) - at("low", 1)) / 2).alias("median"), at("low", 2).alias("q3"))
        missing = profile.missing_shares(self.typed, self.typed.numeric).select("ord", "missing_pct")
        rows = stats.join(F.broadcast(spread), "ord").join(F.broadcast(quartiles), "ord").join(F.broadcast(missing), "ord")  # a row for each column
        return rows.select("ord", "column", "n", "missing_pct", "mean", "median", "min", "max", "q1", "q3", "std").withColumn("cv", profile.variation(F.col("std"), F.col("mean")))

    def _quantiles(self, counts: DataFrame, by: list[str], wanted) -> DataFrame:
        return quantiles.of_counts(counts.withColumn("place", F.lit(2)), by, wanted)

    def correlations(self) -> DataFrame:
        """As `relations.correlations`, from means and products of the parts."""
        every = self._pairs[0]
        for p in self._pairs[1:]:
            every = every.unionByName(p)
        n = F.sum("n").alias("n")
        mean = [(F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(f"of_{m}") for m in ("mean1", "mean2")]
        whole = every.groupBy("col1", "col2").agg(n, *mean)
        each = every.join(whole.drop("n"), ["col1", "col2"])
        d1, d2 = F.col("mean1") - F.col("of_mean1"), F.col("mean2") - F.col("of_mean2")
        m = lambda c, a, b: F.sum(F.col(c) + F.col("n") * a * b).alias(c)
        found = each.groupBy("col1", "col2").agg(m("m11", d1, d1), m("m22", d2, d2), m("m12", d1, d2))
        r = F.when((F.col("m11") > 0) & (F.col("m22") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("m12") / F.sqrt("m11") / F.sqrt("m22")))).otherwise(0.0)
        numeric = self.typed.numeric
        pairs = [(self.typed.ord(a), self.typed.ord(b), a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
        frame = self.spark.createDataFrame(pairs, "ord1 int, ord2 int, col1 string, col2 string")
        turned = found.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), r.alias("r"))  # parts may have columns in another order
        both = found.select("col1", "col2", r.alias("r")).union(turned)
        return frame.join(both, ["col1", "col2"], "left").select("ord1", "ord2", "col1", "col2", F.coalesce("r", F.lit(0.0)).alias("correlation"))

    def group_summary(self, categories: list[str]) -> DataFrame:
        """As `relations.group_summary`."""
        if not categories or not self.typed.numeric:
            return relations.group_summary(self.typed, [])
        mine = self._groups.where(F.col("cat_col").isin(categories) & F.col("num_col").isin(self.typed.numeric))
        key, n, v = ["cat_col", "category", "num_col"], F.col("n"), F.col("value")
        stats = mine.groupBy(*key).agg((F.sum(n * v) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(n).alias("count"))
        medians = self._quantiles(mine.withColumn("col", F.lit(0)), key, quantiles.MEDIAN).select(*key, quantiles.middle().alias("median"))
        return stats.join(medians, key).select("cat_col", "num_col", F.substring("category", 1, relations.CATEGORY_CHARS).alias("category"), "mean", "median", "min", "max", "count")

    def histogram(self, numeric: list[dict], bins: int = 15) -> DataFrame:
        """As `profile.histogram`; numeric: rows of the numeric profile."""
        frame, ends = [], []
        for r in numeric:
            mine, low, step, unit = profile.bins_of(r["min"], r["max"], bins)
            frame += [(r["column"], *m) for m in mine]
            ends.append((r["column"], low, step, unit, len(mine) - 1))
        every = self.spark.createDataFrame(frame, "column string, bin int, range string, range_start double")
        ends_ = self.spark.createDataFrame(ends, "column string, low double, step double, unit double, last int")
        bin_ = F.least(F.floor((F.col("value") * F.col("unit") - F.col("low")) / F.col("step")), F.col("last")).cast("int")
        counted = self.numbers.join(F.broadcast(ends_), "column").groupBy("column", bin_.alias("bin")).agg(F.sum("n").alias("count"))
        return every.join(counted, ["column", "bin"], "left").select("column", "bin", "range", "range_start", F.coalesce("count", F.lit(0)).alias("count"))


def analyze_states(spark: SparkSession, paths: list[str], name: str = "dataset", top: int = 50) -> Profile:
    """The analysis of all rows of which the states at these paths are; none of the rows is read."""
    m = Merged(spark, paths)
    if not m.typed.rows:
        raise ValueError("no data found")
    numeric = small(m.numeric_profile().orderBy("ord"))
    categorical = small(profile.categorical_profile(m.typed, m.counts).orderBy("ord"))
    frequencies = small(profile.frequencies(m.counts, max(top, relations.LOW_CARDINALITY)).orderBy("ord", "rank"))
    pairs = small(m.correlations().orderBy("ord1", "ord2"))
    low = [r["column"] for r in categorical.collect() if r["unique"] < relations.LOW_CARDINALITY]
    groups = small(m.group_summary(low))
    found = small(insights.insights(numeric, frequencies, pairs, m.typed.rows, len(m.typed.df.columns), len(m.typed.numeric), len(low)).orderBy("seq"))
    histogram = m.histogram([r.asDict() for r in numeric.collect()])
    return analysis_of(name, m.typed, numeric, categorical, frequencies, pairs, groups, found, histogram, profile.frequencies(m.counts))
