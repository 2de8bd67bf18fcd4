"""The whole analysis of a data set: a few jobs over the data, then frames as small as its columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillon.operators import columns, insights, profile, relations, reports
from quillon.sources.files import not_empty
from quillon.sources.scratch import table


@dataclass
class Profile:
    """Collected results, as lists of dictionaries in report order. Frequencies are whole for columns of few categories; of others the first ones
    are collected, and `every_frequency` has them all.

    reports: "decision" (critical, drivers, unstable), "quality" (overview, missing, inconsistent, key_like), "segmentation"
    (price_driver, premium, core) and "predictive" (risk_adjusted, leveraged, best_worst), each a list of rows; and "target", the column the last is about.
    """

    name: str
    rows: int
    columns: list[str]
    numeric: list[dict]
    categorical: list[dict]
    frequencies: dict[str, list[dict]]
    correlations: list[dict]
    groups: list[dict]
    insights: list[dict]
    unsupported: list[str] = field(default_factory=list)
    histograms: dict[str, list[dict]] = field(default_factory=dict)
    reports: dict = field(default_factory=dict)
    every_frequency: DataFrame | None = None

    @property
    def numeric_names(self) -> list[str]:
        return [r["column"] for r in self.numeric]

    @property
    def categorical_names(self) -> list[str]:
        return [r["column"] for r in self.categorical]


def small(df: DataFrame) -> DataFrame:
    """A frame of few rows as one made of its collected rows, so that its job runs once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _by_column(rows: list[dict], names: list[str]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {c: [] for c in names}
    for r in rows:
        out[r["column"]].append(r)
    return out


def make_reports(typed: columns.Typed, numeric: DataFrame, categorical: DataFrame, pairs: DataFrame, groups: DataFrame, found: DataFrame) -> dict:
    """The four reports, from frames that are already small."""
    spark = typed.df.sparkSession
    present = spark.createDataFrame(list(typed.present.items()), "column string, present bigint")
    shares = numeric.select("ord", "column", "missing_pct").union(categorical.select("ord", "column", "missing_pct"))
    driver = _dicts(reports.price_driver(pairs))
    prices = [c for c in typed.numeric if c.lower() == "price"] + [r["col1"] for r in driver]
    target = reports.choose_target(typed.numeric)
    predictive = {"risk_adjusted": [], "leveraged": [], "best_worst": []}
    if target is not None:
        predictive = {"risk_adjusted": _dicts(reports.risk_adjusted(numeric, pairs, target)), "leveraged": _dicts(reports.leveraged_gain(groups, numeric, target)), "best_worst": _dicts(reports.best_and_worst(groups, target))}
    return {
        "decision": {"critical": _dicts(reports.critical_insights(found)), "drivers": _dicts(reports.drivers(pairs)), "unstable": _dicts(reports.unstable_columns(numeric))},
        "quality": {"overview": _dicts(reports.quality_overview(numeric, categorical, typed.rows)), "missing": _dicts(reports.missing_summary(shares, typed.rows, present)), "inconsistent": _dicts(reports.unstable_columns(numeric, 75)), "key_like": _dicts(reports.key_like_columns(categorical, typed.rows))},
        "segmentation": {"price_driver": driver, "premium": _dicts(reports.premium_segment(groups, prices)) if prices else [], "core": _dicts(reports.core_segment(categorical))},
        "predictive": predictive,
        "target": target,
    }


def analyze(df: DataFrame, name: str = "dataset", dynamic: bool = False, top: int = 50) -> Profile:
    """Profiles every supported column of df. dynamic: see `columns.classify`; top: categories to collect of columns of many."""
    not_empty(df)
    typed = columns.classify(df, dynamic)
    numeric = small(profile.numeric_profile(typed).orderBy("ord"))
    counts = table(profile.value_counts(typed), "value_counts")
    categorical = small(profile.categorical_profile(typed, counts).orderBy("ord"))
    frequencies = small(profile.frequencies(counts, max(top, relations.LOW_CARDINALITY)).orderBy("ord", "rank"))
    pairs = small(relations.correlations(typed).orderBy("ord1", "ord2"))
    low = [r["column"] for r in categorical.collect() if r["unique"] < relations.LOW_CARDINALITY]
    groups = small(relations.group_summary(typed, low))
    found = small(insights.insights(numeric, frequencies, pairs, typed.rows, len(typed.df.columns), len(typed.numeric), len(low)).orderBy("seq"))
    return analysis_of(name, typed, numeric, categorical, frequencies, pairs, groups, found, profile.histogram(typed, ends={r["column"]: (r["min"], r["max"]) for r in numeric.collect()}), profile.frequencies(counts))


def analysis_of(name: str, typed: columns.Typed, numeric: DataFrame, categorical: DataFrame, frequencies: DataFrame, pairs: DataFrame, groups: DataFrame, found: DataFrame, histogram: DataFrame, every: DataFrame) -> Profile:
    """The analysis from its parts, which but for `every`, all frequencies, are small."""
    return Profile(
        name,
        typed.rows,
        list(typed.df.columns),
        _dicts(numeric),
        _dicts(categorical),
        _by_column(_dicts(frequencies), typed.categorical),
        _dicts(pairs),
        sorted(_dicts(groups), key=lambda r: (typed.ord(r["cat_col"]), typed.ord(r["num_col"]), -r["mean"], r["category"])),
        _dicts(found),
        typed.unsupported,
        _by_column(_dicts(histogram.orderBy("column", "bin")), typed.numeric),
        make_reports(typed, numeric, categorical, pairs, groups, found),
        every,
    )
