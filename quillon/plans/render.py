"""Profiles as Markdown, and analyses of a data set as a notebook or script that runs on Spark."""

from __future__ import annotations

import json
from datetime import date

from quillon.functions.numbers import fixed
from quillon.plans.analysis import Profile


def percent(value: float, places: int = 1) -> str:
    return f"{fixed(value, places)}%"


def markdown(p: Profile, on: date | None = None) -> str:
    """Header, findings, statistics of each column in file order, and pairs with |r| above 0.5."""
    lines = [f"# Analysis of {p.name}", "", f"**Date:** {(on or date.today()).isoformat()}", f"**Records:** {p.rows}", f"**Features:** {len(p.columns)}", "", "## Findings", ""]
    lines += [f"- **[{i['agent']}]** {i['text'].replace('**', '')}" for i in p.insights]
    lines += ["", "## Statistics", ""]
    for r in sorted([*p.numeric, *p.categorical], key=lambda r: r["ord"]):
        if "mean" in r:
            lines += [f"### {r['column']} (numeric)", *(f"- **{name}:** {fixed(r[k], 2)}" for name, k in (("Mean", "mean"), ("Median", "median"), ("Std Dev", "std"), ("CV (%)", "cv"))), f"- **Range:** {fixed(r['min'], 2)} - {fixed(r['max'], 2)}"]
        else:
            top = ", ".join(f"{t['name']} ({percent(t['percentage'])})" for t in p.frequencies[r["column"]][:3])
            lines += [f"### {r['column']} (categorical)", f"- **Unique Values:** {r['unique']}", f"- **Mode:** {r['mode']}", f"- **Top Categories:** {top}"]
        lines += [f"- **Missing:** {percent(r['missing_pct'])}", ""]
    lines += ["## Correlations above 0.5", ""]
    lines += [f"- **{r['col1']}** and **{r['col2']}**: {fixed(r['correlation'], 3)}" for r in p.correlations if abs(r["correlation"]) > 0.5]
    return "\n".join(lines) + "\n"


def reports_markdown(p: Profile) -> str:
    """The four reports: what needs a decision, how good the data is, which segments stand out, and what predicts the target."""
    decision, quality, segments, predictive = (p.reports[k] for k in ("decision", "quality", "segmentation", "predictive"))

    def section(title: str, items: list[str], none: str) -> list[str]:
        return ["", f"### {title}", "", *([f"- {i}" for i in items] or [none])]

    over = quality["overview"][0]
    lines = [f"# Reports on {p.name}", "", "## Decisions"]
    lines += section("Warnings", [i["text"].replace("**", "") for i in decision["critical"]], "None.")
    lines += section("Drivers", [f"{r['col1']} and {r['col2']}: r = {fixed(r['correlation'], 2)}" for r in decision["drivers"]], "No |r| reaches 0.7.")
    lines += section("Unstable columns", [f"{r['column']}: {r['reason']}" + (f", CV {percent(r['cv'], 2)}" if r["cv"] is not None else "") for r in decision["unstable"]], "No CV is above 50 %.")
    lines += ["", "## Data quality", "", f"{over['records']} records, {over['numeric_columns']} numeric and {over['categorical_columns']} categorical columns: {over['status']}"]
    lines += section("Missing cells", [f"{r['column']}: {percent(r['missing_pct'])} ({r['affected_records']} records)" for r in quality["missing"]], "None.")
    lines += section("Inconsistent columns", [f"{r['column']}: {r['reason']}" for r in quality["inconsistent"]], "No CV is above 75 %.")
    lines += section("Columns like keys", [f"{r['column']}: {r['unique']} values" for r in quality["key_like"]], "None.")
    lines += ["", "## Segments"]
    lines += section("Price driver", [f"{r['col1']}: r = {fixed(r['shown_r'], 2)}" for r in segments["price_driver"]], "No column names a price.")
    lines += section("Premium segment", [f"{r['cat_col']} = {r['category']}: mean {r['num_col']} {fixed(r['mean'], 0)}" for r in segments["premium"]], "None.")
    lines += section("Core segment", [f"{r['column']} = {r['mode']}" for r in segments["core"]], "None.")
    lines += ["", f"## Predicting {p.reports['target']}" if p.reports["target"] else "## Prediction needs two numeric columns"]
    lines += section("Predictors by risk", [f"{r['column']}: score {fixed(r['score'], 3)} (|r| {fixed(r['correlation'], 2)}, CV {percent(r['cv'], 2)})" for r in predictive["risk_adjusted"]], "None.")
    lines += section("Leveraged groups", [f"{r['cat_col']} = {r['category']}: mean above median by {fixed(r['gain'], 0)}" for r in predictive["leveraged"]], "None.")
    lines += section("Best and worst group", [f"{r['role']}: {r['cat_col']} = {r['category']} ({fixed(r['mean'], 2)})" for r in predictive["best_worst"]], "None.")
    return "\n".join(lines) + "\n"


def script(name: str, target: str | None = None) -> str:
    """PySpark code with the steps of an exploratory analysis."""
    return f'''from pyspark.sql import SparkSession

from quillon.operators import classic, columns, profile, relations
from quillon.sources.files import read_csv

spark = SparkSession.builder.getOrCreate()
df = read_csv(spark, {name!r})
print("shape:", classic.shape(df))

# columns and nulls
df.printSchema()
classic.null_counts(df).show()

# numbers
typed = columns.classify(df, dynamic=True)
classic.describe(typed).show()
classic.boxplot(typed).show()
profile.histogram(typed, bins=30).show()

# correlations
pairs = relations.correlations(typed)
classic.highest_correlations(pairs).show()
relations.correlation_matrix(typed, pairs).show()

# categories
shares = profile.frequencies(profile.value_counts(typed), top=50)
classic.value_shares(shares).show()
target = {target!r} or (typed.numeric[0] if typed.numeric else None)
if target and typed.categorical:
    classic.group_aggregate(typed, target).show()
'''


def notebook(p: Profile, on: date | None = None) -> str:
    """The script as a notebook of one text and one code cell (nbformat 4)."""
    head = [f"# Analysis of {p.name}\n\n", f"**Generated on:** {(on or date.today()).isoformat()}\n", f"**Records:** {p.rows}\n", f"**Features:** {len(p.columns)}"]
    cells = [
        {"cell_type": "markdown", "metadata": {}, "source": head},
        {"cell_type": "code", "execution_count": None, "metadata": {}, "outputs": [], "source": script(p.name).splitlines(keepends=True)},
    ]
    kernel = {"kernelspec": {"display_name": "Python 3", "language": "python", "name": "python3"}, "language_info": {"name": "python"}}
    return json.dumps({"cells": cells, "metadata": kernel, "nbformat": 4, "nbformat_minor": 5})
