"""Small fixtures whose results follow from the definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.numbers import fixed, plain
from quillon.operators import classic, columns, insights, profile, quantiles, relations, reports
from quillon.plans import analysis, render
from quillon.plans.ask import ask, intent
from quillon.sources import files
from quillon.sources.catalog import Catalog


def numbers(spark, values, name="v"):
    return columns.classify(spark.createDataFrame([(float(v),) for v in values], f"{name} double"))


def stats(spark, values):
    return profile.numeric_profile(numbers(spark, values)).first().asDict()


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "mixed.csv"
    path.write_text("id,price,gender,note\n1,10,F,a\n2,20,M,5\n3,30,F,\n4,40,M,b\n")
    return files.read_csv(spark, str(path))


def test_mixed_column(mixed):
    p = analysis.analyze(mixed, "mixed.csv", dynamic=True)
    by = {r["column"]: r for r in p.numeric}
    assert set(by) == {"id", "price", "note"}
    price = by["price"]
    assert (price["mean"], price["median"], price["q1"], price["q3"]) == (25, 25, 20, 40)
    assert (fixed(price["std"], 2), fixed(price["cv"], 2)) == ("11.18", "44.72")
    assert (by["note"]["n"], by["note"]["mean"], by["note"]["missing_pct"]) == (1, 5, 25.0)
    gender = p.categorical[0]
    assert (gender["unique"], gender["mode"]) == (2, "F")
    assert [g["category"] for g in p.groups if g["num_col"] == "price"] == ["M", "F"]
    r = {(c["col1"], c["col2"]): c["correlation"] for c in p.correlations}
    assert r["id", "price"] == pytest.approx(1) and r["price", "note"] == 0
    assert [i["rule"] for i in p.insights] == ["strong_pair"]


def test_quartile_rule(spark):
    s = stats(spark, [1, 2, 3, 4])
    assert (s["q1"], s["q3"], s["median"]) == (2, 4, 2.5)
    assert s["std"] == pytest.approx(math.sqrt(1.25))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 12, 13, 40])
def test_floor_quartiles(spark, n):
    values = [float(v) for v in random.Random(n).sample(range(1000), n)]
    s, order = stats(spark, values), sorted(values)
    assert (s["q1"], s["q3"]) == (order[int(n * 0.25)], order[int(n * 0.75)])
    assert s["min"] <= s["q1"] <= s["median"] <= s["q3"] <= s["max"]


def test_zero_mean(spark):
    typed = numbers(spark, [-1, 1, -2, 2])
    numeric = profile.numeric_profile(typed)
    assert numeric.first()["cv"] is None
    assert reports.unstable_columns(numeric).first()["reason"] == "zero mean"


def test_all_null(spark):
    typed = columns.classify(spark.createDataFrame([(None,)] * 3, "v double"))
    counts = profile.value_counts(typed)
    row = profile.categorical_profile(typed, counts).first()
    assert (row["unique"], row["mode"], row["missing_pct"]) == (0, "N/A", 100.0)
    assert counts.count() == 0 and relations.low_cardinality(profile.categorical_profile(typed, counts)).count() == 1


def test_constant(spark):
    typed = columns.classify(spark.createDataFrame([(1.0, float(i)) for i in range(4)], "v double, w double"))
    assert [(r["range"], r["count"]) for r in profile.histogram(typed, names=["v"]).collect()] == [("1", 4)]
    assert relations.correlations(typed).first()["correlation"] == 0
    assert insights.outlying(profile.numeric_profile(typed).where("column = 'v'")).count() == 0


@pytest.mark.parametrize(("zeros", "fires"), [(19, True), (18, False)])
def test_skew_needs_rows(spark, zeros, fires):
    numeric = profile.numeric_profile(numbers(spark, [0.0] * zeros + [1.0] * 12))
    assert (insights.skewed(numeric).count() == 1) is fires


def test_outlier(spark):
    assert insights.outlying(profile.numeric_profile(numbers(spark, [1.0] * 10 + [100.0]))).count() == 1


def test_histogram_edges(spark):
    rows = profile.histogram(numbers(spark, [float(v) for v in range(16)])).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1] * 14 + [2]
    assert rows[0]["range"] == "0-1" and rows[-1]["range"] == "14-15"


@pytest.mark.parametrize(("values", "fires"), [("xxxy", True), ("xxxxxxxyyy", False), ("xxxx", False)])
def test_dominance(spark, values, fires):
    typed = columns.classify(spark.createDataFrame([(v,) for v in values], "v string"))
    assert (insights.dominated(profile.frequencies(profile.value_counts(typed))).count() == 1) is fires


def test_labels_are_cut_after_grouping(spark):
    long_ = ["x" * 20 + "a", "x" * 20 + "b"]
    typed = columns.classify(spark.createDataFrame([(v, 1.0) for v in long_], "k string, v double"))
    assert [r["name"] for r in profile.frequencies(profile.value_counts(typed)).collect()] == ["x" * 20] * 2
    assert [r["category"] for r in relations.group_summary(typed, ["k"]).collect()] == ["x" * 15] * 2


def test_printed_missing_share(spark):
    typed = columns.classify(spark.createDataFrame([(None if i == 0 else float(i),) for i in range(5000)], "v double"))
    numeric = profile.numeric_profile(typed)
    present = spark.createDataFrame(list(typed.present.items()), "column string, present bigint")
    assert reports.missing_summary(numeric, typed.rows, present).count() == 0


def test_leveraged_best_worst(spark):
    rows = [("A", v) for v in (10.0, 10.0, 100.0)] + [("B", 20.0)] * 3 + [("C", -5.0)] * 3
    typed = columns.classify(spark.createDataFrame(rows, "k string, v double"))
    groups, numeric = relations.group_summary(typed, ["k"]), profile.numeric_profile(typed)
    assert [r["category"] for r in reports.leveraged_gain(groups, numeric, "v").collect()] == ["A"]
    assert {r["role"]: r["category"] for r in reports.best_and_worst(groups, "v").collect()} == {"best": "A", "worst": "B"}


def test_empty_files(spark, tmp_path):
    for name, text in (("header.csv", "a,b\n"), ("empty.csv", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="no data"):
            files.read_csv(spark, str(tmp_path / name))


def test_number_syntax(spark):
    bad = columns.classify(spark.createDataFrame([(v,) for v in ("1d", "12f", "NaN", "Infinity", "+5", "9007199254740993")], "v string"), dynamic=True)
    assert bad.categorical == ["v"]
    good = columns.classify(spark.createDataFrame([(v,) for v in (" 12 ", ".5", "5.", "1e5", "-3")], "v string"), dynamic=True)
    assert good.numbers["v"] == 5


def test_ragged_and_quoted(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1\n2,3,4\n\n"x\ny",5\n')
    rows = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "r.csv")).collect()]
    assert rows == [("1", None), ("2", "3"), ("x\ny", "5")]


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    assert sorted(r["row"] for r in files.malformed_rows(spark, str(tmp_path / "m.csv")).collect()) == ["3", "4,5,6"]


def test_prefix_targets(spark):
    groups = spark.createDataFrame([("k", "Price", "a", 1.0), ("k", "PriceOld", "a", 2.0)], "cat_col string, num_col string, category string, mean double")
    assert (reports.of_target(groups, "Price").count(), reports.of_target(groups, "Price", prefix=True).count()) == (1, 2)
    assert reports.choose_target(["a", "Salary", "UnitPrice"]) == "UnitPrice" and reports.choose_target(["a"]) is None


def test_nan_is_present_but_no_number(spark):
    typed = columns.classify(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double"))
    row = profile.numeric_profile(typed).first()
    assert (row["n"], row["max"], fixed(row["missing_pct"], 1)) == (1, 1.0, "33.3")


def test_questions(mixed):
    assert [intent(q) for q in ("summarize", "average of price", "range of price", "mode of gender", "what are the top categories in gender")] == ["summary", "average", "distribution", "category", "columns"]
    p = analysis.analyze(mixed, "mixed.csv", dynamic=True)
    assert "25.00" in ask(p, "average of price") and "30.00" in ask(p, "range of price") and ask(p, "  ") is None
    assert "**F**" in ask(p, "mode of gender") and "id and price" in ask(p, "summary") and "Name a" in ask(p, "max of nothing")
    for q in ("columns?", "correlation", "insights", "hello", "highest price"):
        assert ask(p, q)


def test_renderers(mixed):
    import json

    p = analysis.analyze(mixed, "mixed.csv", dynamic=True)
    text = render.markdown(p)
    assert "### price (numeric)" in text and "- **Mode:** F" in text and "**id** and **price**: 1.000" in text
    book = json.loads(render.notebook(p))
    assert book["nbformat"] == 4 and len(book["cells"]) == 2
    compile("".join(book["cells"][1]["source"]), "notebook", "exec")


def test_catalog(spark, mixed, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    assert catalog.list().count() == 0
    id_ = catalog.save(mixed, "mixed.csv")
    entry = catalog.list().first()
    assert (entry["name"], entry["row_count"], entry["columns"]) == ("mixed.csv", 4, mixed.columns)
    assert catalog.load(id_).count() == 4
    catalog.delete(id_)
    assert catalog.list().count() == 0
    with pytest.raises(KeyError):
        catalog.load(id_)


def test_damaged_versions_are_passed_over(spark, tmp_path, monkeypatch):
    from quillon.sources import catalog as module

    catalog = Catalog(spark, f"file://{tmp_path}/log")
    a, b = (catalog.save(spark.range(n), f"{n}.csv") for n in (1, 2))
    assert catalog.damaged() == []
    (tmp_path / "log/log/00000000000000000001.json").write_text("PAR1 nonsense")
    (tmp_path / "log/log/.00000000000000000001.json.crc").unlink(missing_ok=True)
    assert catalog.damaged() == ["00000000000000000001.json"] and [r["id"] for r in catalog.list().collect()] == [b]
    monkeypatch.setattr(module, "COMPACT", 4)
    c = catalog.save(spark.range(3), "3.csv")
    catalog.delete(b)  # writes a summary
    d = catalog.save(spark.range(4), "4.csv")
    assert (tmp_path / "log/log/00000000000000000004.summary").exists() and d > c > b > a
    assert sorted(r["id"] for r in catalog.list().collect()) == [c, d] and catalog.load(d).count() == 4
    (tmp_path / "log/log/00000000000000000004.summary").write_text("{")
    (tmp_path / "log/log/.00000000000000000004.summary.crc").unlink(missing_ok=True)
    assert sorted(r["id"] for r in catalog.list().collect()) == [c, d]  # from the versions themselves
    for f in (tmp_path / "log/log").iterdir():
        if f.suffix != ".crc":
            f.write_text("{}")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert catalog.list().count() == 0 and len(catalog.damaged()) == 6
    assert catalog.load(catalog.save(spark.range(5), "5.csv")).count() == 5


def test_savers_at_the_same_time(spark, tmp_path, monkeypatch):
    """A saver that another one overtakes takes the next version, and an id of its own."""
    catalog, other = (Catalog(spark, f"file://{tmp_path}/race") for _ in range(2))
    monkeypatch.setattr("time.time", lambda: 1_800_000_000.0)
    create, ids = catalog._create, []

    def overtaken(name, said):
        if not ids:
            ids.append(other.save(spark.range(1), "first.csv"))
        return create(name, said)

    monkeypatch.setattr(catalog, "_create", overtaken)
    ids.append(catalog.save(spark.range(2), "second.csv"))
    assert ids == [1_800_000_000_000, 1_800_000_000_001] and catalog.load(ids[1]).count() == 2 and catalog.list().count() == 2


def test_catalog_ids_are_unique(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillon.sources.catalog.time.time", lambda: 1_700_000_000.0)
    catalog = Catalog(spark, f"file://{tmp_path}/same")
    assert len({catalog.save(spark.range(1), "a.csv") for _ in range(3)}) == 3 == catalog.list().count()


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "x,y"), ("line\nfeed", None)], "p string, q string")
    files.write_csv(df, f"file://{tmp_path}/out")
    assert sorted(map(tuple, files.read_csv(spark, f"file://{tmp_path}/out").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.export_name("Data.CSV") == "Data_export.csv"


def at_ranks(values, share, kind):
    """The values at the lower and upper rank, by the definition."""
    order, n = sorted(values), len(values)
    low, high = {"floor": (int(n * share),) * 2, "middle": ((n - 1) // 2, n // 2), "linear": (math.floor((n - 1) * share), math.ceil((n - 1) * share))}[kind]
    return order[low], order[high]


WANTED = ((0.25, "floor"), (0.5, "middle"), (0.75, "linear"), (0.25, "linear"))


def test_export_of_one_file(spark, tmp_path):
    df = spark.createDataFrame([('a"b', "x,y"), ("line\nfeed", None)] * 20, "p string, `q,r` string").repartition(5)
    for rows in (df.where("p is null"), df, df):  # the last replaces the one before
        path = files.export_csv(rows, f"file://{tmp_path}/out", "Data.CSV")
    assert path.endswith("/out/Data_export.csv") and [f.name for f in (tmp_path / "out").iterdir() if f.suffix == ".csv"] == ["Data_export.csv"]
    got = files.read_csv(spark, path)
    assert got.columns == ["p", "q,r"] and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize(("few", "large", "margin", "broadcast"), [(50, 10**6, quantiles.MARGIN, 9), (50, 10, quantiles.MARGIN, 0), (10, 10**6, 0.0, 9), (10**6, 10, 0.1, 9)])
def test_ranks_of_columns_and_groups(spark, monkeypatch, few, large, margin, broadcast):
    """Ties at ranks, nulls, a null group, groups of one; brackets that miss (margin 0), counts sorted in ranges (large 10), brackets joined by a shuffle."""
    for name, v in (("FEW", few), ("LARGE", large), ("MARGIN", margin), ("BROADCAST", broadcast)):
        monkeypatch.setattr(quantiles, name, v)
    rng = random.Random(3)
    rows = [(rng.choice(("a", "a", "b", None)), rng.choice((rng.expovariate(1), 7.0)), float(i % 2), None if i % 3 else float(rng.randrange(50))) for i in range(5_000)]
    rows += [("one", 1.5, -0.0, None), ("two", None, 2.0, 3.0), ("two", None, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(4)
    cells = {0: "x", 5: "y", 2: "z"}
    for by in ([], ["k"]):
        got = {(*(r[b] for b in by), r["col"]): r for r in quantiles.selected(df, by, cells, WANTED).collect()}
        groups = {(*(r[:1] if by else ()), i): [] for r in rows for i in cells}
        for r in rows:
            for i, v in zip(cells, r[1:], strict=True):
                if v is not None:
                    groups[(*(r[:1] if by else ()), i)].append(v)
        groups = {k: v for k, v in groups.items() if v}
        assert set(got) == set(groups)
        for k, values in groups.items():
            assert got[k]["n"] == len(values)
            assert list(zip(got[k]["low"], got[k]["high"], strict=True)) == [at_ranks(values, *w) for w in WANTED], k


def test_long_columns_take_ranks(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice("ab"), rng.random()) for _ in range(3000)], "k string, v double")
    typed = columns.classify(df)
    direct, groups = profile.numeric_profile(typed).collect(), sorted(relations.group_summary(typed, ["k"]).collect())
    others = [sorted(f().collect()) for f in (lambda: classic.describe(typed), lambda: classic.boxplot(typed), lambda: classic.group_aggregate(typed, "v"))]
    monkeypatch.setattr(quantiles, "DIRECT", 100)
    for f, before in zip((lambda: classic.describe(typed), lambda: classic.boxplot(typed), lambda: classic.group_aggregate(typed, "v")), others):
        for got, expected in zip(sorted(f().collect()), before):
            assert got[0] == expected[0] and got[1:] == pytest.approx(expected[1:])
    assert profile.numeric_profile(typed).collect() == direct
    assert sorted(relations.group_summary(typed, ["k"]).select(*groups[0].__fields__).collect()) == groups


def test_profile_of_long_even_flags(spark, monkeypatch):
    typed = columns.classify(spark.createDataFrame([("ab"[i // 2 % 2], float(i % 2)) for i in range(4000)], "k string, v double"))
    direct, groups = profile.numeric_profile(typed).collect(), sorted(relations.group_summary(typed, ["k"]).collect())
    monkeypatch.setattr(quantiles, "DIRECT", 100)
    monkeypatch.setattr(quantiles, "FEW", 50)
    assert profile.numeric_profile(typed).collect() == direct
    assert sorted(relations.group_summary(typed, ["k"]).select(*groups[0].__fields__).collect()) == groups


def test_groups_of_any_size(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(rng.choice("aaaaaaaab") if i % 40 else f"rare{i}", rng.random()) for i in range(2000)] + [("none", None), (None, 1.0)]
    typed = columns.classify(spark.createDataFrame(rows, "k string, v double"))
    direct = sorted(classic.group_aggregate(typed, "v").collect())
    monkeypatch.setattr(quantiles, "DIRECT", 300)
    assert sorted(classic.group_aggregate(typed, "v").collect()) == direct


def test_ranks_of_very_many_categories(spark, monkeypatch):
    rng = random.Random(16)
    rows = [(f"name{rng.randrange(400):03}", rng.choice("xyz")) for _ in range(1500)]
    typed = columns.classify(spark.createDataFrame(rows, "a string, b string").repartition(5))
    counts = profile.value_counts(typed)
    direct = sorted(profile.frequencies(counts).collect())
    monkeypatch.setattr(quantiles, "DIRECT", 10)
    assert sorted(profile.frequencies(counts).collect()) == direct
    assert [r["rank"] for r in direct if r["column"] == "a"] == list(range(1, len({a for a, _ in rows}) + 1))


def test_infinities_are_no_numbers(spark):
    inf = float("inf")
    typed = columns.classify(spark.createDataFrame([(1.0, 2.0), (inf, 3.0), (3.0, -inf), (2.0, 1.0)], "x double, y double"))
    s = {r["column"]: r for r in profile.numeric_profile(typed).collect()}
    assert (s["x"]["n"], s["x"]["max"], s["y"]["min"]) == (3, 3.0, 1.0)
    assert profile.histogram(typed).agg(F.sum("count")).first()[0] == 6
    assert relations.correlations(typed).first()["correlation"] == pytest.approx(-1)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], ["a`b.c", "k (`)"])
    p = analysis.analyze(df)
    assert (p.numeric_names, p.categorical_names) == (["a`b.c"], ["k (`)"])
    assert {r["column"]: r["nulls"] for r in classic.null_counts(df).collect()} == {"a`b.c": 0, "k (`)": 0}


def test_heat_of_printed_values(spark):
    r = spark.createDataFrame([(1.0,), (0.996,), (0.004,), (-0.004,), (-0.5,), (0.12,)], "correlation double")
    got = [(x["intensity"], x["hue"]) for x in r.select(*relations.heat()).collect()]
    assert got == [(90, "full"), (90, "full"), (0, "neutral"), (0, "neutral"), (50, "negative"), (10, "positive")]


def test_reports(spark):
    rows = [(float(i), 1000.0 - 3 * i, float(i % 7), "ab"[i % 4 == 0], f"id{i}") for i in range(1, 101)] + [(None, 5.0, 6.0, "a", "id0")]
    p = analysis.analyze(spark.createDataFrame(rows, "age double, price double, other double, kind string, code string"))
    assert p.reports["target"] == "price" and [r["column"] for r in p.reports["predictive"]["risk_adjusted"]][0] == "age"
    assert [(r["col1"], r["col2"]) for r in p.reports["decision"]["drivers"]] == [("age", "price")]
    assert [r["column"] for r in p.reports["quality"]["missing"]] == ["age"] and [r["column"] for r in p.reports["quality"]["key_like"]] == ["code"]
    assert p.reports["segmentation"]["price_driver"][0]["col1"] == "age" and p.reports["segmentation"]["core"][0]["column"] == "code"
    assert {r["role"] for r in p.reports["predictive"]["best_worst"]} == {"best", "worst"}
    assert [sum(b["count"] for b in p.histograms[c]) for c in ("age", "price", "other")] == [100, 101, 101] and len(p.histograms["age"]) == 15
    assert len(p.frequencies["code"]) == 50 and p.every_frequency.where("column = 'code'").count() == 101
    text = render.reports_markdown(p)
    assert "## Predicting price" in text and "age and price: r = -" in text and "101 records" in text
    one = analysis.analyze(spark.createDataFrame([("x",), ("y",)], "k string"))
    assert one.reports["target"] is None and "two numeric columns" in render.reports_markdown(one)


def test_scratch_folder(spark):
    from quillon.sources import scratch

    written = scratch.table(spark.range(3), "three")
    path = written.inputFiles()[0]
    assert written.count() == 3 and scratch.shared_root(spark) in path
    class Cluster:  # a session without a shared folder whose executors are elsewhere
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch.shared_root(Cluster)


def test_temporary_tables_go(spark):
    from pathlib import Path

    from quillon.sources import scratch

    kept = scratch.table(spark.range(3), "kept")
    with scratch.temporary(spark):
        gone = Path(scratch.table(kept, "gone").inputFiles()[0].removeprefix("file://"))
        assert gone.exists()
    assert not gone.exists() and kept.count() == 3 and scratch.table(kept, "later").count() == 3


def test_partitions_dont_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_type", "p_size", "p_retailprice")
    a, b = (columns.classify(d) for d in (df.coalesce(1), df.repartition(7)))
    for f in (profile.value_counts, profile.histogram):
        assert sorted(f(a).collect()) == sorted(f(b).collect())
    sizes = profile.histogram(a).groupBy("column").agg(F.sum("count").alias("n")).collect()
    assert {r["n"] for r in sizes} == {200}


@pytest.mark.parametrize(("tile", "fan_in"), [(100, 16), (7, 2)])
def test_wide_correlations(spark, monkeypatch, tile, fan_in):
    """Pairwise missing cells, constants, columns that are constant or absent where the other one is there, large and tiny values."""
    import numpy as np

    from quillon.operators import gram

    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "FAN_IN", fan_in)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 4))
    cells = base @ rng.normal(size=(4, 30)) + rng.normal(size=(400, 30))
    cells[:, 3], cells[:, 4] = 0.1, 5.0
    cells[:, 5] = cells[:, 6] * 1e200
    cells[:, 7] = 1e9 + cells[:, 8] * 1e-3
    cells[rng.random(cells.shape) < 0.2] = np.nan
    cells[:200, 9], cells[200:, 10], cells[200:, 9] = 0.3, np.nan, rng.normal(size=200)  # 9 is constant where 10 is there
    cells[::2, 11], cells[1::2, 12] = np.nan, np.nan  # never both
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in cells], ", ".join(f"c{i} double" for i in range(30))).repartition(5)
    typed = columns.classify(df)
    plan = gram.correlations(typed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    got = {(r["col1"], r["col2"]): r["correlation"] for r in relations.correlations(typed).collect()}
    assert len(got) == 435
    for (a, b), r in got.items():
        x, y = cells[:, int(a[1:])], cells[:, int(b[1:])]
        both = ~np.isnan(x) & ~np.isnan(y)
        x, y = x[both] / (1e200 if a == "c5" else 1), y[both] / (1e200 if b == "c5" else 1)
        expected = 0.0 if len(x) == 0 or (x == x[0]).all() or (y == y[0]).all() else np.corrcoef(x - x[0], y - y[0])[0, 1]
        assert r == pytest.approx(expected, abs=1e-9), (a, b)


def test_states_add_up_to_the_whole(spark, tmp_path):
    """The analysis of parts' states is that of all rows, and no row is read for it: the parts are gone. A column of texts in one part has numbers in another, another comes later."""
    import shutil

    from quillon.plans import incremental

    rng = random.Random(6)
    rows = [(str(rng.randrange(9)) if i % 3 else None, rng.choice("abcd"), rng.gauss(50, 9), "x" if i < 60 else str(i % 7), None if i < 60 else float(i % 5), [1], i % 2 == 0) for i in range(150)]
    schema = "n string, k string, v double, mixed string, late double, list array<int>, flag boolean"
    paths = []
    for p, (a, b) in enumerate(((0, 60), (60, 100), (100, 150), (150, 150))):
        part = spark.createDataFrame(rows[a:b], schema)
        part = part.drop("late") if p == 0 else part
        part.write.parquet(f"{tmp_path}/part{p}")
        incremental.save_state(spark.read.parquet(f"{tmp_path}/part{p}"), f"{tmp_path}/state{p}", dynamic=True)
        shutil.rmtree(tmp_path / f"part{p}")
        paths.append(f"{tmp_path}/state{p}")
    got = incremental.analyze_states(spark, paths, "d")
    order = [c for c in got.columns]
    expected = analysis.analyze(spark.createDataFrame(rows, schema).select(*order), "d", dynamic=True)
    assert set(order) == {"n", "k", "v", "mixed", "late", "list", "flag"}

    def close(a, b):
        if isinstance(a, dict):
            return set(a) == set(b) and all(close(a[k], b[k]) for k in a)
        if isinstance(a, list):
            return len(a) == len(b) and all(map(close, a, b))
        return a == pytest.approx(b, rel=1e-9, abs=1e-9) if isinstance(a, float) else a == b

    for field in ("rows", "columns", "numeric", "categorical", "frequencies", "correlations", "groups", "insights", "unsupported", "histograms", "reports"):
        assert close(getattr(got, field), getattr(expected, field)), field


@pytest.mark.parametrize("few", [quantiles.FEW, 5])
def test_numbers_in_their_own_type(spark, monkeypatch, few):
    from decimal import Decimal

    monkeypatch.setattr(quantiles, "FEW", few)
    big = [2**53 + 1 + i for i in range(40)] + [2**62, -(2**63), None]
    exact = [Decimal(10) ** 27 + Decimal(i) / 10**10 for i in range(42)] + [None]
    df = spark.createDataFrame([(b, e, float("nan"), None) for b, e in zip(big, exact, strict=True)], "big bigint, exact decimal(38,10), none double, `odd``name` int")
    got = {r["column"]: r for r in profile.order_statistics(df).collect()}
    for name, values in (("big", sorted(big[:-1])), ("exact", sorted(exact[:-1]))):
        r, n = got[name], 42
        assert [r[c] for c in ("n", "min", "q1", "median_low", "median_high", "q3", "max")] == [n, *(str(values[i]) if name == "big" else f"{values[i]:.10f}" for i in (0, n // 4, (n - 1) // 2, n // 2, n * 3 // 4, n - 1))]
    assert tuple(got["none"])[1:] == tuple(got["odd`name"])[1:] == (0, *[None] * 6)


def test_values_of_any_size(spark):
    assert fixed(1e27, 2) == f"{int(1e27)}.00" and len(fixed(1.7e308, 2)) == 312 and fixed(-5e-324, 2) == "-0.00"
    typed = numbers(spark, [-1.7e308, 0.0, 1.7e308])
    bins = profile.histogram(typed, 3).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [1, 1, 1] and bins[0]["range_start"] == -1.7e308
    assert f"- **Range:** {fixed(1e27, 2)} - {fixed(3e30, 2)}" in render.markdown(analysis.analyze(spark.createDataFrame([(1e27,), (3e30,)], "v double"), "v"))


def test_formats():
    assert (fixed(1.005, 2), fixed(2.5, 0), fixed(None, 2)) == ("1.00", "3", "N/A")
    assert (plain(1e8), plain(0.5)) == ("100000000", "0.5")


def test_unsupported_columns(spark):
    typed = columns.classify(spark.createDataFrame([([1.0], 2)], "a array<double>, b int"))
    assert typed.unsupported == ["a"] and columns.column_types(typed).where("type = 'unsupported'").count() == 1
    assert classic.shape(typed.df) == (1, 2)
