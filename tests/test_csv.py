"""CSV files that are read in splits give the rows of Spark's reader of whole files."""

import random

import duckdb
import numpy as np
import pytest

from quillon.plans.catalogue import ORACLES, QUERIES
from quillon.sources import csv_records, files


def cells(rng, newline, stray):
    kinds = [
        lambda: rng.choice(["", "x", "12", "é日", "a b", " ", "\t"]),
        lambda: '"' + "".join(rng.choice(["a", '""', ",", newline, "z "]) for _ in range(rng.randint(0, 12))) + '"',
        lambda: "v" * rng.randint(0, 9),
    ]
    if stray:
        kinds.append(lambda: rng.choice(['a"b', 'a""', '"ab"x', '"a\nb" y', ' "a"', '5" x', "a\rb", '"a,b" ']))
    return rng.choice(kinds)()


def text(rng, newline, stray, rows):
    lines = [",".join(cells(rng, newline, stray) for _ in range(rng.choice([1, 2, 3, 3, 3, 4, 5]))) for _ in range(rows)]
    return newline.join(["h1,h2,h3", *lines]) + rng.choice(["", newline, newline * 2])


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[1], "1")
    yield lambda size: spark.conf.set(keys[0], str(size))
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "newline", "stray", "size", "shuffled"), [(1, "\n", False, 20, False), (2, "\r\n", False, 64, False), (3, "\n", True, 7, True), (4, "\r\n", True, 200, False)])
def test_splits_of_quoted_newlines(spark, tmp_path, small_splits, monkeypatch, seed, newline, stray, size, shuffled):
    rng = random.Random(seed)
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text(text(rng, newline, stray, 60), newline="")
    if shuffled:
        monkeypatch.setattr(csv_records, "BROADCAST", 0)
    small_splits(size)
    path, lengths = str(tmp_path), sum(f.stat().st_size for f in tmp_path.iterdir())
    lines = csv_records.lines(spark, path)
    known = csv_records.layout(lines)
    assert known.special and not known.unsplit
    assert lines.rdd.getNumPartitions() >= lengths / size / 2
    assert rows(files._cells(spark, path)) == rows(whole(spark, path))
    header = whole(spark, path).schema
    corrupt = spark.read.options(header=True, multiLine=True, escape='"', columnNameOfCorruptRecord="_malformed", enforceSchema=True).schema(header.add("_malformed", "string")).csv(path)
    expected = [r for r in map(tuple, corrupt.collect()) if r[-1] is not None]
    assert len(files.malformed_rows(spark, path).collect()) == len(expected)


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    """Records, also the header, longer than splits, and a cell that is never closed."""
    long_ = "\n".join(f"line {i}" for i in range(50))
    (tmp_path / "a.csv").write_text(f'"h\n{long_}",b\n"{long_}",1\nx,2\n"{long_}\n",3\n"open\n{long_}', newline="")
    small_splits(16)
    assert rows(files._cells(spark, str(tmp_path))) == rows(whole(spark, str(tmp_path)))


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_files_without_quoted_newlines(spark, tmp_path, small_splits, newline):
    (tmp_path / "a.csv").write_text(newline.join(["a,b`c", *(f'"{i},""",{i}' for i in range(40)), "", "short"]), newline="")
    small_splits(32)
    df = files.read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b`c"] and rows(df) == rows(whole(spark, str(tmp_path)))
    assert newline == "\r" or df.rdd.getNumPartitions() > 8


def test_states_of_lines():
    rng = np.random.default_rng(1)
    for _ in range(50):
        bits = rng.integers(0, 4, 12)
        for start in (False, True):
            state, expected = start, []
            for b in bits:
                state = bool(b >> state & 1)
                expected.append(state)
            assert csv_records.through(bits, start).tolist() == expected


def test_long_lines(spark):
    """Both expressions take time in proportion to a line of any kind."""
    lines = [c * 300_000 for c in ('"', '""', 'a"', '",', ',"', '"a,', '"" ')]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert df.selectExpr(f"value rlike r'{csv_records.OPENS}'", f"value rlike r'{csv_records.STAYS}'").count() == 7
    assert len(df.selectExpr(f"value rlike r'{csv_records.OPENS}'", f"value rlike r'{csv_records.STAYS}'").collect()) == 7


@pytest.mark.parametrize("size", [64, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_malformed_rows_whatever_is_asked_of_them(spark, tmp_path, small_splits, newline, size):
    """Lines are compared with the header by all their cells, in many splits and in one, also if the result is asked for some of the cells, or none."""
    lines = [("{0},y", "{0},y,z", "{0},y,z,more")[i % 3].format(i) for i in range(90)]
    (tmp_path / "a.csv").write_text(newline.join(["a,b,c", *lines, ""]), newline="")
    small_splits(size)
    expected = sorted((line, *(line + ",").split(",")[:3]) for line in lines if line.count(",") != 2)
    expected = [(line, a, b, c or None) for line, a, b, c in expected]
    found = files.malformed_rows(spark, str(tmp_path))
    assert rows(found.select("row", "cells.*")) == sorted(expected, key=repr)
    assert rows(found.select("row", "cells.a", "cells.c")) == sorted(((r, a, c) for r, a, _, c in expected), key=repr)
    assert rows(found.select("cells.b")) == [("y",)] * 60
    assert rows(found.select("row")) == sorted(((r[0],) for r in expected), key=repr)
    assert found.count() == 60


def test_query_of_malformed_rows_in_splits(spark, small_splits):
    data = "/root/testdata/sf0.001"
    expected = duckdb.sql(ORACLES["malformed_csv_rows"].replace("FROM orders", f"FROM '{data}/orders.parquet'")).fetchall()
    small_splits(4096)
    df = QUERIES["malformed_csv_rows"](spark, data)
    assert len(expected) > 400 and rows(df.select("row", "o_orderkey", "o_custkey")) == sorted(expected, key=repr)
