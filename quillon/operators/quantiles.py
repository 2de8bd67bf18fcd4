"""Exact order statistics of columns and groups of any length, by two scans whatever the number of ranks.

A built-in percentile keeps every distinct value of a column in one task. That is right up to `DIRECT` rows. Beyond it the first scan brackets all wanted ranks of all
columns and groups by approximate percentiles (mergeable sketches, in the same aggregation as other statistics). The second finds for each value the bracket it
lies in, or between which ones, and counts: values within brackets one by one, all others together, added up before the shuffle. What is left is a small share of the data,
in order of brackets and values; a rank is where the running count reaches it. Where that is still much it is sorted in ranges, and counts run over ranges first. Groups and their
brackets stay tables, so nothing on the driver grows with them. A rank that falls outside its bracket, which a sketch's error would have to exceed its bound for, is found by
sorting that group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import at_floor
from quillon.operators.columns import Typed
from quillon.sources.scratch import table

DIRECT = 200_000
#: Values of a column or group that are counted one by one, without a sketch.
FEW = 20_000
#: Counted values that one window sorts, all groups together; more are sorted in ranges.
LARGE = 2_000_000
ACCURACY = 10_000
#: Share by which brackets reach over the rank: several times the error of the approximation.
MARGIN = 4 / ACCURACY
#: Groups up to which their brackets are broadcast.
BROADCAST = 50_000

Rank = tuple[float, str]
MEDIAN: tuple[Rank, ...] = ((0.5, "middle"),)


def ranks(n: Column, share: float, kind: str) -> tuple[Column, Column]:
    """The 0-based ranks between which a quantile of n values lies. floor: the element at index floor(n * share); linear: both around (n - 1) * share; middle: both middle elements."""
    if kind == "floor":
        one = F.floor(n * share)
        return one, one
    if kind == "middle":
        return F.floor((n - 1) / 2), F.floor(n / 2)
    return F.floor((n - 1) * share), F.ceil((n - 1) * share)


def brackets(x: Column, wanted: Sequence[Rank]) -> Column:
    """An aggregate: ends of the brackets of all wanted ranks, in order; none where the values are few."""
    points = sorted(p for s in {s for s, _ in wanted} for p in (max(0.0, s - MARGIN), min(1.0, s + MARGIN)))
    return F.when(F.count(x) > FEW, F.percentile_approx(x, points, ACCURACY))


def _place(x: Column, ends: Column, n: int) -> Column:
    """Where x lies among n ends: 4j below bracket j, 4j + 1 and 4j + 3 at its ends, 4j + 2 within; the last number is above all. Without ends everything lies within."""
    end = [F.get(ends, F.lit(i)) for i in range(n)]
    out = F.when(ends.isNull(), 2)
    for i in range(n):
        out = out.when(x < end[i], 2 * i).when(x == end[i], 2 * i + 1)
    return out.otherwise(2 * n).cast("int")


def _counted(rows: DataFrame, by: list[str], cells: dict[int, str], n_ends: int, kind: str) -> DataFrame:
    """(by, col, place, value, n) of rows (by, cells, ends_<col>): value is null where many are counted together."""
    places = []
    for i, c in cells.items():
        place = _place(F.col(c), F.col(f"ends_{i}"), n_ends)
        places.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("col"), place.alias("place"), F.col(c).cast(kind).alias("x"))))
    each = rows.select(*by, F.explode(F.array(*places)).alias("p")).where("p is not null")
    value = F.when(F.col("p.place") % 4 != 0, F.col("p.x"))
    return each.select(*by, "p.col", "p.place", value.alias("value")).groupBy(*by, "col", "place", "value").agg(F.count(F.lit(1)).alias("n"))


def _running(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds upto, the running count of each column and group, and total."""
    key, order = [*by, "col"], ["place", "value"]
    whole = Window.partitionBy(*key)
    if counts.count() <= LARGE:
        return counts.withColumns({"upto": F.sum("n").over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(whole)})
    ordered = table(counts.orderBy(*key, *order).withColumn("at", F.monotonically_increasing_id()), "ordered_counts").withColumn("part", F.shiftright("at", 33))
    sums = ordered.groupBy(*key, "part").agg(F.sum("n").alias("here"))  # a row for each range and group in it
    before = F.coalesce(F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*key, "part", before.alias("before"), F.sum("here").over(whole).alias("total"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*key, "part"]]
    within = Window.partitionBy(*(F.col(f"o.{k}") for k in [*key, "part"])).orderBy("o.at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.alias("o").join(sums.alias("s"), same).select("o.*", (F.col("before") + F.sum("o.n").over(within)).alias("upto"), "total").drop("at", "part")


def selected(rows: DataFrame, by: list[str], cells: dict[int, str], wanted: Sequence[Rank], ends: DataFrame | None = None, kind: str = "double") -> DataFrame:
    """(by, col, n, low, high): arrays of the values at the lower and the upper rank of each wanted quantile, of each column (cells: number and name) in each group of rows.
    kind: the type of all these columns, which is that of the values.

    ends: (by, ends_<number>) by `brackets`, if another aggregation has made them; a table. Nulls don't count. The result is read from written tables.
    """
    n_ends = 2 * len({s for s, _ in wanted})
    if ends is None:
        ends = table(rows.groupBy(*by).agg(*(brackets(F.col(c), wanted).alias(f"ends_{i}") for i, c in cells.items())), "brackets")
    if by:
        few = ends.count() <= BROADCAST
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in by]
        placed = rows.alias("r").join((F.broadcast(ends) if few else ends).alias("e"), same).select("r.*", *(f"e.ends_{i}" for i in cells))
    else:
        one = ends.first()
        placed = rows.withColumns({f"ends_{i}": F.lit(one[f"ends_{i}"]) if one and one[f"ends_{i}"] else F.lit(None).cast(f"array<{kind}>") for i in cells})
    out = _picked(_running(table(_counted(placed, by, cells, n_ends, kind), "rank_counts"), by), by, wanted)
    out = table(out, "quantiles")
    lost = out.where(~F.forall("low", lambda v: v.isNotNull()) | ~F.forall("high", lambda v: v.isNotNull()))
    if not lost.head(1):
        return out
    keys = table(lost.select(*by, "col"), "lost_ranks")
    every = rows.withColumns({f"ends_{i}": F.lit(None).cast(f"array<{kind}>") for i in cells})
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*by, "col"]]
    again = _counted(every, by, cells, n_ends, kind).alias("c").join(keys.alias("k"), same("c", "k"), "left_semi")
    again = table(_picked(_running(table(again, "rank_counts"), by), by, wanted), "quantiles")
    return out.alias("o").join(keys.alias("k"), same("o", "k"), "left_anti").union(again)


def _picked(running: DataFrame, by: list[str], wanted: Sequence[Rank]) -> DataFrame:
    total, upto = F.col("total"), F.col("upto")
    at = lambda rank: F.max(F.when((upto > rank) & (upto - F.col("n") <= rank), F.col("value")))
    pairs = [ranks(total, s, kind) for s, kind in wanted]
    return running.groupBy(*by, "col").agg(F.max("total").alias("n"), F.array(*(at(low) for low, _ in pairs)).alias("low"), F.array(*(at(high) for _, high in pairs)).alias("high"))


def of_counts(counts: DataFrame, by: list[str], wanted: Sequence[Rank]) -> DataFrame:
    """As `selected`, of values that are counted already: (by, col, place, value, n), with one place."""
    return _picked(_running(counts, by), by, wanted)


def middle() -> Column:
    """The median of a row of `selected`, if that is what was wanted."""
    low, high = F.get("low", F.lit(0)), F.get("high", F.lit(0))
    return F.when(low == high, low).otherwise(low + (high - low) / 2)


def interpolated(low: float, high: float, n: int, share: float, kind: str) -> float:
    """The quantile from the values at its ranks."""
    at = (n - 1) * (0.5 if kind == "middle" else share)
    return low + (high - low) * (at - floor(at)) if low != high else low


def _builtin(x: str, n: int, share: float, kind: str) -> Column:
    return at_floor(x, share, n) if kind == "floor" else F.percentile(F.col(x), F.lit(share))


def column_records(typed: Typed, stats: Callable[[str, str], dict[str, Column]], wanted: Sequence[Rank], names: Sequence[str]) -> DataFrame:
    """A row for each numeric column: its name, the aggregates that stats makes of name and cell, and its quantiles under `names`. Short data take one aggregation; long ones two,
    the first of which has the brackets too."""
    wide, cells = typed.wide(), {i: f"x{i}" for i in range(len(typed.numeric))}
    each = {i: {"column": F.lit(typed.numeric[i])} | stats(typed.numeric[i], x) for i, x in cells.items()}
    if max(typed.numbers[c] for c in typed.numeric) <= DIRECT:
        for i, x in cells.items():
            each[i] |= {name: _builtin(x, typed.numbers[typed.numeric[i]], *w) for name, w in zip(names, wanted, strict=True)}
        return wide.agg(F.array(*(F.struct(*(v.alias(k) for k, v in r.items())) for r in each.values())).alias("records")).select(F.inline("records"))
    first = table(wide.agg(F.array(*(F.struct(*(v.alias(k) for k, v in r.items())) for r in each.values())).alias("records"), *(brackets(F.col(x), wanted).alias(f"ends_{i}") for i, x in cells.items())), "column_records")
    found = {r["col"]: r for r in selected(wide, [], cells, wanted, first.drop("records")).collect()}  # a row for each column
    of = lambda i, j: interpolated(found[i]["low"][j], found[i]["high"][j], found[i]["n"], *wanted[j]) if i in found else None
    known = typed.df.sparkSession.createDataFrame([(c, *(of(i, j) for j in range(len(wanted)))) for i, c in enumerate(typed.numeric)], ", ".join(["column string", *(f"{n} double" for n in names)]))
    return first.select(F.inline("records")).join(F.broadcast(known), "column")
