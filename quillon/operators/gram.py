"""Correlations of very many columns by matrix products: two scans, whatever the number of pairs.

The first scan finds a shift and a scale for each column. The second multiplies, in each task, the matrix of shifted cells (missing ones 0) and that of present cells with themselves and each other, which gives
for every pair of columns the number of rows that have both, and the sums, squares and products over just those. The tasks' matrices are cut into square tiles,
which are added up in a tree of bounded fan-in. Where a column hardly varies in the rows that it shares with another one, sums of squares lose their digits: such pairs are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.columns import Typed

#: Columns of a tile; partial tiles that are added up at once; tasks that send tiles, at most.
TILE, FAN_IN, TASKS = 100, 16, 4096
#: Share of its squares that a variance must be of, else it is in doubt.
CLEAR = 1e-7
PARTS = ("n", "xy", "x", "y", "xx", "yy")
_TILE = "a int, b int, task int, parts array<double>"


def shifts(wide: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each column its mean (its value, if there is but one), and the largest distance from it."""
    row = wide.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("low", F.min), ("high", F.max), ("mean", F.avg)))).first()
    low, high, mean = (np.array([np.nan if row[f"{n}_{k}"] is None else row[f"{n}_{k}"] for n in names], float) for k in ("low", "high", "mean"))
    with np.errstate(over="ignore", invalid="ignore"):
        shift = np.where((low == high) | ~np.isfinite(mean), low, mean)
        reach = np.maximum(np.abs(high - shift), np.abs(low - shift))
    return np.nan_to_num(shift), np.where(np.isfinite(reach) & (reach > 0), reach, 1.0)


def _tiles(wide: DataFrame, names: list[str], shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    width = len(names)
    cuts = [slice(i, min(i + TILE, width)) for i in range(0, width, TILE)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, xy, x, xx = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(cells)
            z = np.where(there, (cells - shift) / scale, 0.0)
            there = there.astype(float)
            n += there.T @ there
            xy += z.T @ z
            x += z.T @ there  # of the row's column, where the column's is there
            xx += (z * z).T @ there
        if n.any():
            task = TaskContext.get().partitionId()
            for a, ca in enumerate(cuts):
                for b, cb in enumerate(cuts[a:], a):
                    parts = np.concatenate([m.ravel() for m in (n[ca, cb], xy[ca, cb], x[ca, cb], x[cb, ca].T, xx[ca, cb], xx[cb, ca].T)])
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (a, b, task)] + [pa.array([parts], pa.list_(pa.float64()))], names=["a", "b", "task", "parts"])

    return wide.select(*names).mapInArrow(products, _TILE)


def _added(tiles: pa.Table) -> pa.Table:
    parts = tiles.column("parts").combine_chunks()
    total = parts.flatten().to_numpy().reshape(len(tiles), -1).sum(axis=0)
    return pa.table([tiles.column(c)[:1] for c in ("a", "b", "task")] + [pa.array([total], pa.list_(pa.float64()))], names=["a", "b", "task", "parts"])


def sums(typed: Typed) -> DataFrame:
    """(i, j, n, mean1, mean2, m11, m22, m12, correlation, doubtful) of all pairs i < j of numeric columns, over rows that have both: means, squares and products of distances from them;
    the correlation is 0 where one doesn't vary."""
    wide, names = typed.wide(), [f"x{i}" for i in range(len(typed.numeric))]
    shift, scale = shifts(wide, names)
    tasks = wide.rdd.getNumPartitions()
    if tasks > TASKS:
        wide, tasks = wide.coalesce(TASKS), TASKS
    tiles = _tiles(wide, names, shift, scale)
    while tasks > 1:
        tiles = tiles.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("a", "b", "task").applyInArrow(_added, _TILE)
        tasks = -(-tasks // FAN_IN)
    width = len(names)
    out = ("i", "j", "n", "mean1", "mean2", "m11", "m22", "m12", "correlation", "doubtful")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, parts in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), batch.column("parts"), strict=True):
                rows, columns = (np.arange(c * TILE, min((c + 1) * TILE, width)) for c in (a, b))
                n, xy, x, y, xx, yy = parts.values.to_numpy().reshape(len(PARTS), len(rows), len(columns))
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    x, y = x / n, y / n
                    both, vx, vy = xy / n - x * y, np.maximum(xx / n - x**2, 0), np.maximum(yy / n - y**2, 0)
                    doubt = (xx > 0) & (vx < CLEAR * xx / n) | (yy > 0) & (vy < CLEAR * yy / n)
                    r = np.clip(np.where((vx > 0) & (vy > 0), both / np.sqrt(vx * vy), 0.0), -1, 1)
                    sx, sy = scale[rows][:, None], scale[columns]
                    found = n, shift[rows][:, None] + sx * x, shift[columns] + sy * y, n * vx * sx**2, n * vy * sy**2, n * both * sx * sy, r, doubt
                i, j = np.nonzero(rows[:, None] < columns)
                yield pa.RecordBatch.from_arrays([pa.array(rows[i].astype(np.int32)), pa.array(columns[j].astype(np.int32)), pa.array(n[i, j].astype(np.int64)), *(pa.array(f[i, j]) for f in found[1:])], names=out)

    return tiles.mapInArrow(solved, "i int, j int, n bigint, mean1 double, mean2 double, m11 double, m22 double, m12 double, correlation double, doubtful boolean")


def correlations(typed: Typed) -> DataFrame:
    """(i, j, correlation, doubtful) of all pairs i < j of numeric columns."""
    return sums(typed).select("i", "j", "correlation", "doubtful")
