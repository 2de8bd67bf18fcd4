"""Exact search of the k highest inner products of many queries at once: a Voronoi join.

A few vectors are pivots. A query belongs to the cell of the nearest pivot a; the cell's summary is its number of queries and its radius r, the largest distance of one from a.
For any query q of the cell and any vector y, <q, y> = <a, y> + <q - a, y> lies within r |y| of <a, y>. So the (k + 1)-th highest lower bound of all vectors, of which each task
reports only its own highest, is a score that every query of the cell reaches without itself: its threshold. A vector whose upper bound is below that is needed by no query of the cell and isn't sent there.

Cells are packed into blocks of a bounded number of queries; a cell of more (a hot pivot) is split over several. The vectors that a block needs are dealt into chunks by a hash, and each
(block, chunk) is solved on its own: exact integer products, the best k of the chunk. The last step ranks the best of all chunks. So neither a hot vector nor a block that needs all rows
meets in one task. Thresholds only spare work; they leave out no vector that could be among the best.

A vector of another length than the query's counts as if filled with zeros. Vectors that `integer_vectors` leaves out take no part, neither as queries nor as
candidates. Rows count as often as they come: a row of the same id and vector is a candidate like any other, only the query's own row isn't. Ties go to the smaller id, a null id last;
a null id is no query. Empty tables and tables without queries give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import table
from quillon.llm.vectors import integer_vectors, matrix, products

BEST, PIVOTS = 5, 64
#: Queries of a block and vectors of a chunk, at most and on average; queries that are scored at once.
BLOCK, CHUNK, SLAB = 4096, 4096, 512
#: Share by which rounding could shift a bound, with room.
ROUNDING = 1e-9


def sizes(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(m.astype(np.float64)).sum(axis=1))


def in_cells(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each query's cell and its distance from the pivot."""
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"))
            squares = np.square(sizes(v))[:, None] + np.square(sizes(pivots)) - 2.0 * products(v, pivots)
            cell = squares.argmin(axis=1)
            away = np.sqrt(np.maximum(squares[np.arange(len(v)), cell], 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=schema.names)

    return queries.mapInArrow(nearest, schema)


def bounds(v: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of vectors (rows) with any query of each cell (columns)."""
    middle = products(v, pivots).astype(np.float64)
    reach = sizes(v)[:, None] * radius
    reach += ROUNDING * (reach + sizes(v)[:, None] * sizes(pivots) + 1)
    return middle - reach, middle + reach


def thresholds(vectors: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """A score for each cell that k + 1 vectors reach for any query of it; no task reports more than its own k + 1 highest."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((k + 1, len(pivots)), -np.inf)
        for b in batches:
            low, _ = bounds(matrix(b.column("v")), pivots, radius)
            top = np.concatenate([top, low])
            top = np.partition(top, len(top) - k - 1, axis=0)[len(top) - k - 1 :]
        cells = np.tile(np.arange(len(pivots), dtype=np.int32), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(top.ravel())], names=["cell", "low"])

    each = vectors.select("v").mapInArrow(highest, "cell int, low double")
    order = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))
    best = each.withColumn("nth", order).where(F.col("nth") <= k + 1).groupBy("cell").agg(F.min("low").alias("low"))
    out = np.full(len(pivots), -np.inf)
    for r in best.collect():  # a row for each pivot
        out[r["cell"]] = r["low"]
    return out


def packed(counts: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """(first block, number of blocks) of each cell: small cells share blocks, large ones have several of their own."""
    out, at, room = {}, -1, 0
    for cell, n in sorted(counts.items()):
        if n > block:
            parts = -(-n // block)
            out[cell], at, room = (at + 1, parts), at + parts, 0
            continue
        if n > room:
            at, room = at + 1, block
        out[cell], room = (at, 1), room - n
    return out


def needed(vectors: DataFrame, pivots: np.ndarray, radius: np.ndarray, least: np.ndarray, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """Each vector once for every block of which it may be among the best of some query."""
    cells = np.array(sorted(blocks), np.int64)
    last = max(first + n for first, n in blocks.values())
    of = np.zeros((len(cells), last), bool)
    for i, c in enumerate(cells):
        of[i, blocks[c][0] : sum(blocks[c])] = True
    schema = T.StructType([*vectors.schema.fields, T.StructField("blocks", T.ArrayType(T.IntegerType()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, high = bounds(matrix(b.column("v")), pivots[cells], radius[cells])
            to = (high >= least[cells]) @ of
            at = np.concatenate([[0], to.sum(axis=1).cumsum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, to.nonzero()[1].astype(np.int32))], names=schema.names)

    return vectors.mapInArrow(send, schema).select(*vectors.columns, F.explode("blocks").alias("block"))


def best_of(k: int):
    """The function that solves one block against one chunk."""

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        data = data.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids last
        q, y = matrix(queries.column("v")), matrix(data.column("v"))
        row, own = data.column("row").to_numpy(), queries.column("row").to_numpy()
        none, n, found = np.iinfo(np.int64).min, len(row), []
        for at in range(0, len(q) if n else 0, SLAB):
            score = products(q[at : at + SLAB], y)
            score[own[at : at + SLAB, None] == row] = none
            least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), none)
            i, j = np.nonzero((score >= least[:, None]) & (score > none))
            order = np.lexsort((j, -score[i, j], i))
            i, j = i[order], j[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < k], j[nth < k]
            found.append((i + at, j, score[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64),) * 3
        return pa.table({"query_row": pa.array(own[i]), "query_id": pc.take(queries.column("vec_id"), pa.array(i)), "vec_id": pc.take(data.column("vec_id"), pa.array(j)), "row": pa.array(row[j]), "score": pa.array(s)})

    return solve


def voronoi_join(vectors: DataFrame, is_query: Column, k: int = BEST, pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row of vectors (vec_id, v) that is a query, the k other rows of the highest products."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    vectors = table(vectors.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    queries = vectors.where("asks").drop("asks")
    centres = queries.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    centres = matrix(pa.array([r["v"] for r in centres], pa.list_(pa.int32())))
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    queries = table(in_cells(queries, centres), "queries")
    summary = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # a row for each pivot
    radius = np.zeros(len(centres))
    for r in summary:
        radius[r["cell"]] = r["radius"]
    blocks = packed({r["cell"]: r["n"] for r in summary}, block)
    data = vectors.drop("asks")
    data = needed(data, centres, radius, thresholds(data, centres, radius, k), blocks)
    chunks = max(1, -(-vectors.count() // chunk))
    data = data.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    first, parts = (F.create_map(*(F.lit(x) for c, b in blocks.items() for x in (c, b[i])))[F.col("cell")] for i in (0, 1))
    queries = queries.withColumn("block", (first + F.pmod(F.xxhash64("row"), parts)).cast("int")).select("row", "vec_id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    schema = f"query_row bigint, query_id {kind}, vec_id {kind}, row bigint, score bigint"
    found = queries.groupBy("block", "chunk").cogroup(data.groupBy("block", "chunk")).applyInArrow(best_of(k), schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, every: int, k: int = BEST) -> DataFrame:
    """The join with the rows as queries whose vec_id is divisible by `every`."""
    return voronoi_join(integer_vectors(rows), F.col("vec_id") % every == 0, k)
