"""Clustering by centroids with exact integers and distances that are kept up to date.

Each vector keeps its inner products with all centroids. When a centroid moves, only those of its components that have changed add to its products; the nearest centroid
then follows from the products and the centroids' squared lengths. Every round writes one table (vector, products, cluster, distance), which the next one reads, and drops the one before:
lost executors cost tasks, not rounds. The new centroids are sums by cluster, added up in each task first; only these (centroids times components) reach the driver.

Vectors of another length, or with a null, NaN or infinite component, take no part, nor do those whose squared length exceeds 2^60. Rows count as often as they come, also under the same id;
a null id is hashed as no text and comes last. Where fewer vectors are left than centroids are asked for, there are as many centroids as vectors. Ties go to the smaller number.
An empty table gives no rows. An inertia that doesn't fit a long is null. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import remove, scratch
from quillon.llm.vectors import integer_vectors, matrix

CENTROIDS, ROUNDS, LENGTH, SEED = 40, 5, 64, 2


class States:
    """Written tables of which only the newest is kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def write(self, df: DataFrame) -> DataFrame:
        path, before = scratch(self.spark, "vectors"), self.path
        df.write.parquet(path)
        self.path = path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.orderBy(F.col("vec_id").isNull(), key, "v").limit(k).select("v").collect()], np.int64)


def updated(before: np.ndarray, after: np.ndarray, dots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products with the centroids after a move, from those before it: only components that change cost anything."""
    for c in np.flatnonzero((before != after).any(axis=1)):
        moved = np.flatnonzero(before[c] != after[c])
        dots[:, c] += x[:, moved] @ (after[c] - before[c])[moved]
    return dots


def assigned(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """(vec_id, v, dots, cluster, distance) after the centroids have moved."""
    fresh = "dots" not in state.columns
    schema = T.StructType([state.schema["vec_id"], state.schema["v"], T.StructField("dots", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (after * after).sum(axis=1)
        for b in batches:
            x = matrix(b.column("v"), after.shape[1])
            dots = np.zeros((len(x), len(after)), np.int64) if fresh else matrix(b.column("dots"), len(after)).copy()
            dots = updated(before, after, dots, x)
            far = lengths - 2 * dots
            cluster = far.argmin(axis=1)  # the first of equals
            distance = far[np.arange(len(x)), cluster] + (x * x).sum(axis=1)
            kept = pa.ListArray.from_arrays(np.arange(0, dots.size + 1, len(after), dtype=np.int32), dots.ravel())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), kept, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=schema.names)

    return state.mapInArrow(nearest, schema)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; centroids without vectors stay."""
    out = centroids.copy()
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    states = States(spark)
    state = states.write(integer_vectors(rows, length))
    after = first_centroids(state, k, seed)
    if not len(after):
        after = np.zeros((1, length), np.int64)
    before = np.zeros_like(after)
    for i in range(rounds + 1):
        if i and (before == after).all():
            break  # nothing moved, so nothing changes any more
        state = states.write(assigned(state, before, after))
        if i < rounds:
            before, after = after, moved(state, after)
    sums = {r["cluster"]: int(r["far"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("far")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    told = [(c, fits(far), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, after[c].tolist())).encode()).hexdigest()) for c, far in sums.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
