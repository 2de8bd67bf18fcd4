"""Search and clustering of vectors against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import centroids, knn_join, vectors
from quillon.llm.oracles import ORACLES

SCHEMA = "vec_id bigint, embedding array<double>, score string, rank int, cluster int, row int"


def rows_of(seed, n, length, spread=1.0):
    """Clustered vectors with ties, copies, repeated ids, unusable components and clashing columns."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(length)] for _ in range(4)]
    out = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)]) for i in range(n)]
    out += [(rng.randrange(n), out[7][1]) for _ in range(n // 3)]  # one vector, a quarter of all rows, under ids that others have too
    out += [(20, out[20][1])] * 3 + [(None, out[3][1]), (None, out[4][1])]
    out += [(40, None), (60, []), (80, [None] * length), (100, [math.nan] + [0.0] * (length - 1)), (5, [math.inf] * length), (6, [1e30] * length), (120, [1.0, 2.0]), (7, [1.0] * (length + 2)), (-20, [0.5] * length)]
    rng.shuffle(out)
    return [(i, v, "x", 1, 2, 3) for i, v in out]


def usable(rows):
    """(vec_id, integers), or nothing where the vector takes no part."""
    out = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            if sum(x * x for x in whole) < 2**60:
                out.append((i, whole))
    return out


def best_by_hand(rows, every, k):
    rows, out = usable(rows), []
    for a, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(rows) if b != a]
            out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("pivots", "block", "chunk", "spread"), [(64, 4096, 4096, 1.0), (3, 5, 40, 30.0), (8, 2, 17, 3.0), (1, 1, 1000, 0.1)])
def test_search(spark, pivots, block, chunk, spread):
    rows = rows_of(1, 200, 6, spread)
    whole = vectors.integer_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = knn_join.voronoi_join(whole, F.col("vec_id") % 20 == 0, 5, pivots, block, chunk)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert found(got) == best_by_hand(rows, 20, 5)


def test_few_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5]), (50, [-1.0, 0.0])]
    for n in range(1, 4):
        some = [(*r, "x", 1, 2, 3) for r in rows[:n]]
        assert found(knn_join.search(spark.createDataFrame(some, SCHEMA), 50)) == best_by_hand(some, 50, 5)
    none = spark.createDataFrame([], SCHEMA)
    assert found(knn_join.search(none, 50)) == found(knn_join.search(spark.createDataFrame([(*rows[1], "x", 1, 2, 3)], SCHEMA), 50)) == []


def test_needless_vectors_are_not_sent(spark):
    """Far from each other, clusters need only their own vectors; thresholds are lower bounds of the k-th best scores."""
    rng = np.random.default_rng(3)
    middles = np.eye(4) * 50
    rows = [(i, (middles[i % 4] + rng.normal(0, 0.1, 4)).tolist(), "x", 1, 2, 3) for i in range(400)]
    data = vectors.integer_vectors(spark.createDataFrame(rows, SCHEMA)).withColumn("row", F.monotonically_increasing_id()).cache()
    pivots = np.floor(256 * middles).astype(np.int64)
    cells = knn_join.in_cells(data, pivots)
    radius = np.array([r["radius"] for r in cells.groupBy("cell").agg(F.max("away").alias("radius")).orderBy("cell").collect()])
    least = knn_join.thresholds(data, pivots, radius, 5)
    sent = knn_join.needed(data, pivots, radius, least, {c: (c, 1) for c in range(4)})
    assert sent.count() == 400 and sent.join(cells.select("row", "cell"), "row").where("cell <> block").count() == 0
    whole = {r["row"]: np.array(r["v"]) for r in data.collect()}
    for r in cells.collect():
        scores = sorted((int(whole[r["row"]] @ v) for i, v in whole.items() if i != r["row"]), reverse=True)
        assert scores[4] >= least[r["cell"]]


def test_packing():
    assert knn_join.packed({0: 3, 1: 2, 2: 11, 3: 1, 4: 5}, 5) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (5, 1)}


def test_products_beyond_doubles():
    a = np.array([[2**29, 1], [3, 5]], np.int64)
    assert vectors.products(a, a[:1]).tolist() == [[2**58 + 1], [3 * 2**29 + 5]]


def test_ragged_matrix():
    column = pa.chunked_array([pa.array([[1, 2], []], pa.list_(pa.int32())), pa.array([[3]], pa.list_(pa.int32()))])
    assert vectors.matrix(column).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert vectors.matrix(pa.chunked_array([], pa.list_(pa.int32()))).shape == (0, 0)


def clusters_by_hand(rows, k, rounds, length, seed):
    data = [(i, v) for i, v in usable(rows) if len(v) == length]
    start = sorted(data, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in start]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in data]
        for c in range(len(centres)):
            mine = [v for (_, v), a in zip(data, at, strict=True) if a == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [nearest(v) for _, v in data]
    away = [far(v, centres[a]) for (_, v), a in zip(data, at, strict=True)]
    inertia = [sum(d for d, a in zip(away, at, strict=True) if a == c) for c in range(len(centres))]
    return sorted(((i, a, d, inertia[a], sum(away), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()) for (i, _), a, d in zip(data, at, away, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (40, 2), (1, 3), (400, 1), (5, 0)])
def test_clusters(spark, k, rounds):
    rows = rows_of(k, 150, 6)
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, 6)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert found(got) == clusters_by_hand(rows, k, rounds, 6, 2)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None, "x", 1, 2, 3)]):
        assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == []


def test_only_changed_components_are_multiplied():
    rng = np.random.default_rng(4)
    x, before = rng.integers(-9, 9, (30, 5)), rng.integers(-9, 9, (4, 5))
    after = before.copy()
    after[1, 2] += 3
    after[3] -= 1

    class Watched(np.ndarray):
        taken: list = []

        def __getitem__(self, key):
            Watched.taken.append(key)
            return np.asarray(self)[key]

    dots = centroids.updated(before, after, x @ before.T, x.view(Watched))
    assert (dots == x @ after.T).all()
    assert [k[1].tolist() for k in Watched.taken] == [[2], [0, 1, 2, 3, 4]]


def test_sql(spark):
    """The SQL of both queries, on odd rows."""
    rows = [(i, v and [math.nan if x is None else x for x in v] if i != 80 else None) for i, v, *_ in rows_of(5, 300, 64) if v is None or 1e30 not in v]
    duck = duckdb.connect()
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    duck.register("embeddings", table)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for name, got in (("op11_knn_join", knn_join.search(df, 50)), ("op12_centroids", centroids.cluster(df))):
        assert found(got) == sorted(duck.sql(ORACLES[name]).select(*got.columns).fetchall(), key=repr), name
