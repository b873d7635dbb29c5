"""Clusters against a plain version in Python's integers, and against SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from coppice.llm import centroids as C

INF, NAN = float("inf"), float("nan")


def brute(rows, dimensions, clusters, rounds):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))][:clusters]

    def assign():
        away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
        return [min((away(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, j) in zip(kept, at, strict=True) if j == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at, longest = assign(), (1 << 63) - 1
    inertia = {k: sum(d for d, j in at if j == k) for k in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, min(d, longest), min(inertia[k], longest), min(sum(inertia.values()), longest), names[k]) for (i, _), (d, k) in zip(kept, at, strict=True))


def rows_of(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def vectors(seed, n, dimensions, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.0, rng.gauss(0, spread)]) for _ in range(dimensions)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_a_plain_version(spark, kind):
    rows = vectors(1, 120, 4) + [(3, [0.5, 0.5, 0.5, 0.5])] * 40 + [(None, [1.0, 0.0, -1.0, 0.25])] * 2
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 0.0, 0.0]), (204, [NAN, 0.0, 0.0, 0.0]), (205, [0.0, -INF, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    plain = [(r.vec_id, r.embedding) for r in df.collect()]
    for clusters, rounds in ((7, 5), (1, 1), (200, 2), (5, 0)):
        found, centroids = C.cluster_vectors(df.repartition(3), dimensions=4, clusters=clusters, rounds=rounds)
        expected = brute(plain, 4, clusters, rounds)
        assert rows_of(found) == expected and len(expected) == 162
        assert centroids.count() == min(clusters, 162) and sum(r.size for r in centroids.collect()) == 162


def test_large_components_are_exact(spark):
    rows = vectors(2, 40, 3) + vectors(3, 20, 3, 1e7) + [(90, [3e38, -3e38, 1.0]), (91, [3e38, -3e38, 2.0]), (92, [1e308, 1e18, -1e18])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found, _ = C.cluster_vectors(df, dimensions=3, clusters=6, rounds=3)
    assert rows_of(found) == brute(rows, 3, 6, 3)


def test_floors_ties_and_empty_clusters(spark):
    rows = [(i, [x]) for i, x in enumerate([-1 / 256, -2 / 256, 0.0, 0.0, 0.0, 3 / 256, 1e-9, -1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for clusters in (2, 3, 8):
        found, _ = C.cluster_vectors(df, dimensions=1, clusters=clusters)
        assert rows_of(found) == brute(rows, 1, clusters, 5)


def test_awkward_tables(spark):
    df = spark.createDataFrame([("b", [1.0], 1, "x"), ("a", [2.0], 2, "y"), (None, [2.0], 3, None)], "vec_id string, embedding array<double>, cluster int, id string")
    assert rows_of(C.cluster_vectors(df, dimensions=1, clusters=2)[0]) == brute([("b", [1.0]), ("a", [2.0]), (None, [2.0])], 1, 2, 5)
    for none in (df.limit(0), df.where("id = 'none'")):
        found, centroids = C.cluster_vectors(none, dimensions=1)
        assert found.count() == 0 and centroids.count() == 0
    assert C.cluster_vectors(df, dimensions=2)[0].count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = [(i, v) for i, v in vectors(4, 150, 8)] + [(500, None), (501, [None] * 8), (502, [NAN] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    expected = db.sql(C.clusters_sql(8, 9, 3)).fetchall()
    assert rows_of(C.cluster_vectors(df, dimensions=8, clusters=9, rounds=3)[0]) == sorted((str(r[0]), *r[1:]) for r in expected)
