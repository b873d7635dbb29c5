"""Plain Lloyd over integer vectors.

A vector is kept if it has exactly ``dimensions`` components, none null, NaN or
infinite; a component x becomes floor(256 x).  Centroids 0, 1, ... start as the kept
vectors whose ``2:<id>`` has the smallest SHA-256.  A round broadcasts the centroids (k
times the dimensions, whatever the input), ``mapInPandas`` takes the squared integer
differences from each centroid in NumPy, and ``argmin`` the nearest, the lowest number
among equals.  A task adds up its vectors and sends a row a centroid; ``groupBy`` adds
those of all tasks, and the driver gets k rows.  The next centroid is the exact
floor(sum / count); one without vectors stays.  After the rounds every vector is
assigned once more.

Everything is exact: components within 2**27 are 64-bit integers, and so are their
distances; in a batch with a larger one Python's integers are used.  Sums travel
in limbs of 40 bits.  A distance or inertia beyond a long is given as the largest long.

Equal vectors get equal results; equal ids, or missing ones (hashed as ``2:``), are rows
of their own, the smaller vector first where they start.  Fewer kept vectors than
centroids make as many centroids; an empty table, or one without a kept vector, gives an
empty result.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import table
from coppice.session import save, ship, spread

DIMENSIONS, CLUSTERS, ROUNDS = 64, 40, 5
SCALE = 256
WHOLE = 1 << 27  # larger components could give distances beyond 64 bits
LIMB = 40
LONGEST = (1 << 63) - 1


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """Rows (id, vector): vectors of the right length without nulls, NaN or infinities; ids as text."""
    infinite = float("inf")
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < infinite, F.lit(False)))  # NaN is above all numbers
    return df.where((F.size(vector) == dimensions) & fine).select(F.col(id_col).cast("string").alias("id"), vector.alias("vector"))


def integers(vectors: pd.Series) -> np.ndarray:
    """floor(256 x) of each component: int64, or Python's integers where one is too large."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    if not len(x) or np.abs(x).max(initial=0) * SCALE < WHOLE:
        return np.floor(x * SCALE).astype(np.int64)
    # a product by a power of two is exact unless it overflows, and large doubles are integers
    whole = [int(v) * SCALE if abs(v) > 1 << 60 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the lowest number among equals, and the squared distance."""
    if len(centroids) and np.abs(centroids).max() >= WHOLE:
        vectors = vectors.astype(object)
    elif vectors.dtype != object:
        centroids = centroids.astype(np.int64)
    distances = np.empty((len(centroids), len(vectors)), vectors.dtype)
    for k, c in enumerate(centroids):
        off = vectors - c
        distances[k] = (off * off).sum(axis=1)
    at = distances.argmin(axis=0)
    return at, distances[at, np.arange(len(vectors))]


def limbs(value: int) -> list[int]:
    """``value`` in base 2**40, lowest first, each with the sign of the value."""
    sign, left, out = (-1 if value < 0 else 1), abs(value), []
    while left or not out:
        out.append(sign * (left & ((1 << LIMB) - 1)))
        left >>= LIMB
    return out


def sum_rows(sums: list[list[int]], counts: list[int]) -> Iterator[tuple]:
    """Rows (cluster, limb, n, s0, s1, ...) of the clusters with vectors."""
    for k, (values, n) in enumerate(zip(sums, counts, strict=True)):
        if n:
            split = [limbs(v) for v in values]
            for limb in range(max(map(len, split))):
                yield (k, limb, 0 if limb else n, *(x[limb] if limb < len(x) else 0 for x in split))


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors nearest to each centroid that has any."""
    dimensions = centroids.shape[1]
    names = ["cluster", "limb", "n", *(f"s{i}" for i in range(dimensions))]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        sums, counts = [[0] * dimensions for _ in known], [0] * len(known)
        for batch in batches:
            if len(batch):
                x = integers(batch["vector"])
                at, _ = nearest(x, known)
                for k in np.unique(at).tolist():
                    mine = x[at == k]
                    counts[k] += len(mine)
                    sums[k] = [a + b for a, b in zip(sums[k], mine.sum(axis=0).tolist(), strict=True)]
        yield pd.DataFrame(list(sum_rows(sums, counts)), columns=names).astype("int64")

    schema = "cluster int, limb int, " + ", ".join(f"{c} long" for c in names[2:])
    added = vectors.select("vector").mapInPandas(run, schema).groupBy("cluster", "limb").agg(*[F.sum(c).alias(c) for c in names[2:]])
    found: dict[int, tuple[int, list[int]]] = {}
    for row in added.collect():  # a row for each limb of each centroid
        n, sums = found.get(row.cluster, (0, [0] * dimensions))
        found[row.cluster] = n + row.n, [s + (x << LIMB * row.limb) for s, x in zip(sums, row[3:], strict=True)]
    return found


def moved(centroids: np.ndarray, found: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    out = centroids.astype(object)
    for k, (n, sums) in found.items():
        out[k] = [s // n for s in sums]
    return out


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose id has the smallest hash, as rows of Python integers."""
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce("id", F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "vector").orderBy("name", "vector").limit(clusters).collect()
    return integers(pd.Series([np.array(r.vector) for r in rows])).astype(object) if rows else np.zeros((0, 0), object)


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of rows (id, vector) after so many rounds, as Python integers."""
    centroids = first_centroids(vectors, clusters)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, cluster_sums(vectors, centroids))
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (id, cluster, distance)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, distance = nearest(integers(batch["vector"]), shared.value)
                yield pd.DataFrame({"id": batch["id"], "cluster": at, "distance": [min(d, LONGEST) for d in distance.tolist()]})

    return vectors.mapInPandas(run, "id string, cluster int, distance long")


def written(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """Vectors (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) and centroids (cluster, centroid, size, centroid_sha256)."""
    spark = ship(df.sparkSession)
    vectors = kept_vectors(df, id_col, vector_col, dimensions)
    centroids = lloyd(vectors, clusters, rounds)
    placed = save(assigned(vectors, centroids), "assigned")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("size"))
    of = {r.cluster: (int(r.total), r.size) for r in sums.collect()}  # a row a centroid
    whole = min(sum(total for total, _ in of.values()), LONGEST)
    rows = [(k, min(of.get(k, (0, 0))[0], LONGEST), whole, written(c), list(map(str, c.tolist())), of.get(k, (0, 0))[1]) for k, c in enumerate(centroids)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<string>, size long"
    table_of = spark.createDataFrame(rows, schema)
    joined = placed.join(F.broadcast(table_of.drop("centroid", "size")), "cluster")  # a row a centroid
    kind = df.schema[id_col].dataType
    out = joined.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return out, table_of.select("cluster", "centroid", "size", "centroid_sha256")


def op11_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spread(table(spark, sf_dir, "embeddings")))[0]


def clusters_sql(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the same rows: components in long form, a table a round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "long AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"firsts AS (SELECT vec_id, v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {clusters})",
        "c0 AS MATERIALIZED (SELECT k, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM firsts)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM (SELECT vec_id, k, sum((x - c) * (x - c))::BIGINT AS d FROM long JOIN c{r} USING (i) GROUP BY vec_id, k)
              QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r}
                  LEFT JOIN (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN long USING (vec_id) GROUP BY k, i) USING (k, i))"""
            )
    parts.append(f"names AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"""WITH {', '.join(parts)} SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
      (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN names USING (k)"""
