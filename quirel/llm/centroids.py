"""Plain Lloyd clustering of vectors in whole numbers.

Centroids are broadcast with the function that each task runs. A task takes squared differences to every centroid
in NumPy and sums the vectors of each cluster; those few rows of a task merge in a groupBy. All
arithmetic is in integers, so results are the same on every cluster and after every retry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stored

#: Components below this size are summed and compared in 64 bits; vectors with larger ones in Python's integers.
NARROW = 1 << 27
#: Bits of a limb, as which sums leave a task, and the largest long.
LIMB, MOST = 30, (1 << 63) - 1


def _whole(x: float, factor: int) -> int:
    """floor(factor * x) of a double, exactly; doubles from 2 ** 53 on are whole."""
    return int(x) * factor if abs(x) >= 1 << 53 else math.floor(x * factor)


def scaled(vectors: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer components of vectors (n, size) with the mask of those that fit NARROW (others' rows are zeros)."""
    with np.errstate(over="ignore"):
        floors = np.floor(vectors * factor)
    narrow = (np.abs(floors) < NARROW).all(axis=1)
    return np.where(narrow[:, None], floors, 0).astype(np.int64), narrow


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the lowest number on ties."""
    distances = np.empty((len(vectors), len(centroids)), dtype=vectors.dtype)
    for c, centroid in enumerate(centroids):
        apart = vectors - centroid
        distances[:, c] = (apart * apart).sum(axis=1)
    # argmin takes the first of equal ones; so does min over Python's integers.
    best = distances.argmin(axis=1) if len(vectors) else np.zeros(0, dtype=np.int64)
    return best, distances[np.arange(len(vectors)), best]


class _Assign:
    """Runs in tasks: components, cluster and distance of a batch of vectors."""

    def __init__(self, centroids: list[list[int]], factor: int):
        self.factor, self.centroids = factor, centroids
        self.fits = all(abs(x) < NARROW for c in centroids for x in c)

    def __call__(self, batch: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, vectors, clusters, distances), once for narrow vectors and once for the others."""
        raw = np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), -1)
        whole, narrow = scaled(raw, self.factor)
        narrow &= self.fits
        rows = np.flatnonzero(narrow)
        if len(rows):
            yield rows, whole[rows], *nearest(whole[rows], np.array(self.centroids, dtype=np.int64))
        rows = np.flatnonzero(~narrow)
        if len(rows):
            wide = np.array([[_whole(x, self.factor) for x in raw[i].tolist()] for i in rows], dtype=object)
            yield rows, wide, *nearest(wide, np.array(self.centroids, dtype=object))


def _sums(assign: _Assign, k: int, size: int):
    """A mapInPandas function to (cluster, limb, n, sums): a task's integer sums by cluster; limbs past the first are for wide vectors only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, counts, wide = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64), {}
        for batch in batches:
            for _, vectors, clusters, _ in assign(batch["vector"]):
                counts += np.bincount(clusters, minlength=k)
                for c in np.unique(clusters).tolist():
                    total = vectors[clusters == c].sum(axis=0)
                    if vectors.dtype == object:
                        wide[c] = wide.get(c, 0) + total
                    else:
                        totals[c] += total
        out = [(c, 0, int(counts[c]), totals[c].tolist()) for c in np.flatnonzero(counts).tolist()]
        for c, total in wide.items():
            limb, rest = 0, total.tolist()
            while any(rest):
                last = all(abs(x) < 1 << LIMB for x in rest)
                out.append((c, limb, 0, rest if last else [x & ((1 << LIMB) - 1) for x in rest]))
                rest, limb = [0] * size if last else [x >> LIMB for x in rest], limb + 1
        yield pd.DataFrame(out, columns=["cluster", "limb", "n", "sums"])

    return run


def _moved(vectors: DataFrame, centroids: list[list[int]], factor: int) -> list[list[int]]:
    """Centroids after one round: floors of the means; those without vectors stay. At most a row per centroid and limb comes to the driver."""
    size = len(centroids[0])
    part = vectors.select("vector").mapInPandas(_sums(_Assign(centroids, factor), len(centroids), size), "cluster int, limb int, n long, sums array<long>")
    merged = part.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    n, total = [0] * len(centroids), [[0] * size for _ in centroids]
    for r in merged.collect():
        n[r.cluster] += r.n
        total[r.cluster] = [t + (int(r[f"s{i}"]) << (LIMB * r.limb)) for i, t in enumerate(total[r.cluster])]
    return [[t // n[c] for t in total[c]] if n[c] else centroid for c, centroid in enumerate(centroids)]


def cluster_vectors(table: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector kept: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of `size` components, none null or non-finite, are kept, and turned into floor(factor * x). The first centroids are the k
    vectors whose ids have the smallest digests; repeated ids are ordered by their vectors, a null id is digested as "null". With fewer vectors there are
    fewer centroids. Empty clusters keep their centroids; ties go to the smaller number. Distances and sums of them
    beyond a long are returned as the largest long. Other columns are ignored, whatever their names. No vectors give no rows.
    """
    spark = table.sparkSession
    vectors = columns(table, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    vectors = vectors.where((F.size("vector") == size) & finite)

    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    centroids = [[_whole(x, factor) for x in r.vector] for r in first]
    if centroids:
        for _ in range(rounds):
            centroids = _moved(vectors, centroids, factor)
    else:
        centroids = [[0] * size]
    assign = _Assign(centroids, factor)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clusters, distances = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=np.int64)
            for rows, _, c, d in assign(batch["vector"]):
                clusters[rows], distances[rows] = c, np.minimum(d, MOST).astype(np.int64)
            yield pd.DataFrame({"id": batch["id"], "cluster": clusters, "distance": distances})

    # Ids go through pandas as text: columns with nulls would become floating there.
    texts = vectors.withColumn("id", F.col("id").cast("string")).mapInPandas(placed, "id string, cluster int, distance long")
    found = stored(texts.withColumn("id", F.col("id").cast(vectors.schema["id"].dataType)), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    # A row per centroid: the side that is broadcast has k rows at most.
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(wide.alias("total")).collect()}
    rows = [(c, min(sums.get(c, 0), MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    side = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
