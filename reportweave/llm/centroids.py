"""Centroid clustering in whole numbers by a bisector tournament.

For every two centroids there is a bisecting plane: an integer normal and an integer threshold.
A vector goes through k - 1 sign tests, each of which eliminates the farther of two
centroids; on the plane itself the smaller number wins.  Only the distance to the winner is worked
out.  Rounds send one sum per task and centroid, so nothing of the size of the table leaves its tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportweave.llm.common import stored

K, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, 3


def largest_component(dimensions: int) -> int:
    """Power of two below which scaled components have to stay, so that every test fits 64 bits."""
    return 1 << ((63 - (5 * dimensions).bit_length()) // 2)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals ``2 (c_j - c_i)`` and thresholds ``|c_j|^2 - |c_i|^2``: above it, a vector is nearer to j."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def tournament(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector, the smaller one of equals."""
    best = np.zeros(len(vectors), dtype=np.int64)
    for challenger in range(1, len(thresholds)):
        side = np.einsum("nd,nd->n", normals[best, challenger], vectors) - thresholds[best, challenger]
        best[side > 0] = challenger
    return best


def scaled_vectors(rows: DataFrame, id_column: str, vector: str, scale: int, dimensions: int) -> DataFrame:
    """``(id, v)``: vectors of the right length without null, NaN or infinite components, as whole numbers."""
    values = F.col(vector).cast("array<double>")
    limit = largest_component(dimensions) / scale

    def usable(x: Column) -> Column:
        # NaN is larger than any number here.
        return x.isNotNull() & (x < limit) & (x >= -limit)

    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) == dimensions) & F.forall(values, usable))
    whole = F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return kept.select(F.col(id_column).alias("id"), whole.alias("v"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """Number of vectors and sums of their components by centroid, from sums of each task."""
    k, dimensions = centroids.shape

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, thresholds = bisectors(centroids)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), dimensions)
            best = tournament(rows, normals, thresholds)
            for c in range(k):
                mine = rows[best == c]
                counts[c] += len(mine)
                sums[c] += mine.sum(axis=0)
        # The last place of a centroid holds its count.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), dimensions + 1)), pa.array(np.tile(np.arange(dimensions + 1), k)),
             pa.array(np.column_stack([sums, counts]).ravel())], ["cluster", "place", "part"])

    parts = vectors.select("v").mapInArrow(of_task, "cluster long, place long, part long")
    total = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    table = {(r.cluster, r.place): int(r.total) for r in total.collect()}
    return [(table.get((c, dimensions), 0), [table.get((c, d), 0) for d in range(dimensions)]) for c in range(k)]


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, thresholds = bisectors(centroids)
        for batch in batches:
            rows = _matrix(batch.column(1), centroids.shape[1])
            best = tournament(rows, normals, thresholds)
            apart = rows - centroids[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best.astype(np.int32)), pa.array((apart * apart).sum(axis=1))],
                ["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(of_task, f"id {kind}, cluster int, distance long")


def cluster_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
    scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED,
) -> DataFrame:
    """``(<id_column>, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector.

    Vectors of another length and those with a null, NaN or infinite component are left out, and
    so are those with a scaled component of 2^27 or more (for 64 dimensions), whose squared distances
    would not fit 64 bits.  The first centroids are the vectors of the smallest SHA-256 of
    ``<seed>:<id>``; null ids come last, and rows that repeat an id are told apart by their
    components.  With fewer vectors than ``k`` there are as many centroids as vectors; without any, the
    result is empty.  Repeated rows count each; further columns are not read.
    """
    vectors = stored(scaled_vectors(rows, id_column, vector, scale, dimensions))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        moved = [
            [s // n for s in sums] if n else old.tolist()
            for old, (n, sums) in zip(centroids, _sums(vectors, centroids), strict=True)
        ]
        before, centroids = centroids, np.array(moved, dtype=np.int64)
        if (before == centroids).all():
            break
    result = _assigned(vectors, centroids) if len(centroids) else vectors.selectExpr("id", "0 as cluster", "0L as distance")
    totals = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    by_cluster = {r.cluster: int(r.total) for r in totals}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row per centroid.
    named = rows.sparkSession.createDataFrame(
        [(c, by_cluster.get(c, 0), sum(by_cluster.values()), digest) for c, digest in enumerate(digests)],
        "of_cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    joined = result.join(F.broadcast(named), F.col("cluster") == F.col("of_cluster"))
    return joined.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
