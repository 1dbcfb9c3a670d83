"""Centroid clustering with progressive search over Walsh-Hadamard coefficients.

Vectors and centroids become integers and are transformed by the Walsh-Hadamard matrix, whose rows are taken
from the coarsest to the finest (by the number of their sign changes). The transform is exact and keeps
distances: squared differences of the coefficients sum up to 64 times the squared distance. They are summed
level by level, a lower bound at every level; the leader after the first levels is followed to the end for an upper
bound, and centroids strictly beyond it are dropped. What stays is summed over all 64 coefficients.

The assignment is a map over the vectors: a task gives one row of sums for each centroid, so that a round
shuffles some rows per task, and the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolog.llm.shared import written

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LEVELS = (4, 8, 16, 32, 64)
#: Up to this size of components all sums of the search fit in 64 bits; beyond, whole numbers of any size are used.
PLAIN = 1 << 24
#: Components beyond this size have no squared distances that 64 bits hold; their vectors are left out.
LARGEST = 1 << 30
#: Vectors searched at once.
LOT = 4096


def walsh(width: int = WIDTH) -> np.ndarray:
    """The Walsh-Hadamard matrix of ones and minus ones, rows ordered by their sign changes."""
    rows = np.ones((1, 1), dtype=np.int64)
    while len(rows) < width:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")]


def search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number at ties, and its squared distance."""
    n, k = len(vectors), len(centroids)
    size = max([0, *np.abs(vectors).max(axis=1, initial=0).tolist(), *np.abs(centroids).max(axis=1, initial=0).tolist()])
    kind = np.int64 if size <= PLAIN else object
    matrix = walsh(vectors.shape[1]).T.astype(kind)
    x, c = vectors.astype(kind) @ matrix, centroids.astype(kind) @ matrix
    width = x.shape[1]

    def part(i: np.ndarray, j: np.ndarray, a: int, b: int) -> np.ndarray:
        d = x[i, a:b] - c[j, a:b]
        return (d * d).sum(axis=1)

    i, j = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    levels = [*(level for level in LEVELS if level < width), width]
    total, done, best = part(i, j, 0, levels[0]), levels[0], None
    for level in levels[1:]:
        if best is None:
            leader = total.reshape(n, k).argmin(axis=1)
            best = part(np.arange(n), leader, 0, width)
        near = (total <= best[i]).astype(bool)
        i, j, total = i[near], j[near], total[near]
        total = total + part(i, j, done, level)
        done = level
    # the search is over: the least sum of each vector, then the least number
    order = np.lexsort((j, total, i)) if kind is np.int64 else np.array(sorted(range(len(i)), key=lambda p: (i[p], total[p], j[p])), dtype=np.int64)
    first = order[np.unique(i[order], return_index=True)[1]]
    return j[first], total[first] // width


def _whole(vector: Column) -> Column:
    """The components as whole numbers; null unless there are 64, all finite and none too large for a distance."""
    scaled = F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    usable = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST)))
    return F.when((F.size(vector) == WIDTH) & F.coalesce(usable, F.lit(False)), F.transform(scaled, lambda x: F.floor(x).cast("bigint")))


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The vectors that can be clustered, as ``(id, whole)``: 64 whole numbers each."""
    whole = vectors.select(F.col(id_col).alias("id"), _whole(F.col(vector_col)).alias("whole"))
    return whole.where("whole IS NOT NULL")


def _lots(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), LOT):
            part = batch.slice(a, LOT)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows ``(cluster, n, sums)``, one for each task and centroid that some of its vectors are nearest to."""
    k = len(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        for _, whole in _lots(batches, 0):
            cluster, _ = search(whole, centroids)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, whole)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array(n[there], pa.int64()), pa.array(list(sums[there]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    return vectors.select("whole").mapInArrow(work, "cluster int, n bigint, sums array<bigint>")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    parts = _sums(vectors, centroids)
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def first_centroids(vectors: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The vectors of the least hashes of their ids, in that order; equal ids come in the order of components."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(hashed.alias("hash"), "whole").orderBy("hash", "whole").limit(count).collect()
    return np.array([r["whole"] for r in rows], dtype=np.int64).reshape(len(rows), WIDTH)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows ``(id, cluster, distance)`` for ``vectors(id, whole)``; a distance beyond 64 bits is null."""
    kind = vectors.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in _lots(batches, 1):
            cluster, distance = search(whole, centroids)
            fits = [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], names=["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select("id", "whole").mapInArrow(work, schema)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each kept vector.

    Vectors count that have 64 components, none null or not finite; beyond a size of 2^30 after scaling, where no
    long holds a distance, a vector is left out as well. Fewer than 16 vectors start as many centroids. Rows that
    repeat an id are vectors of their own, a null id is hashed as an empty one; other columns are not read; an
    empty table gives an empty one. Sums of distances that exceed a long are null.
    """
    whole = kept(vectors, id_col, vector_col)
    centroids = first_centroids(whole)
    if not len(centroids):
        nothing = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return whole.select(F.col("id").alias(id_col), *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    for _ in range(ROUNDS):
        centroids = moved(whole, centroids)
    done = written(assigned(whole, centroids))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    spread = {r["cluster"]: int(r["total"] or 0) for r in done.groupBy("cluster").agg(exact.alias("total")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    everything = long(sum(spread.values()))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(k, long(total), everything, hashes[k]) for k, total in sorted(spread.items())]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
