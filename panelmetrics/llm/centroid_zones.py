"""Centroid clustering over zone maps of a space-filling curve.

1. Vectors become whole numbers and get a place on a Hilbert curve through the box of all vectors. They
   are dealt out by ranges of (place, row), so a vector that a third of the rows repeat spreads over
   many tasks, and are written in that order as blocks of at most `block` vectors, each with the least and the
   greatest value of every dimension (its box).
2. In a round every block finds its candidates from the box alone: a centroid goes where its least distance to the
   box exceeds the greatest distance of another, or where every point of the box is nearer to the centroid
   of the least such bound. The vectors are compared with the candidates exactly.
3. A task sends one sum per centroid and dimension. Spark adds them up; the driver sees as
   many numbers as the centroids have.

A round reads the written blocks, and nothing but the sums is shuffled. Bounds and distances are whole numbers,
so the result is that of comparing every vector with every centroid.

Defined cases: vectors that are null, have another number of components than `width`, or hold a null or
non-finite component are left out; components whose scaled value lies beyond 2**24 are held there; rows
that repeat are vectors of their own; a null id comes last where centroids start, and rows of one id start in the order of
their vectors; fewer vectors than centroids give as many centroids; ties go to the smaller number; columns other than
the id and the vector are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import written
from panelmetrics.llm.vectors import (
    floored_means,
    matrix_of,
    squared_distances,
    sum_rows,
    usable,
    whole_numbers,
)

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
BLOCK = 256
CURVE_BITS = 2
MOST = (1 << 63) - 1


def hilbert_places(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of cells (whole numbers below 2**bits), as bytes in order.

    The reflections and exchanges that turn axes into the curve are done on all rows at once, from
    the highest bit down; then the bits of all axes are Gray-decoded and read across.
    """
    axes = cells.T.astype(np.uint32).copy()
    for bit in range(bits - 1, 0, -1):
        high, low = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for axis in axes:
            turned = (axis & high) != 0
            swap = np.where(turned, 0, (axes[0] ^ axis) & low).astype(np.uint32)
            axes[0] ^= np.where(turned, low, swap)
            axis ^= swap  # nothing for the first axis
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    turn = np.zeros(axes.shape[1], dtype=np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0))
    axes ^= turn
    across = [(axis >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1) for axis in axes]
    packed = np.packbits(np.stack(across, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def box_of_all(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest value of each dimension, from one row per task."""

    def run(batches):
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = matrix_of(batch.column(0), width)
            low = held.min(axis=0) if low is None else np.minimum(low, held.min(axis=0))
            high = held.max(axis=0) if high is None else np.maximum(high, held.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], names=["dim", "low", "high"]
            )

    bounds = vectors.select("vector").mapInArrow(run, "dim int, low long, high long")
    rows = bounds.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    return (np.array([r.low for r in rows]), np.array([r.high for r in rows])) if rows else None


def zone_blocks(vectors: DataFrame, low: np.ndarray, high: np.ndarray, block: int, bits: int) -> DataFrame:
    """(ids, matrix, low, high): blocks of vectors that lie next to each other on the curve."""
    width = len(low)
    span = np.maximum(high - low + 1, 1)

    def placed(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            held = matrix_of(batch.column(1), width)
            cells = ((held - low) << bits) // span
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r.tobytes() for r in held.astype(np.int32)], pa.binary()),
                    pa.array(hilbert_places(cells, bits), pa.binary()),
                    pa.array(np.full(count, part, np.int32)),
                    pa.array(np.arange(row, row + count)),
                ],
                names=["vec_id", "vector", "place", "part", "row"],
            )
            row += count

    def gathered(batches):
        ids, rows = [], []
        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(vec_id)
                rows.append(vector)
                if len(ids) == block:
                    yield boxed(ids, rows)
                    ids, rows = [], []
        if ids:
            yield boxed(ids, rows)

    def boxed(ids: list, rows: list[bytes]) -> pa.RecordBatch:
        matrix = b"".join(rows)
        held = np.frombuffer(matrix, np.int32).reshape(len(ids), width)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([matrix], pa.binary()),
                pa.array([held.min(axis=0).tobytes()], pa.binary()),
                pa.array([held.max(axis=0).tobytes()], pa.binary()),
            ],
            names=["ids", "matrix", "low", "high"],
        )

    order = ["place", "part", "row"]
    curve = vectors.select("vec_id", "vector").mapInArrow(
        placed, "vec_id long, vector binary, place binary, part int, row long"
    )
    near = curve.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "vector")
    return near.mapInArrow(gathered, "ids array<long>, matrix binary, low binary, high binary")


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, in order, of the centroids that can be nearest to a point of a box."""
    under, over = low - centroids, centroids - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=1)
    greatest = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=1)
    best = int(greatest.argmin())
    candidates = np.flatnonzero(least <= greatest[best])
    # |x-c|^2 - |x-best|^2 is linear in x, so its least value over the box is found per dimension
    other = centroids[candidates]
    slope = 2 * (centroids[best] - other)
    gap = (other**2 - centroids[best] ** 2 + np.minimum(slope * low, slope * high)).sum(axis=1)
    return candidates[gap <= 0]


def nearest(matrix: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector of a block."""
    candidates = box_candidates(low, high, centroids)
    distances = squared_distances(matrix, centroids[candidates])
    chosen = distances.argmin(axis=1)
    return candidates[chosen], distances[np.arange(len(matrix)), chosen]


def read_block(batch: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    matrix, low, high = (
        np.frombuffer(batch.column(n)[at].as_buffer(), np.int32).astype(np.int64) for n in ("matrix", "low", "high")
    )
    return matrix.reshape(-1, width), low, high


def moved_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty ones stay."""
    count, width = centroids.shape

    def run(batches):
        sums, counts = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                matrix, low, high = read_block(batch, at, width)
                chosen, _ = nearest(matrix, low, high, centroids)
                np.add.at(sums, chosen, matrix)
                counts += np.bincount(chosen, minlength=count)
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in sum_rows(sums, counts)], names=["cluster", "dim", "total", "n"]
            )

    sums = blocks.select("matrix", "low", "high").mapInArrow(run, "cluster int, dim int, total long, n long")
    moved = centroids.copy()
    for row in floored_means(sums, ["cluster"]):
        moved[row.cluster, row.dim] = row["mean"]
    return moved


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                matrix, low, high = read_block(batch, at, width)
                chosen, distance = nearest(matrix, low, high, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[at].values, pa.array(chosen.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    width: int = WIDTH,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    block: int = BLOCK,
    curve_bits: int = CURVE_BITS,
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    An inertia beyond a long is the largest long.
    """
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vector = vectors[vector_column]
    fitting = usable(vector) & (F.size(vector) == width)
    kept = vectors.where(fitting).select(
        vectors[id_column].cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("vector")
    )
    bounds = box_of_all(kept, width)
    if bounds is None:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = written(zone_blocks(kept, *bounds, block, curve_bits), "blocks")
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("vector", start.alias("start")).orderBy(F.asc_nulls_last("start"), "vector").limit(clusters)
    centroids = np.array([r.vector for r in first.collect()], dtype=np.int64)
    for _ in range(rounds):
        centroids = moved_centroids(blocks, centroids)
    rows = written(assigned(blocks, centroids), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    inertia = {r.cluster: int(r["sum"]) for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([min(inertia.get(i, 0), MOST) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), MOST)).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
