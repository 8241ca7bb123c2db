"""Vector code compression: product codes, nearest entries found by slices of bitmasks.

A vector is cut into equal consecutive parts, and each part is replaced by the number of the nearest entry of
its position's codebook. Codebooks are moved to the means of their parts in a fixed number of rounds.

Nearest entries are found by slice and intersect. The coordinates of the entries are sorted per dimension, and every
place in that order carries the mask of the entries before it (uint64 words). For a part and a radius, two
searches per dimension give a slice; the masks at its ends differ by the entries within the radius in that
dimension, and the masks of all dimensions ANDed leave the candidates, whose distances are
computed exactly. The entries next to the part in each dimension bound the answer; the initial radius is a share
of that bound. A part whose best candidate lies within the radius is settled, the others
take the bound as their radius, which holds the answer always.

A round reads the written parts; a task sends one sum per entry and dimension it met, and codebooks (a size fixed by
the parameters) go to the tasks and come back as sums. Vectors are never shuffled; only the last sum by label is.

Defined cases: vectors that are null or hold a null or non-finite component are left out. Vectors whose length
differs from that of the kept vector with the smallest id, or that can't be cut into equal parts, have a null code
and error and belong to no codebook; label_error counts them as 0. Components beyond 2**24 after scaling are held there. Rows that
repeat are vectors of their own; a null id comes last where codebooks start, and rows of one id start in the order of
their vectors; ties go to the smaller entry; fewer vectors than entries give as many entries; null labels are one
label; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import written
from panelmetrics.llm.vectors import floored_means, matrix_of, sum_rows, usable, whole_numbers

PARTS = 4
SCALE = 1024
ENTRIES = 256
ROUNDS = 4
INITIAL = 0.5
POINTS = 1024


class SliceMasks:
    """Entries of one codebook: per dimension their sorted coordinates, each with the mask of those before it."""

    def __init__(self, entries: np.ndarray):
        count, self.width = entries.shape
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order.T
        self.sorted = np.take_along_axis(entries, order, axis=0).T
        words = -(-count // 64)
        own = np.zeros((count, words), dtype="<u8")
        at = np.arange(count)
        own[at, at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
        self.before = np.zeros((self.width, count + 1, words), dtype="<u8")
        for dim in range(self.width):
            self.before[dim, 1:] = np.bitwise_or.accumulate(own[self.order[dim]], axis=0)

    def within(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries whose every coordinate lies within the radius of the point's."""
        found = None
        for dim in range(self.width):
            low = np.searchsorted(self.sorted[dim], points[:, dim] - radius, side="left")
            high = np.searchsorted(self.sorted[dim], points[:, dim] + radius, side="right")
            between = self.before[dim, high] ^ self.before[dim, low]
            found = between if found is None else found & between
        return found

    def bound(self, points: np.ndarray) -> np.ndarray:
        """A squared distance that some entry keeps: the best of those next to the point in each dimension."""
        best = None
        for dim in range(self.width):
            at = np.searchsorted(self.sorted[dim], points[:, dim]).clip(max=len(self.entries) - 1)
            there = ((points - self.entries[self.order[dim, at]]) ** 2).sum(axis=1)
            best = there if best is None else np.minimum(best, there)
        return best

    def best_within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest candidate (-1: none) and its squared distance; the smaller entry of equal ones."""
        masks = self.within(points, radius)
        marks = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)]
        row, entry = np.nonzero(marks)
        chosen = np.full(len(points), -1, dtype=np.int64)
        least = np.full(len(points), np.iinfo(np.int64).max, dtype=np.int64)
        if len(row):
            distance = ((points[row] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            least[row[first]] = np.minimum.reduceat(distance, first)
            equal = np.flatnonzero(distance == least[row])[::-1]
            chosen[row[equal]] = entry[equal]  # the last write is the smallest entry
        return chosen, least

    def nearest(self, points: np.ndarray, initial: float) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each point."""
        chosen, least = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for start in range(0, len(points), POINTS):
            some = points[start : start + POINTS]
            bound = self.bound(some)
            radius = np.ceil(np.sqrt(bound) * initial).astype(np.int64)
            number, distance = self.best_within(some, radius)
            left = np.flatnonzero((number < 0) | (distance > radius * radius))
            if len(left):
                reach = np.ceil(np.sqrt(np.minimum(bound, distance)[left])).astype(np.int64) + 1
                number[left], distance[left] = self.best_within(some[left], reach)
            chosen[start : start + POINTS], least[start : start + POINTS] = number, distance
        return chosen, least


def parts_of(batch: pa.RecordBatch, parts: int, width: int) -> list[np.ndarray]:
    """The vectors of a batch, one matrix per part position."""
    held = matrix_of(batch.column("vector"), parts * width)
    return [held[:, i * width : (i + 1) * width] for i in range(parts)]


def moved_codebooks(vectors: DataFrame, codebooks: np.ndarray, initial: float) -> np.ndarray:
    """Codebooks (part, entry, dimension) after one round; unused entries stay."""
    parts, count, width = codebooks.shape

    def run(batches):
        searches = [SliceMasks(c) for c in codebooks]
        sums, counts = np.zeros((parts * count, width), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            for part, points in enumerate(parts_of(batch, parts, width)):
                chosen = searches[part].nearest(points, initial)[0] + part * count
                np.add.at(sums, chosen, points)
                counts += np.bincount(chosen, minlength=len(counts))
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in sum_rows(sums, counts)], names=["entry", "dim", "total", "n"]
            )

    sums = vectors.select("vector").mapInArrow(run, "entry int, dim int, total long, n long")
    moved = codebooks.reshape(parts * count, width).copy()
    for row in floored_means(sums, ["entry"]):
        moved[row.entry, row.dim] = row["mean"]
    return moved.reshape(codebooks.shape)


def coded(vectors: DataFrame, codebooks: np.ndarray, initial: float) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts, _, width = codebooks.shape

    def run(batches):
        searches = [SliceMasks(c) for c in codebooks]
        for batch in batches:
            found = [searches[i].nearest(points, initial) for i, points in enumerate(parts_of(batch, parts, width))]
            numbers = np.stack([chosen for chosen, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([row.tobytes().hex() for row in numbers], pa.string()),
                    pa.array(error, pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    scale: int = SCALE,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    initial: float = INITIAL,
) -> DataFrame:
    """One row per kept vector: vec_id, label, code, error, label_error, codebooks_sha256.

    `entries` is 256 at most (a code has two hex digits per part); `initial` is the first radius as a share of the bound.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = vectors.where(usable(vectors[vector_column])).select(
        vectors[id_column].cast("long").alias("vec_id"),
        vectors[label_column].alias("label"),
        whole_numbers(vectors[vector_column], scale).alias("vector"),
    )
    first = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    size = len(first[0].vector) if first else 0
    width, rest = divmod(size, parts)
    fits = (F.size("vector") == size) if width and not rest else F.lit(False)
    # written in list form, so that the rounds read numbers and not the source
    held = written(kept.where(fits), "vectors")
    starts = held.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    if starts:
        begun = np.array([r.vector for r in starts], dtype=np.int64)
        codebooks = np.ascontiguousarray(begun.reshape(len(starts), parts, width).transpose(1, 0, 2))
        for _ in range(rounds):
            codebooks = moved_codebooks(held, codebooks, initial)
        rows = coded(held, codebooks, initial)
        digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    else:
        rows = held.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        digest = hashlib.sha256(b"").hexdigest()
    others = kept.where(~fits).select("vec_id", "label", F.lit(None).alias("code"), F.lit(None).alias("error"))
    rows = written(rows.unionByName(others), "codes")
    total = F.least(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)), F.lit((1 << 63) - 1)).cast("long")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    return rows.join(written(by_label, "labels"), same).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
