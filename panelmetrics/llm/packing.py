"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length. How many pieces of each
length there are is a table bounded by that length, whatever the corpus; best-fit decreasing
runs over this table rather than over pieces, on groups of bins with equal contents:

* pieces of a length go to the open bins with the least room that holds them;
* for what is left, bins of the permitted size are opened that cost least per word, when the rest
  of the bin is thought to be filled by the largest shorter pieces that are still to come;
* in the end every bin is downsized to the smallest permitted size that holds its contents.

The plan is a list of placements (ranks of a length to bins), again bounded by the largest length.
Pieces get their rank within their length from salted windows, so a length that a third of the
pieces share is numbered by many tasks, and look their place up in the plan, which is broadcast.

Defined cases: a null text or one without words has one row of 0 words and no bin; rows that repeat are
documents of their own; ties (pieces of one length) are ordered by a hash of the id, then the id (null
first), then the row; other columns are not read by pack() . An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmetrics.llm.common import WHITE, WORD, default_partitions, text_of, written

SIZES = (512, 1024, 2048, 4096)
OVERHEAD = 64


def linear_cost(size: int) -> float:
    """Cost of a sequence: its words and a fixed part."""
    return size + OVERHEAD


class Plan:
    """Best-fit decreasing over counts of lengths.

    `placements` rows: length, first rank, bins, pieces per bin, first bin, offset in the bin.
    Bins are numbered in runs; `sizes` rows: first bin of a run, words in each bin of it.
    """

    def __init__(self, counts: dict[int, int], sizes: tuple[int, ...], cost: Callable[[int], float] = linear_cost):
        self.sizes, self.cost = sorted(sizes), cost
        self.counts = {length: n for length, n in counts.items() if n and length}
        self.lengths = sorted(self.counts)
        self.rooms: list[int] = []  # room of open bins, ascending
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, words used)
        self.placements: list[tuple[int, int, int, int, int, int]] = []
        self.contents: list[tuple[int, int, int]] = []
        self.next_bin = 0
        for length in reversed(self.lengths):
            self.place(length)
        for runs in self.open.values():
            self.contents.extend(runs)
        self.contents.sort()

    def keep(self, room: int, first: int, bins: int, used: int) -> None:
        if not room:
            self.contents.append((first, bins, used))
            return
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((first, bins, used))

    def fill(self, length: int, rank: int, room: int, run: tuple[int, int, int], left: int) -> int:
        """Put up to `left` pieces into a run of bins with equal room; how many went in."""
        first, bins, used = run
        each = room // length
        whole = min(bins, left // each)
        if whole:
            self.placements.append((length, rank, whole, each, first, used))
            self.keep(room - each * length, first, whole, used + each * length)
        placed, first, bins = whole * each, first + whole, bins - whole
        if bins and left > placed:
            rest = left - placed
            self.placements.append((length, rank + placed, 1, rest, first, used))
            self.keep(room - rest * length, first, 1, used + rest * length)
            placed, first, bins = left, first + 1, bins - 1
        if bins:
            self.keep(room, first, bins, used)
        return placed

    def place(self, length: int) -> None:
        left, rank = self.counts[length], 0
        while left:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                break
            room = self.rooms.pop(at)
            runs = self.open.pop(room)
            while runs and left:
                went = self.fill(length, rank, room, runs.pop(0), left)
                rank, left = rank + went, left - went
            for run in runs:
                self.keep(room, *run)
        if left:
            size = self.cheapest(length, left)
            each = size // length
            bins = -(-left // each)
            run = (self.next_bin, bins, 0)
            self.next_bin += bins
            self.fill(length, rank, size, run, left)

    def cheapest(self, length: int, left: int) -> int:
        """The permitted size that costs least per word it is thought to hold; the larger one of two."""
        at = bisect_left(self.lengths, length)

        def per_word(size: int) -> tuple[float, int]:
            held = min(left, size // length) * length
            stop = at
            while stop and size - held >= self.lengths[0]:
                stop = bisect_left(self.lengths, min(size - held, self.lengths[stop - 1]) + 1, 0, stop) - 1
                if stop < 0:
                    break
                shorter = self.lengths[stop]
                held += min(self.counts[shorter], (size - held) // shorter) * shorter
            return self.cost(size) / held, -size

        return min((s for s in self.sizes if s >= length), key=per_word)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Placements by (length, first rank), and per run of bins: first bin, final size."""
        placements = np.array(sorted(self.placements), dtype=np.int64).reshape(-1, 6)
        final = [(first, self.sizes[bisect_left(self.sizes, used)]) for first, _, used in self.contents]
        return placements, np.array(final, dtype=np.int64).reshape(-1, 2)


def looked_up(placements: np.ndarray, final: np.ndarray, lengths: np.ndarray, ranks: np.ndarray):
    """Bin, size of the bin and offset in it, for pieces given by length and rank."""
    keys = placements[:, 0] << 44 | placements[:, 1]
    row = placements[np.searchsorted(keys, lengths << 44 | ranks, side="right") - 1]
    within = ranks - row[:, 1]
    bins = row[:, 4] + within // row[:, 3]
    offsets = row[:, 5] + within % row[:, 3] * lengths
    sizes = final[np.searchsorted(final[:, 0], bins, side="right") - 1, 1]
    return bins, sizes, offsets


def place_pieces(rows: DataFrame, sizes: tuple[int, ...], cost: Callable[[int], float]) -> DataFrame:
    """(key, doc_id, piece, start, n_words, bin_id, capacity, place) from stable rows (key, doc_id, n_words)."""
    most = max(sizes)
    salts = default_partitions(rows)
    last = F.greatest(F.ceil(F.col("n_words") / most) - 1, F.lit(0)).cast("int")
    pieces = (
        rows.select("key", "doc_id", "n_words", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .withColumn("start", F.col("piece").cast("long") * most)
        .withColumn("n_words", F.least(F.col("n_words") - F.col("start"), F.lit(most)).cast("long"))
        .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    )
    counted = written(pieces.groupBy("n_words", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counted.groupBy("n_words").agg(F.sum("n").alias("n")).collect()  # at most one row per length
    plan = Plan({r["n_words"]: r["n"] for r in totals}, sizes, cost)
    placements, final = plan.arrays()
    earlier = Window.partitionBy("n_words").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    in_salt = Window.partitionBy("n_words", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "key", "piece")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(in_salt) - 1)
        .join(offsets, ["n_words", "salt"])
        .select("key", "doc_id", "piece", "start", "n_words", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    )
    shared = rows.sparkSession.sparkContext.broadcast((placements, final))

    def run(batches):
        table, ends = shared.value
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (4, 5))
            filled = lengths > 0
            found = [np.zeros(len(lengths), np.int64) for _ in range(3)]
            if filled.any():
                for held, values in zip(found, looked_up(table, ends, lengths[filled], ranks[filled]), strict=True):
                    held[filled] = values
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *[pa.array(f, pa.int64(), mask=~filled) for f in found]],
                names=["key", "doc_id", "piece", "start", "n_words", "bin_id", "capacity", "place"],
            )

    return ranked.mapInArrow(
        run,
        "key long, doc_id long, piece int, start long, n_words long, bin_id long, capacity long, place long",
    )


def pack(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sizes: tuple[int, ...] = SIZES,
    cost: Callable[[int], float] = linear_cost,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_words, bin_id, capacity, place (offset in the bin)."""
    rows = documents.select(
        documents[id_column].cast("long").alias("doc_id"),
        F.regexp_count(text_of(documents, text_column), F.lit(WORD)).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("key"),
    )
    return place_pieces(written(rows, "lengths"), sizes, cost).drop("key")


def pack_texts(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sizes: tuple[int, ...] = SIZES,
    cost: Callable[[int], float] = linear_cost,
) -> DataFrame:
    """The rows of pack() with the words of each piece, joined by single spaces, as `text`."""
    text = text_of(documents, text_column)
    rows = written(
        documents.select(
            documents[id_column].cast("long").alias("doc_id"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
            text.alias("text"),
            F.monotonically_increasing_id().alias("key"),
        ),
        "packed",
    )
    placed = place_pieces(rows.select("key", "doc_id", "n_words"), sizes, cost)
    words = F.array_remove(F.split("text", f"[{WHITE}]+"), "")
    piece = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    return (
        placed.join(rows.select("key", "text"), "key")  # texts move whole: arrays of words are twice their size
        .withColumn("words", words)
        .withColumn("text", piece)
        .select("doc_id", "piece", "start", "n_words", "bin_id", "capacity", "place", "text")
    )
