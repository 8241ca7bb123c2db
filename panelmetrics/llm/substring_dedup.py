"""Substring dedup: words of windows that also stand earlier are removed.

1. Recompression (see recompression.py) gives every window of 20 words an anchor: a symbol whose context lies
   inside the window, chosen alike in equal windows. One pass counts the anchors of all documents, those of a
   task first; anchors that stand twice or more are shared.
2. A second pass looks at the windows of shared anchors only. What repeats inside a chunk of a task is
   matched there; of every window, the first of the chunk goes to the owner of its anchor. Neighbouring windows of
   one anchor travel as one run (their hashes side by side). Windows of an anchor that stands more than `often` times
   travel one by one, to the owner of anchor and window, so a phrase that much of the corpus says in different
   surroundings spreads over all tasks, and no owner holds more than `often` runs. Owners match every window with the
   earliest of the equal ones.
3. Windows of one document that match the same earlier stretch become one match. Matches are then verified on the words:
   earlier stretches are read from their texts in cells of 32 words, each cell once, and compared word by word where
   they were matched. Hashes only propose matches; a match of unequal words loses the windows concerned.

The shared anchors and those that stand often reach the tasks as bitmaps, whose size is a parameter and not the
input's. They only decide which windows are compared at all, and how these travel; where they fill up, more windows
are compared and the result is the same.

Order: smaller doc_id first (null last), then the row key, then the start. Defined cases: a null text has
no words; texts of fewer than 20 words lose nothing; rows that repeat both id and text count as one
document (each is returned, and they do not remove each other's words); rows that repeat an id only are told
apart by their texts; columns other than the id and the text are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import text_of, written
from panelmetrics.llm.jaccard_join import row_key
from panelmetrics.llm.lookups import BITS, bitmap_place, filter_bits, key_bitmap, likely_rows, marked
from panelmetrics.llm.recompression import Anchors
from panelmetrics.llm.words import RUN_BYTES, WordHashes, text_runs

WIDTH = 20
ANCHOR_BITS = 27
OFTEN_BITS = 24
OFTEN = 4096
CELL = 32
CHUNK = 1 << 20
LAST = np.iinfo(np.int64).max
LOW = (1 << 32) - 1


def shared_anchors(frame: DataFrame, width: int) -> DataFrame:
    """(fingerprint, n): anchor keys that stand twice or more in the texts of (row, doc_id, text), and how often."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["fingerprint", "n"])

    def run(batches):
        numbers, anchors, held, size = WordHashes(), Anchors(width), [], 0
        for batch in batches:
            for _, texts in text_runs(batch.column(0), RUN_BYTES):
                _, _, keys, another = anchors(*numbers.of_many(texts))
                if not len(keys):
                    continue
                held.append(keys[another])  # neighbouring windows with one anchor are one occurrence of it
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    keys = frame.select("text").mapInArrow(run, "fingerprint long, n long")
    return keys.groupBy("fingerprint").agg(F.sum("n").alias("n")).where("n > 1")


def in_bits(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the top bits of the keys are marked."""
    place = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def fresh_rows(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return fresh


def first_rows(fresh: np.ndarray) -> np.ndarray:
    """Per row the place of the first row of its group."""
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


MATCH = "row long, start int, length int, first_row long, first_start int"


def fragments(row: np.ndarray, start: np.ndarray, first_row: np.ndarray, first_start: np.ndarray) -> list[pa.Array]:
    """Columns of MATCH: consecutive windows that match consecutive windows are one fragment."""
    shift = first_start - start
    order = np.lexsort((start, shift, first_row, row))
    row, start, first_row, first_start, shift = (c[order] for c in (row, start, first_row, first_start, shift))
    at = np.flatnonzero(fresh_rows(row, first_row, shift, start - np.arange(len(start))))
    length = start[np.r_[at[1:], len(start)][: len(at)] - 1] - start[at] + 1 if len(at) else at
    return [
        pa.array(row[at]),
        pa.array(start[at].astype(np.int32)),
        pa.array(length.astype(np.int32)),
        pa.array(first_row[at]),
        pa.array(first_start[at].astype(np.int32)),
    ]


WINDOWS = pa.schema(
    [
        ("owner", pa.int64()),
        ("hash", pa.int64()),
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("start", pa.int32()),
        ("hashes", pa.binary()),
        ("length", pa.int32()),
        ("first_row", pa.int64()),
        ("first_start", pa.int32()),
    ]
)


def window_batch(count: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of WINDOWS; columns left out are null."""
    arrays = [columns.get(f.name, pa.nulls(count, f.type)) for f in WINDOWS]
    return pa.RecordBatch.from_arrays(arrays, schema=WINDOWS)


class Chunk:
    """Windows of some documents of a task: anchor, hash, document, start."""

    def __init__(self):
        self.rows: list[tuple[int | None, int]] = []
        self.known: set[int] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def is_new(self, row: int) -> bool:
        """Whether a document is not here yet; a repeated row is the document that is already here."""
        if row in self.known:
            return False
        self.known.add(row)
        return True

    def add(self, rows: list[tuple[int | None, int]], at: np.ndarray, starts: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> None:
        """Windows of the documents `rows` (id, row), each with its place in that list."""
        self.parts.append((keys, hashes, at + len(self.rows), starts))
        self.rows.extend(rows)
        self.size += len(starts)

    def settled(self, often: np.ndarray, bits: int):
        """Batches of WINDOWS: matches inside the chunk (with a length), runs (with hashes), and single windows of
        anchors that stand often (with a hash)."""
        keys, hashes, at, starts = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order_of = sorted(range(len(self.rows)), key=lambda i: (self.rows[i][0] is None, self.rows[i][0] or 0, self.rows[i][1]))
        rank = np.empty(len(order_of), dtype=np.int64)
        rank[order_of] = np.arange(len(order_of))
        order = np.lexsort((rank[at] << 32 | starts, hashes, keys))
        keys, hashes, at, starts = keys[order], hashes[order], at[order], starts[order]
        documents = np.array([LAST if d is None else d for d, _ in self.rows], dtype=np.int64)
        rows = np.array([r for _, r in self.rows], dtype=np.int64)
        fresh = fresh_rows(keys, hashes)
        later, first = np.flatnonzero(~fresh), first_rows(fresh)[~fresh]
        if len(later):
            row, start, length, first_row, first_start = fragments(rows[at[later]], starts[later], rows[at[first]], starts[first])
            yield window_batch(len(row), owner=row, row=row, start=start, length=length, first_row=first_row, first_start=first_start)
        single = fresh & in_bits(often, keys, bits)
        for chosen, in_runs in ((np.flatnonzero(single), False), (np.flatnonzero(fresh & ~single), True)):
            if not len(chosen):
                continue
            columns = {}
            if in_runs:
                chosen = chosen[np.lexsort((starts[chosen], at[chosen]))]
                begin = np.flatnonzero(fresh_rows(at[chosen], keys[chosen], starts[chosen] - np.arange(len(chosen))))
                data, edges = hashes[chosen], np.r_[begin, len(chosen)].astype(np.int32) * 8
                columns["hashes"] = pa.Array.from_buffers(
                    pa.binary(), len(begin), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())]
                )
                chosen = chosen[begin]
            else:
                columns["hash"] = pa.array(hashes[chosen].view(np.int64))
            yield window_batch(
                len(chosen),
                owner=pa.array(keys[chosen].view(np.int64)),
                doc_id=pa.array(documents[at[chosen]]),
                row=pa.array(rows[at[chosen]]),
                start=pa.array(starts[chosen].astype(np.int32)),
                **columns,
            )


def likely_windows(frame: DataFrame, shared: Broadcast, often: Broadcast, width: int, bits: int, often_bits: int) -> DataFrame:
    """Windows of shared anchors, as rows of WINDOWS; see Chunk.settled."""

    def run(batches):
        held, many = (np.frombuffer(b.value, np.uint8) for b in (shared, often))
        numbers, anchors, chunk = WordHashes(), Anchors(width), Chunk()
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
            for first, texts in text_runs(batch.column(2), RUN_BYTES):
                new = [i for i in range(len(texts)) if chunk.is_new(rows[first + i][1])]
                words, edges = numbers.of_many([texts[i] for i in new])
                at, hashes, keys, _ = anchors(words, edges)
                hit = np.flatnonzero(in_bits(held, keys, bits))
                if len(hit):
                    of = np.searchsorted(edges, at[hit], side="right") - 1
                    chunk.add([rows[first + i] for i in new], of, at[hit] - edges[of], keys[hit], hashes[hit])
                if chunk.size >= CHUNK:
                    yield from chunk.settled(many, often_bits)
                    chunk = Chunk()
        if chunk.size:
            yield from chunk.settled(many, often_bits)

    return frame.select("row", "doc_id", "text").mapInArrow(
        run, "owner long, hash long, doc_id long, row long, start int, hashes binary, length int, first_row long, first_start int"
    )


def named_windows(windows: DataFrame) -> DataFrame:
    """Matches (MATCH) of windows that also stand earlier, from rows of WINDOWS.

    Rows of an owner lie side by side. Single windows come with equal ones next to each other, and only the first of
    them is held; runs are unrolled when their owner's rows are complete.
    """

    def matched(owner, hashes, row, start):
        """Fragments of windows that are in order, and the first window of the last group."""
        first = first_rows(fresh_rows(owner, hashes))
        # the first window of a group also comes from other chunks, where its row is repeated
        again = np.flatnonzero((row != row[first]) | (start != start[first]))
        found = fragments(row[again], start[again], row[first[again]], start[first[again]])
        return found, [column[first[-1:]] for column in (owner, hashes, row, start)]

    def unrolled(runs: pa.Table) -> list[pa.Array]:
        owner, doc_id, row, start = (runs.column(n).to_numpy().astype(np.int64) for n in ("owner", "doc_id", "row", "start"))
        count = pc.binary_length(runs.column("hashes")).to_numpy() // 8
        hashes = np.frombuffer(b"".join(runs.column("hashes").to_pylist()), np.int64)
        offset = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
        owner, doc_id, row, start = (np.repeat(c, count) for c in (owner, doc_id, row, start))
        start = start + offset
        order = np.lexsort((start, row, doc_id, hashes, owner))
        return matched(owner[order], hashes[order], row[order], start[order])[0]

    def run(batches):
        names = ["row", "start", "length", "first_row", "first_start"]
        held, waiting = [np.zeros(0, dtype=np.int64)] * 4, None
        for batch in batches:
            settled = batch.column("length").is_valid()
            if settled.true_count:
                yield batch.filter(settled).select(names)
            singles = batch.filter(batch.column("hash").is_valid())
            if singles.num_rows:
                new = (singles.column(n).to_numpy().astype(np.int64) for n in ("owner", "hash", "row", "start"))
                found, held = matched(*(np.concatenate(pair) for pair in zip(held, new, strict=True)))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays(found, names=names)
            runs = pa.Table.from_batches([batch.filter(batch.column("hashes").is_valid())])
            if not runs.num_rows:
                continue
            waiting = runs if waiting is None else pa.concat_tables([waiting, runs]).combine_chunks()
            owners = waiting.column("owner").to_numpy()
            stop = int(np.searchsorted(owners, owners[-1]))  # the last owner may go on in the next batch
            if stop:
                found = unrolled(waiting.slice(0, stop))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays(found, names=names)
                waiting = waiting.slice(stop)
        if waiting is not None and waiting.num_rows:
            found = unrolled(waiting)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays(found, names=names)

    dealt = windows.repartition("owner", "hash").sortWithinPartitions("owner", "hash", "doc_id", "row", "start")
    return dealt.mapInArrow(run, MATCH)


def whole_matches(named: DataFrame) -> DataFrame:
    """Matches as long as they go: (row, start, length, first_row, shift), shift being first_start - start.

    Fragments come from many owners; those of one document and one earlier document meet sorted.
    """

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            row, first_row, shift, start, length = new if held is None else (np.r_[h, n] for h, n in zip(held, new, strict=True))
            group = fresh_rows(row, first_row, shift)
            stop = np.maximum.accumulate(start + length + (np.cumsum(group) << 32))
            at = np.flatnonzero(group | np.r_[True, start[1:] > (stop[:-1] & LOW)])
            ends = stop[np.r_[at[1:], len(start)] - 1] & LOW
            merged = [row[at], first_row[at], shift[at], start[at], ends - start[at]]
            held = [c[-1:] for c in merged]  # the last one may go on in the next batch
            if len(at) > 1:
                yield packed([c[:-1] for c in merged])
        if held is not None:
            yield packed(held)

    def packed(columns) -> pa.RecordBatch:
        row, first_row, shift, start, length = columns
        narrow = (pa.array(c.astype(np.int32)) for c in (shift, start, length))
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(first_row), *narrow], names=columns_of)

    columns_of = ["row", "first_row", "shift", "start", "length"]
    shifted = named.select("row", "first_row", (F.col("first_start") - F.col("start")).alias("shift"), "start", "length")
    dealt = shifted.repartition("row").sortWithinPartitions(*columns_of[:4])
    return dealt.mapInArrow(run, "row long, first_row long, shift int, start int, length int")


def cells_of(width: int) -> Column:
    """Cells of the earlier document that a match covers."""
    first = F.col("start") + F.col("shift")
    return F.sequence(F.floor(first / CELL), F.floor((first + F.col("length") + (width - 2)) / CELL))


def earlier_words(matches: DataFrame, frame: DataFrame, width: int) -> DataFrame:
    """(row, named): per document its matches with the words of the earlier stretches, cell by cell.

    named is a list of (start, length, first_row, shift, cell, words). A cell is read from its text once, however many
    documents match it, and joined to them by (first_row, cell), where a hot cell can be split.
    """
    each = matches.withColumn("cell", F.explode(cells_of(width)))
    asked = each.select("first_row", "cell").distinct().groupBy("first_row")
    wanted = written(asked.agg(F.sort_array(F.collect_list("cell")).alias("cells")).withColumnRenamed("first_row", "row"), "cells")
    likely = likely_rows(frame.select("row", "text"), key_bitmap(wanted, "row"), "row")
    texts = likely.groupBy("row").agg(F.first("text").alias("text"))  # repeated rows meet as one row per task

    def run(batches):
        for batch in batches:
            for row, text, cells in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                said = [b" ".join(words[c * CELL : (c + 1) * CELL]) for c in cells]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(cells)), pa.array(cells, pa.int64()), pa.array(said, pa.binary())],
                    names=["first_row", "cell", "words"],
                )

    cells = wanted.join(texts, "row").select("row", "text", "cells").mapInArrow(run, "first_row long, cell long, words binary")
    proof = F.struct("start", "length", "first_row", "shift", "cell", "words")
    return each.join(cells, ["first_row", "cell"]).groupBy("row").agg(F.collect_list(proof).alias("named"))


def proofs_of(named: pa.ListArray) -> list[list[tuple]]:
    """Per document its proofs: tuples (start, length, first_row, shift, cell, words)."""
    rows = list(zip(*(c.to_pylist() for c in named.flatten().flatten()), strict=True))
    edges = np.cumsum(np.r_[0, pc.list_value_length(named).fill_null(0).to_numpy()]).tolist()
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def verified_stretches(words: list[bytes], proofs: list[tuple], width: int) -> list[tuple[int, int]]:
    """Stretches of words (first, end) in windows whose words are those of the earlier stretch, in order."""
    matches: dict[tuple, list[tuple[int, int, bool]]] = {}
    for start, length, first_row, shift, cell, said in proofs:
        low = cell * CELL
        first, end = max(start + shift, low), min(start + shift + length + width - 1, low + CELL)
        if end - first == CELL:
            equal = b" ".join(words[first - shift : end - shift]) == said
        else:
            equal = words[first - shift : end - shift] == said.split(b" ")[first - low : end - low]
        matches.setdefault((start, length, first_row, shift), []).append((first - shift, end - shift, equal))
    found = []
    for (start, length, _, _), cells in matches.items():
        if all(equal for _, _, equal in cells):
            found.append((start, start + length + width - 1))
            continue
        begin = start
        for first, end, equal in [*sorted(cells), (start + length + width - 1, 0, False)]:
            if not equal:  # windows that reach into an unequal cell are not verified
                if first - begin >= width:
                    found.append((begin, first))
                begin = end
    return sorted(found)


def without_stretches(text: bytes, proofs: list[tuple], width: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    words = kept = text.split()
    if proofs:
        kept, at = [], 0
        for first, end in verified_stretches(words, proofs, width):
            kept += words[at:first]
            at = max(at, end)
        kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    bits: int = ANCHOR_BITS,
    often: int = OFTEN,
    often_bits: int = OFTEN_BITS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    `bits` and `often_bits` size the bitmaps of shared anchors and of those that stand more than `often` times.
    """
    frame = documents.select(
        documents[id_column].cast("long").alias("doc_id"), text_of(documents, text_column).alias("text")
    )
    frame = frame.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    context = frame.sparkSession.sparkContext
    anchors = written(shared_anchors(frame, width), "anchors")
    shared = context.broadcast(filter_bits(anchors, bits))
    many = context.broadcast(filter_bits(anchors.where(F.col("n") > often), often_bits))
    named = named_windows(likely_windows(frame, shared, many, width, bits, often_bits))
    matches = written(whole_matches(named), "matches")
    lists = written(earlier_words(matches, frame, width), "lists")
    bitmap = key_bitmap(lists, "row")

    def cut(ids: pa.Array, texts: pa.Array, proofs: list) -> pa.RecordBatch:
        rows = [without_stretches(t.as_buffer().to_pybytes(), p, width) for t, p in zip(texts, proofs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    def whole(batches):
        for batch in batches:
            free = batch.filter(pa.array(~marked(bitmap, batch.column(2))))
            yield cut(free.column(0), free.column(1), [[]] * free.num_rows)

    def listed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                yield cut(piece.column(0), piece.column(1), proofs_of(piece.column(2)))

    schema = "doc_id long, n_words long, n_removed long, kept string"
    alone = frame.select("doc_id", "text", bitmap_place("row", BITS).alias("place")).mapInArrow(whole, schema)
    looked_up = likely_rows(frame, bitmap, "row").join(lists.hint("merge"), "row", "left")
    return alone.unionByName(looked_up.select("doc_id", "text", "named").mapInArrow(listed, schema))
