"""Near duplicates by b-bit MinHash: packed low bits of minima estimate similarity, full sets confirm it.

Words are lower-cased (A-Z) and a document's set holds its distinct windows of four words, or its whole word
sequence where it has fewer words. Documents with equal sets (128 bits of hash) are one set from here on.

1. A set has 128 MinHash values. Bands of four whole values name its nodes; of every value only the low `BITS` bits
   are kept, packed into 64-bit words. Two sets of similarity 0.8 share no node with probability
   (1 - 0.8**4)**32 = 5e-8.
2. Sets that share a node are candidates. Their signatures are compared by XOR and a count of bits: of the values
   that differ, one in 2**BITS agrees by accident, so a share e of agreeing values estimates a
   similarity of (e - c) / (1 - c) with c = 2**-BITS. Candidates below `estimate` are dropped; similarity 0.8 falls below 0.6
   with probability 1e-7. A node hands on a spanning forest of its candidates, never its pairs.
3. Connected candidates form a group, and all sets of a group are confirmed on their full sets: any two of them,
   whether they shared a node or not. Groups and nodes above `block` sets are dealt out as pairs of blocks, so no
   task holds more than two blocks. A task hands on a spanning forest of the confirmed links.

Components are those of confirmed links. Shingles are compared as 64-bit hashes.

Defined cases: a null, empty or white text has an empty set, no link and a component of its own; texts of one to three
words are linked with texts of the same words only; rows that repeat are linked with each other, and all rows
with the smallest id are kept; a null id never names a component if a document of it has an id
(else component_id is null, and such a row is kept); columns other than the id and the text are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import text_of, written
from panelmetrics.llm.components import connected_components
from panelmetrics.llm.lookups import filter_bits
from panelmetrics.llm.words import WordHashes, mixed, windows

WIDTH = 4
LEAST, OF = 80, 100  # OF * intersection >= LEAST * union
BANDS, DEPTH = 32, 4
BITS = 4
ESTIMATE = 0.6
BLOCK = 1024
FILTER_BITS = 24
SLICE = 2048
COLUMNS = 2048
ROWS = 256
LANES = np.uint64(0x1111111111111111)  # the lowest of every four bits


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct windows of four words, as numbers; all words as one window where there are fewer."""
    return np.unique(windows(words, min(WIDTH, len(words)))) if len(words) else words


def factors() -> np.ndarray:
    """Odd multipliers of the hash functions, from a fixed rule."""
    return mixed(np.arange(1001, 1001 + BANDS * DEPTH, dtype=np.uint64)) | np.uint64(1)


def minima(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(len(by), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), SLICE):
        piece = found[start : start + SLICE]
        np.minimum(least, (by[:, None] * piece[None, :]).min(axis=1), out=least)
    return mixed(least)


def band_nodes(values: np.ndarray) -> np.ndarray:
    """One number per band, from the whole values of the band."""
    held = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in values.reshape(BANDS, DEPTH).T:
        held = mixed(held + column)
    return held


def packed(values: np.ndarray) -> np.ndarray:
    """The low bits of the values, 64 / BITS of them in a word."""
    lanes = (values & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def estimated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row, corrected for values that agree by accident."""
    differ = left ^ right
    for shift in (1, 2):  # any of a lane's four bits sets its lowest
        differ = differ | (differ >> np.uint64(shift))
    count = left.shape[1] * (64 // BITS)
    agree = 1 - np.bitwise_count(differ & LANES).sum(axis=1, dtype=np.int64) / count
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def signed_documents(frame: DataFrame) -> DataFrame:
    """(doc_id, key, n, digest, nodes, signature) of rows (doc_id, key, text); nulls for an empty set."""

    def run(batches):
        hashes, by = WordHashes(), factors()
        for batch in batches:
            rows = []
            for words in hashes.of_texts(batch.column(2), lower=True):
                found = shingle_set(words)
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                values = minima(found, by)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((len(found), digest, band_nodes(values).tobytes(), packed(values).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([r[0] for r in rows], pa.int64()),
                    *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)],
                ],
                names=["doc_id", "key", "n", "digest", "nodes", "signature"],
            )

    return frame.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key binary, n long, digest binary, nodes binary, signature binary"
    )


def set_nodes(sets: DataFrame) -> DataFrame:
    """(id, node) of each set and band."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                nodes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                ids = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nodes)], names=["id", "node"])

    return sets.select("id", "nodes").mapInArrow(run, "id long, node long")


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Rows of groups of `many` sets once per pair of blocks they take part in: own, low, high are block numbers.

    A set's block follows from its id.
    """
    blocks = F.ceil(F.col("many") / block).cast("int")
    own: Column = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    return (
        members.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .drop("other", "many")
    )


def whole_groups(batches, keys: list[str], rows: int):
    """Tables of whole groups of adjacent rows with equal keys; `rows` is when a table is handed on."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        stop = group_starts(table, keys)[-1]
        if stop:
            yield table.slice(0, stop)
        held, size = table.slice(stop).to_batches(), table.num_rows - stop
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a group begins."""
    fresh = np.zeros(table.num_rows, dtype=bool)
    fresh[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (smallest connected index) after links left - right are added."""
    while True:
        low, high = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def candidate_links(members: DataFrame, estimate: float) -> DataFrame:
    """Spanning forest (a, b) of the sets that share a node and are similar by estimate."""

    def run(batches):
        for table in whole_groups(batches, ["node", "low", "high"], 16384):
            starts = group_starts(table, ["node", "low", "high"])
            group = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
            count = table.num_rows
            words = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u8").reshape(count, -1)
            at, shift, label = np.arange(count), 0, np.arange(count)
            while True:  # every set with the one `shift` places behind it, unless they are connected already
                shift += 1
                at = at[at + shift < count]
                at = at[group[at] == group[at + shift]]
                if not len(at):
                    break
                for start in range(0, len(at), 65536):
                    some = at[start : start + 65536]
                    some = some[label[some] != label[some + shift]]
                    hit = some[estimated(words[some], words[some + shift]) >= estimate]
                    label = merged(label, hit, hit + shift)
            edge = np.flatnonzero(label != np.arange(count))
            if len(edge):
                ids = table.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[edge]), pa.array(ids[label[edge]])], names=["a", "b"])

    keys = ["node", "low", "high"]
    dealt = members.select(*keys, "id", "signature").repartition(*keys)
    # by id inside a group, so that groups of the same sets hand on the same links
    return dealt.sortWithinPartitions(*keys, "id").mapInArrow(run, "a long, b long")


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of any two sets: marks of the shingles in two sets or more, multiplied slice by slice."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(every, return_inverse=True, return_counts=True)
    repeated = counts > 1
    number = np.cumsum(repeated) - 1
    keep = repeated[place]
    place, owner = number[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(repeated.sum()), COLUMNS):
        low, high = np.searchsorted(place, [start, start + COLUMNS])
        marks = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        marks[owner[low:high], place[low:high] - start] = 1
        common += marks @ marks.T
    return common


def confirmed(sets: list[np.ndarray], own: np.ndarray | None) -> np.ndarray:
    """Label of each set by the links among them; with block numbers `own`, links inside a block are left to its own task."""
    sizes, common, label = np.array([len(s) for s in sets]), common_sizes(sets), np.arange(len(sets))
    for start in range(0, len(sets), ROWS):
        some = slice(start, start + ROWS)
        both = common[some].astype(np.int64)
        linked = OF * both >= LEAST * (sizes[some, None] + sizes - both)
        if own is not None:
            linked &= own[some, None] != own
        left, right = np.nonzero(linked)
        label = merged(label, left + start, right)
    return label


def confirmed_links(members: DataFrame) -> DataFrame:
    """Spanning forest (a, b) of the links that full sets confirm, from rows (label, low, high, own, id, text)."""

    def run(batches):
        hashes, keys = WordHashes(), ["label", "low", "high"]
        for table in whole_groups(batches, keys, 512):
            starts = group_starts(table, keys)
            ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
            low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
            texts = table.column("text")
            for start, stop in zip(starts, [*starts[1:], table.num_rows]):
                if stop - start < 2:
                    continue
                sets = [shingle_set(words) for words in hashes.of_texts(texts.slice(start, stop - start), lower=True)]
                label = confirmed(sets, own[start:stop] if low[start] != high[start] else None)
                edge = np.flatnonzero(label != np.arange(stop - start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[edge + start]), pa.array(ids[label[edge] + start])], names=["a", "b"]
                )

    columns = ["label", "low", "high", "own", "id", "text"]
    dealt = members.select(*columns).repartition(*columns[:3]).sortWithinPartitions(*columns[:3], "id")
    return dealt.mapInArrow(run, "a long, b long")


def texts_of_keys(frame: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text): the text of each wanted key once. A bitmap of 2 MB keeps most other texts from being moved."""
    held = frame.sparkSession.sparkContext.broadcast(
        filter_bits(wanted.select(F.xxhash64("key").alias("fingerprint")), FILTER_BITS)
    )
    place = F.shiftrightunsigned(F.xxhash64("key"), 64 - FILTER_BITS)

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(hit) for i in (0, 1)], names=["key", "text"])

    likely = frame.select("key", "text", place.alias("place")).mapInArrow(run, "key binary, text string")
    return likely.groupBy("key").agg(F.first("text").alias("text"))  # copies of a text meet as one row per task


def near_components(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    estimate: float = ESTIMATE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    frame = documents.select(
        documents[id_column].cast("long").alias("doc_id"), text_of(documents, text_column).alias("text")
    ).withColumn("key", F.unhex(F.md5("text")))
    rows = written(signed_documents(frame), "signed")
    sets = written(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("key", "nodes", "signature")).alias("first"),
            F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(F.monotonically_increasing_id().alias("id"), "digest", "least_id", "copies", "first.*"),
        "sets",  # written once, so the ids stay
    )
    nodes = set_nodes(sets)
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = block_pairs(written(nodes.join(shared, "node"), "nodes"), block)
    likely = candidate_links(members.join(sets.select("id", "signature"), "id"), estimate)
    groups = written(connected_components(likely), "groups")
    # sizes from a written table: the join then deals both sides out anew, and a hot group can be split
    sized = groups.join(written(groups.groupBy("label").agg(F.count(F.lit(1)).alias("many")), "sizes"), "label")
    wanted = written(sized.join(sets.select("id", "key"), "id"), "wanted")
    texts = written(wanted.join(texts_of_keys(frame, wanted), "key"), "texts")
    classes = connected_components(confirmed_links(block_pairs(texts, block)))
    # sets whose component is more than one document; the others need no lookup
    placed = written(sets.select("id", "digest", "least_id", "copies").join(classes, "id", "left"), "placed")
    named = written(placed.where("label is not null").groupBy("label").agg(F.min("least_id").alias("named")), "named")
    known = placed.where("label is not null or copies > 1").join(named, "label", "left")
    alone = F.col("label").isNull()
    known = written(
        known.select("digest", F.when(alone, F.col("least_id")).otherwise(F.col("named")).alias("found"), F.lit(True).alias("many")),
        "known",
    )
    found = rows.select("doc_id", "n", "digest").join(known, "digest", "left")
    component = F.when(F.col("many"), F.col("found")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
