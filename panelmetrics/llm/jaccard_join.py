"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Shingles are windows of five words. Documents with equal shingle sets are one set from here on.

1. A set has 128 MinHash values. Each of 32 trees reads them as a sequence that begins at its own four values and goes
   on with those of the trees behind it. Sets that agree in the first `depth` values of a tree share a node.
   `depth` follows from the target recall: it is the longest prefix at which two sets of similarity 0.8 part in
   all trees with probability (1 - 0.8**depth)**32 <= 1e-6, which is four values (5e-8).
2. Inside a node, sets are sorted by the values behind the prefix (one byte of each), so that sets which agree in
   a longer prefix lie side by side: a sorted prefix trie. Prefixes are matched at their longest first and then
   shortened value by value down to the node's own; at each step the subtrees that meet there are compared, and sets
   that a longer prefix has connected already are not compared again.
3. Sets are compared by 128 one-byte values; those below `pruned` agreement
   are no candidates (similarity 0.8 falls below it with probability 1e-8). What is left joins sets to
   groups, by connected components.
4. In a group all pairs of sets are verified on their shingles, whether a tree brought them together or not. A group
   moves each text once; nodes and groups above `block` sets are dealt out as pairs of blocks, so no task holds
   more than two blocks. Only the number of links and a spanning forest of them leave the task, never the pairs.

The trees are probabilistic: recall is 1 - 6e-8 for a pair of similarity 0.8 exactly, and more above. Of all pairs of
the 1,000 documents at sf0.01 and of the 10,000 at sf0.1 none is lost (`tests/llm/test_dedup.py` compares the former).

Classes are the components of verified links. Shingles are compared as 64-bit hashes.

Defined cases: a null text is empty; a document of fewer than five words has no shingle, no link and a class of its
own; repeated rows and copies count as linked documents; a null id never names a class if
another document of the class has an id (else class_id is null); columns other than the id and
the text are not read by similar_documents(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import nested, text_of, written
from panelmetrics.llm.components import connected_components
from panelmetrics.llm.lookups import filter_bits
from panelmetrics.llm.words import WordHashes, mixed, windows

WIDTH = 5
THRESHOLD = 0.8
TREES, VALUES = 32, 128
TARGET_MISS = 1e-6
PRUNED = 0.6
BLOCK = 1024
COLUMNS = 4096
FILTER_BITS = 24


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return np.unique(windows(words, WIDTH))


def minhash_factors() -> np.ndarray:
    """Odd multipliers, from a fixed rule."""
    return mixed(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def minhashes(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash over a shingle set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), 2048):
        piece = found[start : start + 2048]
        np.minimum(least, (factors[:, None] * piece[None, :]).min(axis=1), out=least)
    return mixed(least)


def depth_for(miss: float, similarity: float = THRESHOLD) -> int:
    """The longest prefix at which two sets of a similarity part in all trees with probability `miss` at most."""
    depths = range(1, VALUES + 1)
    return max((d for d in depths if (1 - similarity**d) ** TREES <= miss), default=1)


def tree_starts() -> np.ndarray:
    """Where the sequence of each tree begins among the values; it goes on around the end."""
    return np.arange(TREES) * (VALUES // TREES)


def prefixes(values: np.ndarray, depth: int) -> np.ndarray:
    """Per tree: a number of the first `depth` values of its sequence."""
    held = np.arange(TREES, dtype=np.uint64)
    for shift in range(depth):
        held = mixed(held + values[(tree_starts() + shift) % VALUES])
    return held


def signatures(frame: DataFrame, depth: int) -> DataFrame:
    """(key, doc_id, digest, nodes, bytes) of each row (key, doc_id, text); nulls without a shingle."""

    def run(batches):
        hashes, factors = WordHashes(), minhash_factors()
        for batch in batches:
            rows = []
            for words in hashes.of_texts(batch.column(2)):
                found = shingles(words)
                if not len(found):
                    rows.append((None, None, None))
                    continue
                values = minhashes(found, factors)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((digest, prefixes(values, depth).tobytes(), (values & np.uint64(255)).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]],
                names=["key", "doc_id", "digest", "nodes", "bytes"],
            )

    return frame.mapInArrow(run, "key long, doc_id long, digest binary, nodes binary, bytes binary")


def tree_nodes(sets: DataFrame) -> DataFrame:
    """(id, tree, node) of each set and tree."""

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            nodes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), TREES)),
                    pa.array(np.tile(np.arange(TREES, dtype=np.int8), count)),
                    pa.array(nodes),
                ],
                names=["id", "tree", "node"],
            )

    return sets.select("id", "nodes").mapInArrow(run, "id long, tree byte, node long")


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """Rows whose node holds two sets or more, with their number."""
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.join(counts, "node")


def dealt_blocks(members: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of groups (id, n, ...) once per pair of blocks: own, low, high are block numbers."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    other: Column = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("blocks", "other", "n")
    )


def by_group(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group side by side in one partition."""
    return frame.repartition(*keys).sortWithinPartitions(*keys)


def forest(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """Smallest index that each of `count` indices reaches over the edges."""
    label = np.arange(count)
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    return label


def group_slices(batches, keys: int, rows: int = 16384):
    """Tables of whole groups; the first `keys` columns name a group. Rows of a group are adjacent."""
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
        names = [table.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([n == n[-1] for n in names])
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield table.slice(0, start)
        held, size = table.slice(start).to_batches(), table.num_rows - start
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(table: pa.Table, keys: int) -> np.ndarray:
    """A number per row that is equal within a group and grows by one from group to group."""
    names = [table.column(i).to_numpy() for i in range(keys)]
    change = np.logical_or.reduce([n[1:] != n[:-1] for n in names])
    return np.concatenate([[0], np.cumsum(change)])


def joined_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (smallest connected index) after links left - right are added."""
    while True:
        low, high = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def connected_by_trie(values: np.ndarray, group: np.ndarray, pruned: float) -> np.ndarray:
    """Label of each row by likely links inside its group.

    Rows hold their values in the order of their tree and lie in the order of the trie: by group, then by values.
    Subtrees are compared from the longest common prefix to the shortest. At a prefix, the rows of a subtree meet
    all rows behind it that share the prefix: neighbours between them share it, too.
    """
    count = len(values)
    same = values[1:] == values[:-1]
    shared = np.r_[-1, np.where(same.all(axis=1), values.shape[1], same.argmin(axis=1))]
    shared[np.flatnonzero(group[1:] != group[:-1]) + 1] = -1
    label = last = np.arange(count)  # last: the last row of the subtree that a row is in so far
    for depth in sorted(set(shared.tolist()) - {-1}, reverse=True):
        first = np.flatnonzero(shared < depth)
        compared, last = last, np.repeat(np.r_[first[1:], count] - 1, np.diff(np.r_[first, count]))
        at = np.flatnonzero(last > compared)
        other = compared[at] + 1
        while len(at):
            for start in range(0, len(at), 65536):
                some, with_ = at[start : start + 65536], other[start : start + 65536]
                apart = label[some] != label[with_]
                some, with_ = some[apart], with_[apart]
                agree = (values[some] == values[with_]).mean(axis=1) >= pruned
                label = joined_labels(label, some[agree], with_[agree])
            going = other < last[at]
            at, other = at[going], other[going] + 1
    return label


def likely_edges(members: DataFrame, pruned: float) -> DataFrame:
    """Spanning edges (a, b) of the sets in a node whose one-byte values agree often enough."""

    def run(batches):
        for table in group_slices(batches, 3):
            group, ids = group_numbers(table, 3), table.column("id").to_numpy()
            values = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(len(ids), -1)
            starts = tree_starts()[table.column("tree").to_numpy()]
            turned = np.take_along_axis(values, (starts[:, None] + np.arange(VALUES)) % VALUES, axis=1)
            order = np.lexsort([*turned.T[::-1], group])
            ids = ids[order]
            label = connected_by_trie(turned[order], group[order], pruned)
            # the root of a group is its smallest id, so that nodes of the same sets agree on few edges
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            edge = np.flatnonzero(least[label] != ids)
            if len(edge):
                edges = np.unique(np.stack([ids[edge], least[label[edge]]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    grouped = members.select("node", "low", "high", "id", "tree", "bytes").repartition("node", "low", "high")
    return grouped.sortWithinPartitions("node", "low", "high").mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of shingle sets."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[place] > 1
    place, owner = shared[place[keep]], owner[keep]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        low, high = np.searchsorted(place, [start, start + COLUMNS])
        marks = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        marks[owner[low:high], place[low:high] - start] = 1
        common += marks @ marks.T
    return common.astype(np.int64)


def verified_links(members: DataFrame) -> DataFrame:
    """(id, links, root) from rows (label, low, high, id, own, copies, text) of groups dealt out in blocks.

    links counts documents of other sets; root is a set that a chain of links in the task leads to.
    """

    def run(batches):
        hashes = WordHashes()
        for table in group_slices(batches, 3, rows=512):
            group = group_numbers(table, 3)
            low, high, ids, own, copies = (
                table.column(n).to_numpy() for n in ("low", "high", "id", "own", "copies")
            )
            found = [shingles(words) for words in hashes.of_texts(table.column("text"))]
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for start, stop in zip(edges, edges[1:]):
                some = slice(start, stop)
                sets = found[start:stop]
                sizes = np.array([len(s) for s in sets])
                common = overlaps(sets)
                linked = common >= np.ceil(THRESHOLD * (sizes[:, None] + sizes - common) - 1e-9)
                np.fill_diagonal(linked, False)
                if low[start] != high[start]:  # pairs inside one block belong to that block's own task
                    linked &= own[some][:, None] != own[some]
                left, right = np.nonzero(linked)
                root = forest(left, right, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(linked @ copies[some]), pa.array(ids[some][root])],
                    names=["id", "links", "root"],
                )

    columns = ["label", "low", "high", "id", "own", "copies", "text"]
    return by_group(members.select(*columns), columns[:3]).mapInArrow(run, "id long, links long, root long")


def set_texts(frame: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """`wanted` rows (key, ...) with the text of the row of that key in `frame`.

    A bitmap of 2 MB over the keys keeps most other texts out of the join.
    """
    held = frame.sparkSession.sparkContext.broadcast(
        filter_bits(wanted.select(F.xxhash64(key).alias("fingerprint")), FILTER_BITS)
    )
    placed = frame.select(
        key, "text", F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS).alias("place")
    )

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            place = batch.column(2).to_numpy()
            hit = pa.array((bitmap[place >> 3] >> (place & 7) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=[key, "text"])

    likely = placed.mapInArrow(run, f"{key} long, text string")
    return likely.join(wanted.hint("merge"), key)


def similar_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    pruned: float = PRUNED,
    block: int = BLOCK,
    miss: float = TARGET_MISS,
) -> DataFrame:
    """One row per document: key, doc_id, class_id, n_links, class_size.

    key is a number of the row that follows from the id and the text, for joining back. `miss` is the probability with
    which a pair at the threshold may part in all trees; the depth of the trees follows from it.
    """
    return labelled_documents(documents, id_column, text_column, pruned, block, miss).drop("label")


def labelled_documents(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    pruned: float = PRUNED,
    block: int = BLOCK,
    miss: float = TARGET_MISS,
) -> DataFrame:
    """The columns of similar_documents() and label: a number of the component, null without a shingle."""
    frame = documents.select(
        documents[id_column].cast("long").alias("doc_id"), text_of(documents, text_column).alias("text")
    ).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    rows = written(signatures(frame.select("key", "doc_id", "text"), depth_for(miss)), "signatures")
    first = F.min(F.struct("key", "nodes", "bytes")).alias("first")
    sets = written(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(first, F.count(F.lit(1)).alias("copies"))
        .select(F.col("first.key").alias("id"), "digest", "copies", "first.nodes", "first.bytes"),
        "sets",
    )
    members = dealt_blocks(written(shared_nodes(tree_nodes(sets)), "nodes"), "node", block)
    edges = likely_edges(members.join(sets.select("id", "bytes"), "id"), pruned)
    groups = written(connected_components(edges), "groups")
    # sizes from a written table: the join then deals both sides out anew, and a hot group can be split
    sized = groups.join(written(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sizes"), "label")
    candidates = written(
        sized.join(sets.select("id", "copies"), "id").select(F.col("id").alias("key"), "label", "n", "copies"), "candidates"
    )
    texts = set_texts(frame, candidates, "key").dropDuplicates(["key"]).withColumnRenamed("key", "id")
    links = written(verified_links(dealt_blocks(texts, "label", block)), "links")
    classes = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    known = written(
        sets.select("id", "digest", "copies")
        .join(counted, "id", "left")
        .join(classes, "id", "left")
        .select(
            "digest",
            F.coalesce("label", "id").alias("label"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "classes",
    )
    labelled = written(rows.select("key", "doc_id", "digest").join(known, "digest", "left"), "labelled")
    named = written(
        labelled.where("label is not null")
        .groupBy("label")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")),
        "named",
    )
    alone = F.col("label").isNull()
    return labelled.join(named, "label", "left").select(
        "key",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "label",
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """A number of a row: rows with one id and one text share it."""
    return F.xxhash64(doc_id, text)


def keep_one_of_class(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without those of a class whose first document is another; all columns stay.

    First is the smallest id (null last), then the smallest row key; of rows equal in id and text one stays.
    Classes are told apart by their component, so an id may be null or stand in several classes.
    """
    classes = labelled_documents(documents, id_column, text_column).where("class_size > 1")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("key"))
    decided = written(classes.select("key", "label", order.alias("place")), "decided")
    firsts = decided.groupBy("label").agg(F.min("place").alias("first"))
    gone = (
        decided.join(firsts, "label")
        .groupBy("key")
        .agg(F.first(F.col("key") == F.col("first.key")).alias("stays"))
    )
    gone = written(gone, "gone")
    held = documents.sparkSession.sparkContext.broadcast(
        filter_bits(gone.select(F.xxhash64("key").alias("fingerprint")), FILTER_BITS)
    )
    key = row_key(documents[id_column].cast("long"), text_of(documents, text_column))
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)
    keyed = documents.select(nested(documents), key.alias("key"), place.alias("place"))

    def passed(inside: bool) -> DataFrame:
        def run(batches):
            bitmap = np.frombuffer(held.value, np.uint8)
            for batch in batches:
                at = batch.column(2).to_numpy()
                hit = (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)
                yield batch.filter(pa.array(hit if inside else ~hit))

        return keyed.mapInArrow(run, keyed.schema)

    known = passed(True).join(gone.hint("merge"), "key", "left")
    wrongly = known.where("stays is null").select("whole")
    once = known.where("stays").dropDuplicates(["key"]).select("whole")
    return passed(False).select("whole").unionByName(wrongly).unionByName(once).select("whole.*")
