"""Exact dedup by a Golomb-coded fingerprint exchange.

1. A pass over the texts hashes every normalised text and keeps one small row per document
   in the shared folder. The task (a "part") also sorts its distinct 64-bit fingerprints and
   codes them, one block per owner (a range of fingerprints).
2. Owners decode the blocks of all parts and answer each part with a bitmap of the
   fingerprints that another part sent as well. A text that a third of the rows share is one
   fingerprint per part here.
3. Parts turn the bitmaps (and what repeats inside the part) into suspects. Only the texts of
   suspects are shuffled, and a group is accepted when all its texts are the same bytes.

Defined cases: a null text counts as an empty one; empty texts are equal to each other; rows
that repeat a doc_id are documents of their own, and exactly one row of a group stays (of
rows with the smallest doc_id, one of them). A null doc_id counts as larger than any number.
Columns other than the id and the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from panelmetrics.llm import golomb
from panelmetrics.llm.common import default_partitions, field_of, nested, text_of, written
from panelmetrics.llm.lookups import filter_bits

BITS = 64


def normalised(text: bytes) -> bytes:
    """Each run of white space (0x20, 0x09 to 0x0D) becomes one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    head = b" " if text[:1].isspace() else b""
    tail = b" " if text[-1:].isspace() else b""
    return head + b" ".join(words) + tail


def fingerprint(digest: bytes) -> int:
    """64 bits of the SHA-256 of a normalised text."""
    return int.from_bytes(digest[:8], "big")


def owner_bounds(owners: int) -> np.ndarray:
    """First fingerprint of each owner; owners hold equal ranges."""
    return np.array([(i << BITS) // owners for i in range(owners)], dtype=np.uint64)


PRINTS = pa.schema(
    [
        ("part", pa.int32()),
        ("owner", pa.int32()),
        ("block", pa.binary()),
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("fingerprint", pa.int64()),
        ("sha", pa.binary()),
    ]
)


def fingerprints(frame: DataFrame, owners: int) -> DataFrame:
    """Rows of two kinds: documents (owner null) and coded blocks (one per part and owner).

    A part holds its fingerprints until its task ends: 8 bytes a document of one split.
    """

    def run(batches):
        part, row, seen = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            shas = [hashlib.sha256(normalised(t.as_buffer().to_pybytes())).digest() for t in texts]
            prints = np.array([fingerprint(s) for s in shas], dtype=np.uint64)
            count = len(shas)
            nothing = pa.nulls(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(count, part, np.int32)),
                    nothing.cast(pa.int32()),
                    nothing.cast(pa.binary()),
                    pa.array(np.arange(row, row + count)),
                    ids,
                    pa.array(prints.view(np.int64)),
                    pa.array(shas, pa.binary()),
                ],
                schema=PRINTS,
            )
            row += count
            seen.append(np.unique(prints))
        if not row:
            return
        distinct = np.unique(np.concatenate(seen))
        cuts = np.searchsorted(distinct, owner_bounds(owners))
        edges = [*cuts.tolist(), len(distinct)]
        filled = [o for o in range(owners) if edges[o] < edges[o + 1]]
        blocks = [golomb.encode(distinct[edges[o] : edges[o + 1]], BITS) for o in filled]
        count = len(filled)
        nothing = pa.nulls(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(count, part, np.int32)),
                pa.array(filled, pa.int32()),
                pa.array(blocks, pa.binary()),
                nothing.cast(pa.int64()),
                nothing.cast(pa.int64()),
                nothing.cast(pa.int64()),
                nothing.cast(pa.binary()),
            ],
            schema=PRINTS,
        )

    return frame.mapInArrow(
        run, "part int, owner int, block binary, row long, doc_id long, fingerprint long, sha binary"
    )


def answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """What one owner answers: per part a bitmap over its block, if a bit is set."""
    decoded = [golomb.decode(b) for b in blocks["block"]]
    every = np.concatenate(decoded)
    values, counts = np.unique(every, return_counts=True)
    shared = values[counts > 1]
    rows = []
    for part, block, mine in zip(blocks["part"], blocks["block"], decoded, strict=True):
        found = np.isin(mine, shared)
        if found.any():
            rows.append((part, block, np.packbits(found).tobytes()))
    return pd.DataFrame(rows, columns=["part", "block", "bitmap"])


def marked(documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Suspects of one part: named by a bitmap, or repeated inside the part."""
    named = [np.zeros(0, np.uint64)]
    for block, bitmap in zip(answers["block"], answers["bitmap"], strict=True):
        mine = golomb.decode(block)
        named.append(mine[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(mine)).astype(bool)])
    own = documents["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
    values, counts = np.unique(own, return_counts=True)
    hit = np.isin(own, np.concatenate([*named, values[counts > 1]]))
    return documents.assign(suspect=hit)[["part", "row", "doc_id", "fingerprint", "sha", "suspect"]]


def in_bitmap(digest: bytes, bitmap: np.ndarray, bits: int) -> bool:
    place = fingerprint(digest) >> (64 - bits)
    return bool(bitmap[place >> 3] >> (place & 7) & 1)


def suspect_texts(frame: DataFrame, held: bytes, bits: int) -> DataFrame:
    """(sha, text) of the documents whose fingerprint is in the bitmap, one per text and task.

    Texts that repeat in a task are sent once: the task remembers the digests it sent.
    """
    shared = frame.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        bitmap, sent = np.frombuffer(shared.value, np.uint8), {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                plain = normalised(text.as_buffer().to_pybytes())
                sha = hashlib.sha256(plain).digest()
                if in_bitmap(sha, bitmap, bits):
                    check = hash(plain)
                    if sent.get(sha) != check:  # another text under the same digest is sent as well
                        sent[sha] = check
                        rows.append((sha, plain))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["sha", "text"]
            )

    return frame.mapInArrow(run, "sha binary, text binary")


def rows_by_bitmap(documents: DataFrame, text_column: str, held: bytes, bits: int, inside: bool) -> DataFrame:
    """Rows (nested as `whole`) whose fingerprint is in the bitmap, with their digest, or rows that are not."""
    shared = documents.sparkSession.sparkContext.broadcast(held)
    rows, schema = documents.select(nested(documents)), documents.schema
    result = StructType([*rows.schema.fields, *([StructField("sha", BinaryType())] if inside else [])])

    def run(batches):
        bitmap = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            texts = field_of(batch.column(0), schema, text_column)
            shas = [hashlib.sha256(normalised(t.as_buffer().to_pybytes() if t.is_valid else b"")).digest() for t in texts]
            mask = pa.array([in_bitmap(s, bitmap, bits) == inside for s in shas], pa.bool_())
            columns = [batch.column(0).filter(mask)] + ([pa.array(shas, pa.binary()).filter(mask)] if inside else [])
            yield pa.RecordBatch.from_arrays(columns, names=result.names)

    return rows.mapInArrow(run, result)


def exact_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", owners: int | None = None, bits: int = 24
) -> DataFrame:
    """One row per document: part, row, doc_id, keep_id, group_size, kept, sha.

    `owners` is the number of fingerprint ranges (default: the session's shuffle partitions);
    `bits` sizes the bitmap that is broadcast (2**bits / 8 bytes).
    """
    frame = documents.select(
        documents[id_column].cast("long").alias("doc_id"), text_of(documents, text_column).alias("text")
    )
    prints = written(fingerprints(frame, owners or default_partitions(frame)), "prints")
    blocks = prints.where("owner is not null").select("part", "owner", "block")
    answers = (
        blocks.groupBy("owner")
        .applyInPandas(answer, "part int, block binary, bitmap binary")
    )
    rows = prints.where("owner is null").select("part", "row", "doc_id", "fingerprint", "sha")
    checked = written(
        rows.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInPandas(
            lambda documents, answers: marked(documents, answers),
            "part int, row long, doc_id long, fingerprint long, sha binary, suspect boolean",
        ),
        "suspects",
    )
    suspects = checked.where("suspect")
    texts = suspect_texts(frame, filter_bits(suspects, bits), bits)
    verified = (
        texts.groupBy("sha", "text").agg(F.lit(1).alias("one"))
        .groupBy("sha").agg(F.count(F.lit(1)).alias("texts"))
    )
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part", "row")
    groups = (
        suspects.groupBy("sha")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
        .join(verified, "sha")
        .select(
            "sha",
            "first",
            F.when(F.col("texts") == 1, F.col("size"))
            .otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
            .alias("size"),
        )
    )
    # from a written table the join deals both sides out anew, so that a hot group can be split
    joined = suspects.join(written(groups, "groups"), "sha", "left")
    alone = F.col("size").isNull()
    decided = joined.select(
        "part",
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("first.part") == F.col("part")) & (F.col("first.row") == F.col("row")))).alias("kept"),
        "sha",
    )
    others = checked.where("not suspect").select(
        "part",
        "row",
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "sha",
    )
    return others.unionByName(decided)


def drop_copies(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", owners: int | None = None, bits: int = 24
) -> DataFrame:
    """The documents without those that repeat an earlier text; all columns stay.

    Documents whose decision is to go are found by (doc_id, SHA-256). Where rows of one text
    also share the doc_id, one of them stays.
    """
    decided = written(exact_groups(documents, id_column, text_column, owners, bits), "copies")
    gone = (
        decided.groupBy("doc_id", "sha")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("stays"))
        .where("rows > 1 or not stays")
        .select("doc_id", "sha", "stays")
    )
    held = filter_bits(gone.select(prefix("sha").alias("fingerprint")), bits)
    free = rows_by_bitmap(documents, text_column, held, bits, inside=False)
    bound = rows_by_bitmap(documents, text_column, held, bits, inside=True)
    bound = bound.withColumn("id", F.col("whole")[id_column].cast("long"))
    same = bound["id"].eqNullSafe(gone["doc_id"]) & (bound["sha"] == gone["sha"])
    known = bound.join(gone, same, "left").select("whole", "id", bound["sha"].alias("digest"), "stays")
    wrongly = known.where("stays is null").select("whole")
    once = known.where("stays").dropDuplicates(["id", "digest"]).select("whole")
    return free.unionByName(wrongly).unionByName(once).select("whole.*")


def prefix(sha: str):
    """The fingerprint of a digest column."""
    return F.conv(F.substring(F.hex(sha), 1, 16), 16, -10).cast("long")
