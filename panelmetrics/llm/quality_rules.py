"""Quality rules: a hashed n-gram likelihood ratio between trusted and raw text, behind base rules.

Every text is the sequence of its 4-byte n-grams, hashed into 2**16 buckets. The buckets are
counted over all documents (raw) and over the trusted ones (target); the counts of a bucket
meet by a sum, so what a task sends is bounded by the number of buckets. The log ratio of
the two smoothed multinomials is 512 KB, whatever the corpus, and is broadcast. A second pass
scores every document by its mean log ratio (in nats per n-gram) and keeps it when the score
is at least `threshold`. Integer counts make the verdict the same in every run.

Base rules come first: too few words, or too many of them in repeated 3-word windows.

Defined cases: a null text has no words; texts without an n-gram score 0; a document with a
null doc_id is never trusted, but scored; repeated rows count and are scored each; rows of
`trusted` that repeat count once; without trusted documents every score is 0 and only
the base rules decide. Columns other than the id and the text are carried (drop_rejected) or left
out (score_rules). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from panelmetrics.llm.common import field_of, nested, text_of
from panelmetrics.llm.lookups import filter_bits

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ID_BITS = 24
THRESHOLD = -0.2
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

SCORED = [
    ("n_words", LongType()),
    ("word_chars", LongType()),
    ("n_symbols", LongType()),
    ("n_dup_lines", LongType()),
    ("n_repeat_words", LongType()),
    ("base_failed", BooleanType()),
    ("kept", BooleanType()),
    ("score", DoubleType()),
]


def ngram_buckets(text: np.ndarray) -> np.ndarray:
    """Bucket of each 4-byte n-gram (a multiplicative hash)."""
    if len(text) < 4:
        return np.zeros(0, dtype=np.uint16)
    wide = text.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    return (grams * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(names) + ids[1:]
    if len(names) >= 1 << 20:  # keep the next product below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(names) + ids[2:]
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    found = counts[place] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(found)] |= found
    return int(covered.sum())


class ByteKinds:
    """Per byte value: white space, code point start, symbol."""

    def __init__(self):
        self.white = np.zeros(256, dtype=np.int64)
        self.white[[32, *range(9, 14)]] = 1
        self.first = np.ones(256, dtype=np.int64)
        self.first[0x80:0xC0] = 0
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[list(b"#*$%&|<>")] = 1


def base_statistics(text: bytes, codes: np.ndarray, kinds: ByteKinds) -> tuple[int, int, int, int, int]:
    words = text.split()
    counts = np.bincount(codes, minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        int(counts @ (kinds.first - kinds.white)),
        int(counts @ kinds.symbol),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def bucket_counts(frame: DataFrame, name: str) -> DataFrame:
    """(bucket, its count as `name`) of the texts of a frame, one row per task and filled bucket."""

    def run(batches):
        counts, held, size = np.zeros(BUCKETS, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                found = ngram_buckets(np.frombuffer(text.as_buffer(), np.uint8))
                held.append(found)
                size += len(found)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], names=["bucket", name])

    return frame.mapInArrow(run, f"bucket long, {name} long")


def log_ratio(counts: pd.DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """Log of target over raw probability of each bucket."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]] = counts["raw"]
    target[counts["bucket"]] = counts["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    both = [np.log((c + smoothing) / (c.sum() + smoothing * BUCKETS)) for c in (raw, target)]
    return both[1] - both[0]


def trusted_texts(documents: DataFrame, trusted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts of the documents whose id is in the first column of `trusted`.

    A bitmap of 2 MB over hashed ids keeps most other texts out of the join, which is exact. The
    join is a merge at any size: the trusted ids grow with the corpus, and texts are never held
    whole in a task.
    """
    key = F.xxhash64("_trusted")
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("_trusted")).dropna().distinct()
    held = documents.sparkSession.sparkContext.broadcast(filter_bits(ids.select(key.alias("fingerprint")), ID_BITS))
    frame = documents.select(
        documents[id_column].cast("long").alias("_doc"),
        F.shiftrightunsigned(F.xxhash64(documents[id_column].cast("long")), 64 - ID_BITS).alias("_place"),
        text_of(documents, text_column).alias("text"),
    )

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            place = batch.column(1).to_numpy()
            hit = pa.array((bitmap[place >> 3] >> (place & 7) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(hit), batch.column(2).filter(hit)], names=["_doc", "text"]
            )

    likely = frame.where("_doc is not null").mapInArrow(run, "_doc long, text string")
    return likely.join(ids.hint("merge"), likely["_doc"] == ids["_trusted"]).select("text")


def scored_rows(frame: DataFrame, text_of_batch, ratio: np.ndarray, threshold: float) -> DataFrame:
    """The first column of a frame and the columns of SCORED; text_of_batch finds the texts of a batch."""
    held = frame.sparkSession.sparkContext.broadcast(ratio)
    schema = StructType([frame.schema.fields[0], *(StructField(n, t) for n, t in SCORED)])
    kinds_of = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]

    def run(batches):
        weights, kinds = held.value, ByteKinds()
        for batch in batches:
            rows = []
            for text in text_of_batch(batch):
                plain = text.as_buffer().to_pybytes() if text.is_valid else b""
                codes = np.frombuffer(plain, np.uint8)
                base = base_statistics(plain, codes, kinds)
                failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED_PERCENT * base[0]
                grams = ngram_buckets(codes)
                score = float(weights[grams].mean()) if len(grams) else 0.0
                rows.append((*base, failed, not failed and score >= threshold, score))
            more = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds_of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=schema.names)

    return frame.mapInArrow(run, schema)


def trained_ratio(documents: DataFrame, trusted: DataFrame, id_column: str, text_column: str) -> np.ndarray:
    """The log ratio; at most BUCKETS rows of counts reach the driver."""
    raw = bucket_counts(documents.select(text_of(documents, text_column).alias("text")), "raw")
    target = bucket_counts(trusted_texts(documents, trusted, id_column, text_column), "target")
    both = raw.unionByName(target, allowMissingColumns=True).groupBy("bucket")
    return log_ratio(both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw", "target")]).toPandas())


def score_rules(
    documents: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: id, base statistics, base_failed, kept, score."""
    ratio = trained_ratio(documents, trusted, id_column, text_column)
    frame = documents.select(
        documents[id_column].alias("doc_id"), text_of(documents, text_column).alias("text")
    )
    return scored_rows(frame, lambda batch: batch.column(1), ratio, threshold)


def drop_rejected(
    documents: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    ratio = trained_ratio(documents, trusted, id_column, text_column)
    schema = documents.schema
    rows = documents.select(nested(documents))
    scored = scored_rows(rows, lambda batch: field_of(batch.column(0), schema, text_column), ratio, threshold)
    return scored.where("kept").select("whole.*")
