"""Quality classifier: a linear hinge-loss model over n-grams scaled by naive Bayes ratios.

Features are indicators of hashed byte 4-grams, and of how large a share of the word pairs say one word
twice (an eighth, a quarter, a half or more). They are scaled by the log ratio of the smoothed
class counts; 4-grams are divided by the root of their number, so that short and long texts
are alike, and the few indicators of pairs count a fixed part. The hinge-loss model is fitted by dual
coordinate descent, and its margin becomes a probability by a logistic curve fitted to rows
that the model has not seen.

The model is fitted on a bounded sample of the labelled rows: the `sample` rows whose hashed
ids are smallest (6,000), as far as their features take `sample_bytes` bytes together (200 MB; a text of
a thousand words has about 8 kB of them, and none more than 1 MB). The weights are 2 MB
whatever the input, and are broadcast to score every whole text.

Defined cases: a null or empty text has no features and scores what the bias gives; labels of one id that
disagree are averaged (at least 0.5 is 1), null labels and null ids teach nothing; documents
that repeat are scored each; without labels of both classes every score is the share of 1 (0.5
without any); columns other than the id and the text are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import text_of, written

BITS = 18
BUCKETS = 1 << BITS
SHARES = (0.125, 0.25, 0.5)  # their features come after the hashed ones
SHARE_SCALE = 0.3
FEATURES = BUCKETS + len(SHARES)
SAMPLE = 6_000
SAMPLE_BYTES = 200_000_000
THRESHOLD = 0.3


class Features:
    """Distinct features of a text; the scratch array makes them distinct without a sort."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, dtype=np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        codes = np.frombuffer(text, np.uint8).astype(np.uint32)
        found = np.zeros(0, dtype=np.int64)
        if len(codes) >= 4:
            grams = codes[:-3] | codes[1:-2] << np.uint32(8) | codes[2:-1] << np.uint32(16) | codes[3:] << np.uint32(24)
            hashed = (grams * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
            order = np.arange(len(hashed))
            self.last[hashed] = order
            found = hashed[self.last[hashed] == order]
        words = text.split()
        twice = sum(map(eq, words, words[1:]))
        held = [BUCKETS + i for i, share in enumerate(SHARES) if twice and twice >= share * (len(words) - 1)]
        return np.append(found, held).astype(np.int64) if held else found


def scales(features: np.ndarray) -> np.ndarray:
    """What each feature of a text counts before the class ratios."""
    hashed = features < BUCKETS
    return np.where(hashed, 1 / max(1, hashed.sum()) ** 0.5, SHARE_SCALE)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features] @ scales(features) + self.bias)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of the share of each feature in class 1 over its share in class 0."""
    counts = [np.full(FEATURES, smoothing) for _ in range(2)]
    for features, label in zip(rows, labels, strict=True):
        counts[int(label)][features] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the L1 hinge loss (Hsieh et al., 2008), over scaled features.

    The weights returned are those of the unscaled indicators.
    """
    scaled = [ratio[f] * scales(f) for f in rows]
    lengths = np.array([x @ x + 1.0 for x in scaled])
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    shuffled = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in shuffled.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ scaled[i] + bias) - 1
            held = min(max(alpha[i] - gradient / lengths[i], 0.0), cost)
            step = held - alpha[i]
            if step:
                alpha[i] = held
                weights[rows[i]] += step * signs[i] * scaled[i]
                bias += step * signs[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return weights * ratio, bias


def logistic_fit(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with Platt's smoothed targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        error, spread = chance - target, np.maximum(chance * (1 - chance), 1e-9)
        gradient = np.array([error @ margins, error.sum()]) + 1e-6 * np.array([slope, offset])
        hessian = np.array([[spread @ margins**2, spread @ margins], [spread @ margins, spread.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(slope, 1e-3)), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model: fitted on four fifths of the rows, its curve on the rest."""
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    fifth = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~fifth].tolist())) < 2 or len(set(labels[fifth].tolist())) < 2:
        fifth[:] = False
    taught = [r for r, out in zip(rows, fifth, strict=True) if not out]
    ratio = log_count_ratio(taught, labels[~fifth])
    weights, bias = dual_coordinate_descent(taught, 2.0 * labels[~fifth] - 1, ratio)
    model = Model(weights, bias)
    rest = fifth if fifth.any() else ~fifth
    margins = np.array([model.margin(r) for r, out in zip(rows, rest, strict=True) if out])
    model.slope, model.offset = logistic_fit(margins, labels[rest])
    return model


def labelled_features(
    documents: DataFrame, labels: DataFrame, sample: int, sample_bytes: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sample, in the order of hashed ids.

    At most `sample` rows and, from the first row on, `sample_bytes` bytes of features reach the driver.
    """
    agreed = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    )
    order = F.xxhash64("doc_id")
    chosen = agreed.orderBy(order, "doc_id").limit(sample)  # at most `sample` small rows: a bounded broadcast
    rows = documents.join(F.broadcast(chosen), "doc_id").select(order.alias("place"), "doc_id", "label", "text")

    def run(batches):
        features = Features()
        for batch in batches:
            found = [features(t.as_buffer().to_pybytes()).astype(np.int32).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.binary())], names=["place", "doc_id", "label", "found"]
            )

    seen = rows.mapInArrow(run, "place long, doc_id long, label int, found binary")
    # an id may stand in many documents; one of each text is enough, and the sample stays bounded
    once = written(seen.groupBy("place", "doc_id", "label").agg(F.min("found").alias("found")), "sample")
    sizes = once.select("place", "doc_id", F.length("found").alias("size")).collect()
    sizes.sort(key=lambda r: (r["place"], r["doc_id"]))
    fitting = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), sample_bytes, side="right"))
    wanted = [(r["place"], r["doc_id"]) for r in sizes[: max(1, fitting)]]
    last = F.struct(*[F.lit(x).cast("long") for x in (wanted[-1] if wanted else (0, 0))])
    held = once.where(F.struct("place", "doc_id") <= last).collect() if wanted else []
    held.sort(key=lambda r: (r["place"], r["doc_id"]))
    return [np.frombuffer(r["found"], np.int32).astype(np.int64) for r in held], np.array([r["label"] for r in held])


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """One row per document: doc_id, score, predicted.

    Of the labels given, a sample of `sample` rows and `sample_bytes` bytes of features at most is used to learn.
    """
    frame = documents.select(
        documents[id_column].cast("long").alias("doc_id"), text_of(documents, text_column).alias("text")
    )
    taught = labels.select(
        labels[id_column].cast("long").alias("doc_id"), labels[label_column].cast("int").alias("label")
    )
    model = fit(*labelled_features(frame, taught, sample, sample_bytes))
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset))

    def run(batches):
        features, fitted = Features(), Model(*held.value)
        for batch in batches:
            scores = [fitted.score(features(t.as_buffer().to_pybytes())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    scored = frame.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_column: str = "doc_id"):
    """Whether a row is left for testing: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
