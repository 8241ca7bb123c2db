"""Rows looked up by key: a bitmap of fixed size keeps most other rows out of a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def filter_bits(keys: DataFrame, bits: int) -> bytes:
    """A bitmap of 2**bits over the top bits of the column `fingerprint`.

    It is 2**bits / 8 bytes whatever the input, put together from pieces of 4 kB. It only keeps rows out of a
    shuffle; those it lets through wrongly find no partner there.
    """
    place = F.shiftrightunsigned("fingerprint", 64 - bits) + F.lit(1)
    chunks = (
        keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("position").alias("map"))
        .collect()
    )
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for chunk in chunks:
        start = (chunk["bucket"] - 1) * 4096
        piece = np.frombuffer(chunk["map"], np.uint8)[: len(whole) - start]
        whole[start : start + len(piece)] = piece
    return whole.tobytes()


def key_bitmap(keys: DataFrame, key: str = "key", bits: int = BITS) -> Broadcast:
    """A bitmap of 2**bits bits (2**bits / 8 bytes) of the keys, on every task.

    It lets all of the keys through and other rows rarely, so it only saves moving rows: where it fills up
    (2**bits keys set two bits of three), more rows are moved and joins give the same.
    """
    held = filter_bits(keys.select(F.xxhash64(key).alias("fingerprint")), bits)
    return keys.sparkSession.sparkContext.broadcast(held)


def bitmap_place(key: str, bits: int = BITS) -> Column:
    """Where a row's key stands in the bitmap."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def marked(bitmap: Broadcast, place: pa.Array) -> np.ndarray:
    """Whether the places of a batch are marked."""
    held, at = np.frombuffer(bitmap.value, np.uint8), place.to_numpy()
    return (held[at >> 3] >> (at & 7) & 1).astype(bool)


def likely_rows(frame: DataFrame, bitmap: Broadcast, key: str = "key", bits: int = BITS) -> DataFrame:
    """Rows of a frame whose key may be in the bitmap."""

    def run(batches):
        for batch in batches:
            hit = marked(bitmap, batch.column(batch.num_columns - 1))
            kept = batch.filter(pa.array(hit))
            yield kept.select(list(range(batch.num_columns - 1)))

    return frame.withColumn("bitmap_place", bitmap_place(key, bits)).mapInArrow(run, frame.schema)
