"""Shared pieces of the training-data operators: written tables and texts."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelmetrics.session import shared_folder

WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """A folder for the tables that operators write while the block runs; it goes when the block ends.

        with scratch(spark):
            remove_repeats(documents).write.parquet(target)

    Frames read their tables when they run, so a result is to be written or fetched inside the block. Tables written
    outside of any block stay until `drop_written`.
    """
    folder = f"{_own_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        _remove(spark, folder)


def drop_written(spark: SparkSession) -> None:
    """Remove every table that operators of this application have written. Frames that read them end with it."""
    _remove(spark, _own_folder(spark))


def tables_folder(spark: SparkSession) -> str:
    """Where `written` puts tables just now: the folder of the innermost `scratch` block, or that of the application."""
    return _scratch[-1] if _scratch else _own_folder(spark)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # wherever the shared folder is, Spark's file system reaches it
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The rows of a frame, written to the shared folder and read back.

    This cuts the lineage: the pass runs once, and a lost executor does not bring it back. The table goes
    with the `scratch` block it was written in, or with the given folder.
    """
    spark = frame.sparkSession
    path = f"{folder or tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def nested(documents: DataFrame) -> Column:
    """A whole row as one column `whole`: columns beside it can't clash with the row's own, whatever these are called."""
    return F.struct(*[documents[c] for c in documents.columns]).alias("whole")


def field_of(column: pa.StructArray, schema: StructType, name: str) -> pa.Array:
    """A column of the nested rows of a batch."""
    return column.field(schema.names.index(name))


def default_partitions(frame: DataFrame) -> int:
    """Shuffle partitions of the session: the number of owners and shards grows with it."""
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_of(frame: DataFrame, column: str = "text") -> Column:
    """The text of a row, null as empty."""
    return F.coalesce(frame[column].cast("string"), F.lit(""))


def arrow_batches(schema: pa.Schema, rows, size: int = 4096):
    """Record batches of at most `size` rows from an iterator of tuples."""
    held: list[tuple] = []

    def batch():
        columns = list(zip(*held, strict=True)) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()
