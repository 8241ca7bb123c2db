"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own.

    Checkpoints go when nothing refers to their frames any more; set the cleaner on a cluster, too.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelmetrics")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session without the setting gets a folder of its own, which goes when Python ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelmetrics-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(frame: DataFrame) -> DataFrame:
    """Run the pass that builds a small frame and keep its rows in the shared folder.

    Reports use it for frames that several branches read (brand-days, zip totals), so
    that the fact is read once and a lost executor does not bring the pass back.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


@contextmanager
def kept(frame: DataFrame) -> Iterator[DataFrame]:
    """The rows of a frame in the shared folder while the block runs; they go when the block ends.

    For large frames that several passes read and that take joins to build: the joins run once, and each pass reads
    only the columns and row groups it needs. Frames read the files when they run, so results are to be written or
    fetched inside the block.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    try:
        frame.write.option("compression", "zstd").parquet(folder)
        yield spark.read.schema(frame.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # wherever the shared folder is, Spark's file system reaches it
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
