"""What settled frames leave behind."""

import gc
import glob
import time

import pytest

from panelmetrics.session import kept, settle, shared_folder


def checkpoints(folder: str) -> set[str]:
    return set(glob.glob(f"{folder.removeprefix('file:')}/**/rdd-*", recursive=True))


def test_checkpoints_go_with_their_frames(spark):
    folder = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    frame = settle(spark.range(10))
    folder = spark.sparkContext.getCheckpointDir() or folder
    assert frame.count() == 10
    made = checkpoints(folder)
    assert made
    newest = max(made, key=lambda path: int(path.rsplit("-", 1)[1]))
    del frame
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if newest not in checkpoints(folder):
            return
        time.sleep(0.5)
    raise AssertionError("the checkpoint is still there")


def test_kept_rows_go_with_their_block(spark):
    frame = spark.sql("SELECT id, CAST(id AS DECIMAL(12,2)) AS price, DATE '2020-01-01' AS day, IF(id > 2, 'x', NULL) AS text FROM range(5)")

    def files():
        return glob.glob(f"{shared_folder(spark).removeprefix('file:')}/kept-*")

    with kept(frame) as rows:
        assert files()
        assert rows.dtypes == frame.dtypes
        assert rows.orderBy("id").collect() == frame.orderBy("id").collect()
    assert not files()
    with pytest.raises(ValueError), kept(frame.limit(0)) as rows:
        assert rows.count() == 0 and rows.columns == frame.columns
        raise ValueError
    assert not files()
