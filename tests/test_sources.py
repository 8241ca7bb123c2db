import datetime as dt

import pytest

from panelmetrics.plans import write_reports
from panelmetrics.session import settle, shared_folder
from panelmetrics.sources import PanelTables, panel_tables, read_code_list


def test_code_list_drops_missing_codes_and_pads_the_rest(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("fips,name\n1001.0,a\n,b\n56045,c\n7,d\n")
    rows = sorted((r.fips, r.name) for r in read_code_list(spark, str(path)).collect())
    assert rows == [("00007", "d"), ("01001", "a"), ("56045", "c")]


def test_tables_load_from_parquet_and_from_the_catalogue(spark, make_tables, item, tmp_path):
    made = make_tables(items=[item("2020-01-01")], panel=[(dt.date(2020, 1, 1), 5)], cohort=[(1, dt.date(2020, 1, 1), "all")])
    names = {table: f"t_{table}" for table in PanelTables.__dataclass_fields__}
    for table, name in names.items():
        frame = getattr(made, table)
        if table == "items":
            frame = frame.withColumn("orderdate", frame.orderdate.cast("timestamp"))
            frame = frame.withColumn("itemprice", frame.itemprice.cast("double"))
        frame.write.parquet(str(tmp_path / name))
        spark.read.parquet(str(tmp_path / name)).createOrReplaceTempView(name)
    for loaded in (panel_tables(spark, names, str(tmp_path)), panel_tables(spark, names)):
        assert loaded.items.schema == made.items.schema
        assert loaded.items.collect() == made.items.collect()
        assert loaded.cohort.collect() == made.cohort.collect()


def test_reports_are_written_apart(spark, tmp_path):
    frames = {"a": spark.range(3), "b": spark.range(5).selectExpr("id AS x")}
    paths = write_reports(frames, str(tmp_path))
    assert spark.read.parquet(paths["a"]).count() == 3
    assert spark.read.parquet(paths["b"]).columns == ["x"]
    write_reports({"a": spark.range(2)}, str(tmp_path))
    assert spark.read.parquet(paths["a"]).count() == 2


def test_settled_frames_keep_rows_and_lose_lineage(spark):
    frame = settle(spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count())
    assert sorted(map(tuple, frame.collect())) == [(0, 4), (1, 3), (2, 3)]
    assert "Scan ExistingRDD" in frame._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in frame._jdf.queryExecution().executedPlan().toString()


class ClusterSession:
    """Stands for a cluster session without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_must_name_its_shared_folder(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(ClusterSession())
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", shared_folder(spark))
