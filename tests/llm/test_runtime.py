from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from xylem.llm import runtime


def test_tables_need_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    stub = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app-{master}"))
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(stub("spark://far:7077"))
    assert runtime.shared_dir(stub("local[2]")).startswith("file:")


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    with runtime.scratch(spark):
        gone = runtime.written(spark.range(5))
        kept = runtime.written(gone.withColumn("x", F.col("id") * 2), keep=True)
        with runtime.scratch(spark):
            inner = runtime.written(spark.range(3), keep=True)
        assert inner.count() == 3
    rows = sum(1 for p in tmp_path.rglob("*.parquet") if p.is_file() and p.stat().st_size and spark.read.parquet(str(p)).columns == ["id", "x"])
    assert kept.count() == 5 and rows
    with pytest.raises(Exception, match="exist|FILE"):
        gone.count()


def test_sizes(spark):
    assert runtime.parts(spark.createDataFrame([(1,)], "a int"), 1) >= 4
    assert runtime.tasks(7) == 7 and runtime.tasks(10**7) == 100_000 and runtime.others(spark.createDataFrame([(1, 2)], "Base int, x int"), ("base",)) == ["x"]
