import os

import pytest

from pagewright import session


def folder(df):
    return df._pagewright_path.removeprefix("file://")


def files(df):
    return [f for f in os.listdir(folder(df)) if f.endswith(".parquet")]


def test_written_tables_keep_the_splits_of_large_inputs(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(40)
    source = session.write_table(docs, "many", 1000)
    scan = spark.read.parquet(source._pagewright_path)
    few = session.write_table(source, "few", 1)
    assert len(files(few)) <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "TASK_BYTES", 1)
    assert len(files(session.write_table(scan, "kept", 1))) == scan.rdd.getNumPartitions()


def test_tables_go_when_they_are_dropped(spark):
    a, b = session.write_table(spark.range(5), "a"), session.write_table(spark.range(5), "b")
    session.drop_table(a)
    assert not os.path.exists(folder(a)) and b.count() == 5
    session.drop_all(spark)
    assert not os.path.exists(folder(b))
    session.drop_all(spark)


def test_no_table_without_a_shared_folder(spark, monkeypatch):
    class Remote:
        master = "spark://x"

        def __getattr__(self, name):
            return getattr(spark.sparkContext, name)

    class Session:
        sparkContext = Remote()
        conf = spark.conf

    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None:
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(Session())
