import pytest
from pyspark.sql import functions as F

from graphloom import storage


def test_cut_and_drop(spark):
    df = storage.cut(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert df.count() == 5 and df._graphloom_path.startswith(storage.session_dir(spark))
    storage.drop(df)
    storage.drop(spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df._graphloom_path)


def test_cut_of_nothing_keeps_the_schema(spark):
    df = storage.cut(spark.createDataFrame([], "a bigint, b array<string>"), "t")
    assert df.dtypes == [("a", "bigint"), ("b", "array<string>")] and df.isEmpty()


def test_upsert_update_latest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in storage.upsert(old, new, "k").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(tuple(r) for r in storage.point_update(old, new, "k", ["v"]).collect()) == [("a", 1), ("b", 3)]
    events = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert sorted(tuple(r) for r in storage.latest(events, "k", ["t"]).collect()) == [("a", 2, "y"), ("b", 1, "z")]


def test_ship(spark):
    import zipfile

    from graphloom.session import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "graphloom/storage.py" in names and all(n.startswith("graphloom/") for n in names)
