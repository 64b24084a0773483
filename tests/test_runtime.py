from __future__ import annotations

import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loamdex import runtime


def session(master: str, files: list[str]):
    return SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"app-{master}-{id(files)}", master=master, addPyFile=files.append), conf={})


def test_package_is_shipped_once_where_workers_do_not_inherit_it(monkeypatch, tmp_path):
    sent: list[str] = []
    far = session("spark://host:7077", sent)
    runtime.ship(far)
    runtime.ship(far)
    assert len(sent) == 1 and "loamdex/runtime.py" in zipfile.ZipFile(sent[0]).namelist()
    near: list[str] = []
    root = runtime.Path(runtime.__file__).resolve().parent.parent
    monkeypatch.setenv("PYTHONPATH", str(root))
    runtime.ship(session("local-cluster[2,1,1024]", near))
    assert near == []
    monkeypatch.delenv("PYTHONPATH")
    monkeypatch.chdir(tmp_path)
    runtime.ship(session("local[4]", near))
    assert len(near) == 1


def test_a_cluster_needs_a_shared_folder():
    far = session("spark://host:7077", [])
    with pytest.raises(RuntimeError):
        runtime.shared_dir(far)


def test_materialized_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "i int, t array<string>")
    kept, n = runtime.counted(df, "t")
    assert n == 2 and kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    assert runtime.counted(df.limit(0), "t")[1] == 0


def test_join_beyond_the_bound_shuffles_and_gives_the_same(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 10)
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    near, far = (runtime.join_bounded(big, small, "k", 5, limit=limit) for limit in (10, 1))
    assert sorted(near.collect()) == sorted(far.collect()) and near.count() == 50
    assert "BroadcastHashJoin" in near._jdf.queryExecution().toString() and "SortMergeJoin" in far._jdf.queryExecution().toString()


def test_frequent_keys_count_distinct_values(spark):
    rows = [("a", i % 4) for i in range(40)] + [("b", 1)] * 9 + [("c", None)] * 9
    got = runtime.frequent_keys(spark.createDataFrame(rows, "k string, v int"), "k", "v", 4).collect()
    assert [tuple(r) for r in got] == [("a", 4)]


def test_blank_and_computed_once(spark):
    df = spark.createDataFrame([("",), (None,), (" 　\n",), ("x",)], "t string")
    assert df.where(runtime.blank(F.col("t"))).count() == 3
    once = runtime.computed_once(df, "n", F.length("t")).where("n > 0")
    assert once.columns == ["t", "n"] and once.count() == 2


def test_scratch_tables_are_deleted(spark):
    from loamdex.runtime import materialize, scratch, shared_dir

    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        inside = materialize(spark.range(5), "inside")
        assert inside.count() == 5
        path = inside.inputFiles()[0].removeprefix("file://")
    import os

    assert not os.path.exists(path) and kept.count() == 3 and shared_dir(spark)
