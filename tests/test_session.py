from __future__ import annotations

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark import session


def test_cached_tables_are_built_once_until_a_file_changes(spark, tmp_path):
    built = []

    def total():
        def build():
            built.append(1)
            return session.table(spark, str(tmp_path), "t").agg(F.sum("v").alias("v"))

        return session.cached(spark, str(tmp_path), ("t",), "total", build).first().v

    spark.createDataFrame([(1,), (2,)], "v int").write.parquet(f"{tmp_path}/t.parquet")
    assert total() == 3 and total() == 3 and len(built) == 1
    time.sleep(0.01)
    spark.createDataFrame([(5,)], "v int").write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert total() == 8 and len(built) == 2


def test_a_cluster_must_name_its_shared_folder():
    def fake(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    assert session.shared_folder(fake("spark://host:7077", "hdfs:///tmp/x")) == "hdfs:///tmp/x"
    assert session.shared_folder(fake("local[4]", None)).startswith("file://")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077", None))
