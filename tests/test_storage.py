import os
import time

import pytest
from pyspark.sql import functions as F
from strandwork import api, storage
from strandwork.operators import signal
from strandwork.sources import sinks


def test_results_are_kept_by_version(spark, tmp_path):
    """A second call reads; another parameter, a changed file or a new file builds anew; a cut-off write is not taken."""
    source, root = str(tmp_path / "in"), "file://" + str(tmp_path / "store")
    spark.range(10).write.parquet(source)
    built = []

    def call(k=2):
        def build():
            built.append(k)
            return storage.materialize(spark.read.parquet(source).select((F.col("id") * k).alias("x")), "part")

        return sorted(r["x"] for r in storage.kept("doubled", build, spark, [source], {"k": k}, root).collect())

    assert call() == call() == [2 * i for i in range(10)] and built == [2]
    assert call(3) == [3 * i for i in range(10)] and call() == [2 * i for i in range(10)] and built == [2, 3]
    file = next(str(p) for p in (tmp_path / "in").glob("*.parquet"))
    os.utime(file, (1, 1))
    call()
    spark.range(10, 12).write.mode("append").parquet(source)
    assert call() == [2 * i for i in range(12)] and built == [2, 3, 2, 2]
    assert not list((tmp_path / "store").glob("**/part-*/")), "what a build materialises goes with it"

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        storage.kept("other", broken, spark, [source], {}, root)
    key = storage.version(spark, "other", [source], {})
    spark.range(3).write.parquet(f"{root}/other/{key}/half")  # a run that no manifest names
    assert storage.kept("other", lambda: spark.range(5), spark, [source], {}, root).count() == 5

    assert storage.expire(spark, 3600, root) == []
    time.sleep(0.1)
    gone = storage.expire(spark, 0.0, root)
    assert len(gone) == 5 and call() == [2 * i for i in range(12)] and built[-1] == 2 and len(built) == 5


def test_scratch_is_deleted(spark):
    with storage.scratch(spark) as path:
        assert storage.materialize(spark.range(4), "a").count() == 4
        assert len(os.listdir(path.removeprefix("file://"))) == 1
    assert not os.path.exists(path.removeprefix("file://"))
    assert storage.materialize(spark.range(4), "a").count() == 4


def test_counts_of_files_are_kept(spark, tmp_path):
    rows = [("a", 10 * i % 700, 20 + i % 200) for i in range(300)]
    df = spark.createDataFrame(rows, "chr string, ref_start int, tlen int")
    path, root = "file://" + str(tmp_path / "bams"), "file://" + str(tmp_path / "store")
    sinks.bam(df, path, {"a": 2000})
    wanted = sorted(map(tuple, signal.length_position_counts(df, 30, 180).collect()))
    for _ in range(2):
        assert sorted(map(tuple, api.count_store(spark, [path], 30, 180, root=root).collect())) == wanted
    assert len(list((tmp_path / "store" / "length-position").iterdir())) == 1
