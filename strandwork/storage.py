"""Results kept in the folder that all executors share."""

from __future__ import annotations

import contextlib
import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, written double"
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet and reads it again: what is used several times is computed once, and survives an executor."""
    base = _scratch[-1] if _scratch else shared_dir(df.sparkSession)
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """A path and the file system that it lies in, as Spark sees them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _path(spark, path)
    fs.delete(place, True)


def _children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of change in seconds) of what lies in a folder; nothing if there is none."""
    place, fs = _path(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(place)] if fs.exists(place) else []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What ``materialize`` writes within goes to one folder, which is deleted at the end: write results that are to stay
    before that."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield path
    finally:
        _scratch.remove(path)
        _delete(spark, path)


def version(spark: SparkSession, name: str, inputs: list[str], params: dict) -> str:
    """A key of a result: its name, parameters, and the path, size and time of change of every input file.

    Files are listed by Spark, which opens none of them, and hashed by tasks; the driver sees one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select("path", "length", F.col("modificationTime").cast("double").alias("at")) if inputs else None
    seen = None
    if files is not None:
        parts = [F.sum(F.xxhash64("path", "length", "at", F.lit(i)).cast("decimal(38,0)")).cast("string").alias(f"h{i}") for i in range(2)]
        seen = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), *parts).first().asDict()
    text = json.dumps([name, sorted(inputs), seen, params], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def kept(name: str, build: Callable[[], DataFrame], spark: SparkSession, inputs: list[str], params: dict, root: str | None = None) -> DataFrame:
    """What ``build`` gives, from the store if it was built before from the same files with the same parameters.

    A result is ``root/name/version/run``; a line of the version's manifest names the run once it is whole, so a write that was
    cut off is never taken. Of two runs at one time the earlier line counts. By default the store is in the shared folder.
    """
    home = f"{root or shared_dir(spark) + '/kept'}/{name}/{version(spark, name, inputs, params)}"
    if not _children(spark, f"{home}/manifest"):
        run = uuid.uuid4().hex
        with scratch(spark):
            build().write.parquet(f"{home}/{run}")
        spark.createDataFrame([(run, time.time())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{home}/manifest")
    run = spark.read.schema(MANIFEST).parquet(f"{home}/manifest").orderBy("written", "run").first()["run"]
    return spark.read.parquet(f"{home}/{run}")


def expire(spark: SparkSession, seconds: float, root: str | None = None) -> list[str]:
    """Deletes results whose manifest is older than ``seconds``, and runs that old which no manifest took; names what went.

    Readers of a result that is deleted fail, so ``seconds`` has to exceed the longest job.
    """
    base, gone, before = root or f"{shared_dir(spark)}/kept", [], time.time() - seconds
    for name, _ in _children(spark, base):
        for key, _ in _children(spark, f"{base}/{name}"):
            home = f"{base}/{name}/{key}"
            found = _children(spark, home)
            lines = spark.read.schema(MANIFEST).parquet(f"{home}/manifest").orderBy("written", "run").first() if ("manifest" in dict(found)) else None
            old = [f"{home}/{run}" for run, changed in found if run != "manifest" and (lines is None or run != lines["run"]) and changed < before]
            if lines and lines["written"] < before:
                old = [home]
            for path in old:
                _delete(spark, path)
            gone += old
    return gone
