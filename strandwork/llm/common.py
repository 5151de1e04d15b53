"""What the training-data operators share: reading tables, cutting lineage in shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); one of our own only in local mode where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    A task that is lost later is computed again from these files, not from the whole plan before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(values: Iterable, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def list_column(lengths: Iterable[int], values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from its rows' lengths and their values, one after the other."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, type=kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_size(texts: list[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each; a longer text is a range of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (a long, b long) -> (node long, root long), root the smallest node.

    Alternates two steps until nothing changes: each node ties its larger neighbours, then its smaller ones, to the
    smallest node that it sees. The number of edges never grows, a node's neighbours are only ever reduced to their
    minimum (with partial sums before the shuffle) and joined back, so a hub needs no task of its own; a skewed join
    is split by adaptive execution. Each round is written to the shared folder. Nodes without an edge to another node
    are not returned.
    """
    spark = edges.sparkSession

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def written(df: DataFrame) -> DataFrame:
        return materialize(df.where("a <> b").distinct(), "components")

    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.select(larger.alias("a"), smaller.alias("b")))
    before = stamp(now)
    if not before[0]:
        return spark.createDataFrame([], "node long, root long")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        tied = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = tied.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        ties = down.join(least, "a")
        now = written(
            ties.select("a", F.col("m").alias("b")).unionByName(ties.select(F.col("b").alias("a"), F.col("m").alias("b")))
        )
        if (after := stamp(now)) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class WordIds(dict):
    """A 64-bit id for each word, the same everywhere; forgets what it has seen when it holds too many."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for t in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[t : t + n]
    return mix(out)


def positions(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Adds ``position``, from 0, of each row within its group by ``order``; rows that tie in it come in any order.

    Rows are dealt by ranges of group and order together, so a large group spans many tasks, and written. A row's place
    is its place in its task plus what earlier tasks hold of its group; only those counts are summed up by group.
    """
    keys = [*group, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, label).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_by_{c}" for c in [*group, "_part"]}
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnsRenamed(names)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    placed = rows.join(parts, same).withColumn("position", F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.select(*df.columns, "position")
