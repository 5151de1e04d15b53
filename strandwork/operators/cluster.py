"""k-means over columns of linked samples, by a rule that any engine can follow: farthest-first seeds, then Lloyd's rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import KMEANS_ROUNDS
from ..storage import materialize


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.asarray(batch.column(0).flatten(), dtype=float).reshape(-1, d)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each row of x and a column for each centre."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _seeds(vectors: DataFrame, d: int, k: int) -> np.ndarray:
    """The least vector, then always the one farthest from all seeds so far; of equally far ones the least. Fewer than k if
    there are fewer different vectors. A task gives one candidate."""
    first = vectors.orderBy("_v").limit(1).collect()
    found = [first[0]["_v"]] if first else []
    while found and len(found) < k:
        centres = np.array(found)

        def farthest(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            best: tuple[float, list[float]] | None = None
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, d)
                    far = _distances(x, centres).min(axis=1)
                    top = float(far.max())
                    if best is None or top >= best[0]:
                        one = min(x[far == top].tolist())
                        best = (top, one) if best is None or top > best[0] else (top, min(one, best[1]))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.list_(pa.float64()))], ["far", "_v"])

        best = vectors.mapInArrow(farthest, "far double, _v array<double>").orderBy(F.desc("far"), "_v").first()
        if best["far"] == 0:
            break
        found.append(best["_v"])
    return np.array(found)


def _moved(vectors: DataFrame, d: int, centres: np.ndarray) -> np.ndarray:
    """The mean of each centre's vectors; a centre without any stays. A task gives a count and sums for each centre."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), dtype=np.int64), np.zeros(centres.shape)
        for batch in batches:
            x = _matrix(batch, d)
            near = _distances(x, centres).argmin(axis=1)
            n += np.bincount(near, minlength=len(centres))
            np.add.at(total, near, x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], ["c", "n", "s"])

    parts = vectors.mapInArrow(sums, "c int, n long, s array<double>").where("n > 0").select("c", "n", F.posexplode("s").alias("i", "x"))
    moved = centres.copy()
    for r in parts.groupBy("c", "i").agg((F.sum("x") / F.sum("n")).alias("mean")).collect():
        moved[r["c"], r["i"]] = r["mean"]
    return moved


def _clustered(df: DataFrame, columns: list[str], k: int, rounds: int) -> DataFrame:
    """Adds ``cluster``, from 0 in order of the mean of the cluster's centre; ties of distance go to the earlier seed.

    What the driver sees is k centres; rows are written once, and each round reads their vectors only. Rounds end when no
    centre moves. Equal rows share a cluster, whatever the partitioning; an empty table gains an empty column.
    """
    rows = materialize(df.withColumn("_v", F.array(*columns)), "clusters")
    vectors, d = rows.select("_v"), len(columns)
    centres = _seeds(vectors, d, k)
    for _ in range(rounds if len(centres) else 0):
        moved = _moved(vectors, d, centres)
        done = np.abs(moved - centres).max() <= 1e-12 * max(1.0, np.abs(centres).max())
        centres = moved
        if done:
            break
    place = np.argsort(np.argsort([c.mean() for c in centres], kind="stable"), kind="stable")

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(place[_distances(np.stack(v.to_numpy()), centres).argmin(axis=1)] if len(v) else [], dtype="int32")

    return rows.withColumn("cluster", nearest("_v")).drop("_v")


def cluster_occupancy(linked: DataFrame, columns: list[str], k: int, rounds: int = KMEANS_ROUNDS) -> DataFrame:
    """Adds occ_cluster (from 1, by growing mean) over columns clipped to 1, with 0 for missing values."""
    clipped = {f"_{c}": F.least(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for c in columns}
    found = _clustered(linked.withColumns(clipped), list(clipped), k, rounds)
    return found.withColumn("occ_cluster", F.col("cluster") + 1).drop("cluster", *clipped)


def cluster_scaled(df: DataFrame, columns: list[str], k: int, rounds: int = KMEANS_ROUNDS) -> DataFrame:
    """Adds ``cluster`` over columns with 0 for missing values, less their mean and by population standard deviation."""
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    stats = df.select(*(e.alias(c) for c, e in filled.items())).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = {f"_{c}": (e - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit(stats[f"s_{c}"] or 1.0) for c, e in filled.items()}
    return _clustered(df.withColumns(scaled), list(scaled), k, rounds).drop(*scaled)
