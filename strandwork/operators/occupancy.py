"""Posteriors by state made into occupancy by binding factor, and the weights learned from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import motif_family


def by_factor(posterior: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """(keys, state, prob) and (state, dbf) -> (keys, dbf, prob): sums over the states of each factor; a state may be in
    several. The map of states is as small as the model, so it is broadcast."""
    return posterior.join(F.broadcast(states), "state").groupBy(*keys, "dbf").agg(F.sum("prob").alias("prob"))


def wide(occupancy: DataFrame, factors: list[str], keys: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """A column for each factor, 0 where it has no row."""
    values = (F.coalesce(F.sum(F.when(F.col("dbf") == f, F.col("prob"))), F.lit(0.0)).alias(f) for f in factors)
    return occupancy.groupBy(*keys).agg(*values)


def families(occupancy: DataFrame, threshold: float, keys: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Sums motif variants by family; drops families that never reach ``threshold``, and smaller values."""
    by = occupancy.groupBy(*keys, motif_family(F.col("dbf")).alias("family")).agg(F.sum("prob").alias("prob"))
    return by.where(F.col("prob") >= threshold)


def weights(starts: DataFrame) -> DataFrame:
    """(segment_id, dbf, expected) -> (dbf, weight): expected entries by factor as shares of all; segments whose sum
    isn't a sensible number don't count."""
    sums = starts.groupBy("segment_id").agg(F.sum("expected").alias("_all"))
    sane = starts.join(sums.where(F.abs("_all") <= 1e10), "segment_id").groupBy("dbf").agg(F.sum("expected").alias("n"))
    total = sane.agg(F.sum("n").alias("total"))
    return sane.crossJoin(F.broadcast(total)).select("dbf", (F.col("n") / F.col("total")).alias("weight"))  # total is one row


def capped(weight: DataFrame, cap: float, exempt: str = "unknown", fixed: tuple[str, ...] = ("background", "nucleosome")) -> DataFrame:
    """Factors over ``cap`` get it, all others are scaled to what is left, once; ``exempt`` and ``fixed`` ones have no cap.

    Unchanged if no factor exceeds the cap.
    """
    over = ~F.col("dbf").isin(exempt, *fixed) & (F.col("weight") > cap)
    sums = weight.agg(F.count_if(over).alias("_n"), F.sum(F.when(~over, F.col("weight"))).alias("_rest"))
    scaled = F.when(over, F.lit(cap)).otherwise(F.col("weight") * (1 - F.col("_n") * cap) / F.col("_rest"))
    one_row = weight.crossJoin(F.broadcast(sums))
    return one_row.select("dbf", F.when(F.col("_n") > 0, scaled).otherwise(F.col("weight")).alias("weight"))


def best_variant(scores: DataFrame) -> DataFrame:
    """(tf, variant, width, chr, pos, score) -> the best variant of each base; the first by name of equals."""
    best = scores.groupBy("tf", "chr", "pos").agg(F.max("score").alias("score"), F.min(F.struct(-F.col("score"), "variant", "width")).alias("_b"))
    return best.select("tf", "chr", "pos", "score", F.col("_b.variant").alias("variant"), F.col("_b.width").alias("width"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, with null for columns that one lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
