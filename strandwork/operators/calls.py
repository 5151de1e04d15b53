"""Greedy calls of peaks along chromosomes.

A row is picked if no picked row of a higher score (the first of equals) covers it. Rows are decided in stretches of a
chromosome, each with the rows around it that could cover one of its own: whatever hangs on rows inside alone is decided at
once, the rest in the next round, with stretches that begin half a stretch later. No task holds more than a stretch, however
dense a track is; most rows are decided in the first round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DYAD_REACH, SITE_FLOOR
from ..storage import materialize
from .intervals import point_join

#: Positions of a stretch.
STRETCH = 1 << 17
#: Rounds after which the picks so far are written as one table.
TOGETHER = 16


def _round(rows: DataFrame, reach: int, shift: int, width: int) -> DataFrame:
    """(chr, pos, score, begin, end, picked, ...) -> the undecided rows that are picked now, or stay undecided."""
    columns, home = rows.columns, F.floor((F.col("pos") + shift) / width)
    bins = F.sequence(F.floor((F.col("pos") + shift - reach) / width), F.floor((F.col("pos") + shift + reach) / width))
    open_ = rows.where("not picked").select("chr", home.alias("_bin")).distinct()
    dealt = rows.withColumn("_home", home).withColumn("_bin", F.explode(bins)).join(open_, ["chr", "_bin"], "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        pos, score, known = (pdf[c].to_numpy() for c in ("pos", "score", "picked"))
        own = (pdf["_home"] == pdf["_bin"]).to_numpy()
        low, high = np.searchsorted(pos, pdf["begin"].to_numpy()), np.searchsorted(pos, pdf["end"].to_numpy())
        gone, doubtful, kept, now = (np.zeros(len(pos), bool) for _ in range(4))
        for i in np.lexsort((pos, -score)).tolist():
            if known[i]:
                gone[low[i] : high[i]] = True
            elif gone[i]:
                continue
            elif doubtful[i] or not own[i]:
                doubtful[low[i] : high[i]] = True
                kept[i] = own[i]
            else:
                gone[low[i] : high[i]] = True
                kept[i] = now[i] = True
        return pdf.assign(picked=now)[kept][columns]

    return dealt.groupBy("chr", "_bin").applyInPandas(run, rows.schema)


def picks(rows: DataFrame, reach: int, width: int = STRETCH) -> DataFrame:
    """(chr, pos, score, begin, end, ...) -> the rows that are picked; a row covers [begin, end), which lies within ``reach``
    of it. The number of rounds is that of stretches along the longest chain of rows that wait for each other."""
    columns = rows.columns
    left, found, r = materialize(rows.withColumn("picked", F.lit(False)), "peaks"), [], 0
    while not left.isEmpty():
        both = reduce(DataFrame.unionByName, found, left)
        decided = materialize(_round(both, reach, r % 2 * (width // 2), width), "peaks")
        found.append(decided.where("picked"))
        left, r = decided.where("not picked"), r + 1
        if len(found) >= TOGETHER:
            found = [materialize(reduce(DataFrame.unionByName, found), "peaks")]
    return reduce(DataFrame.unionByName, found, left).select(*columns)


def dyads(scores: DataFrame, reach: int = DYAD_REACH, width: int = STRETCH) -> DataFrame:
    """(chr, pos, dyad_score, occ_score, first, last) -> (chr, dyad, dyad_score, avg_occ_score, min_occ_score).

    first and last are the ends of the row's island; bases without a row score 0. The highest score that is not yet
    suppressed (the first of equals) suppresses ``reach`` bases to either side; it is a call if those lie in the island
    and none was suppressed before. No rows give none; a null score counts 0.
    """
    size, pos = 2 * reach + 1, F.col("pos")
    rows = scores.where("dyad_score > 0").select(
        "chr", "pos", F.col("dyad_score").alias("score"), (pos - reach).alias("begin"), (pos + reach + 1).alias("end"), "first", "last"
    )
    found = materialize(picks(rows, reach, width), "picks")
    near = found.select("chr", pos.alias("dyad"), F.col("score").alias("dyad_score"), (pos - 2 * reach).alias("_from"), (pos + 2 * reach).alias("_to"))
    earlier = F.struct("score", -pos) > F.struct("dyad_score", -F.col("dyad"))
    touched = point_join(found.select("chr", "pos", "score"), near, ends=("_from", "_to")).where(earlier)
    free = found.where("begin >= first and end - 1 <= last").join(touched.select("chr", F.col("dyad").alias("pos")), ["chr", "pos"], "left_anti")
    called = free.select("chr", pos.alias("dyad"), F.col("score").alias("dyad_score"), "begin", (F.col("end") - 1).alias("_to"))
    around = point_join(scores.select("chr", "pos", F.coalesce("occ_score", F.lit(0.0)).alias("_occ")), called, ends=("begin", "_to"))
    least = F.when(F.count("*") == size, F.min("_occ")).otherwise(0.0)
    return around.groupBy("chr", "dyad", "dyad_score").agg((F.sum("_occ") / size).alias("avg_occ_score"), least.alias("min_occ_score"))


def sites(scores: DataFrame, floor: float = SITE_FLOOR, width: int = STRETCH) -> DataFrame:
    """(tf, chr, pos, width, score, first, last) -> (tf, chr, start, end, width, score).

    first and last are the ends of the row's island. The highest score at or over ``floor`` (the first of equals), at i,
    suppresses [i - width, i + 2 width) within the island; the call is placed at the middle of that stretch. No rows
    give none; null scores are left out.
    """
    widest = int(scores.agg(F.max("width")).first()[0] or 1)
    begin, end = F.greatest(F.col("pos") - F.col("width"), "first"), F.least(F.col("pos") + 2 * F.col("width"), F.col("last") + 1)
    rows = scores.where(F.col("score") >= floor).select(
        "tf", F.col("chr").alias("_chr"), F.concat_ws("\x01", "tf", "chr").alias("chr"), "pos", "width", "score", begin.alias("begin"), end.alias("end")
    )
    at = F.floor((F.col("begin") + F.col("end")) / 2)
    return picks(rows, 2 * widest, width).select(
        "tf", F.col("_chr").alias("chr"), at.alias("start"), (at + F.col("width")).alias("end"), F.col("width").cast("int").alias("width"), "score"
    )
