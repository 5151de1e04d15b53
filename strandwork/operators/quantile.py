"""Exact quantiles by group in bounded memory: rounds of counting between pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

PIVOTS = 63
ACCURACY = 1000  # of the sketch that proposes pivots
GATHER = 10_000  # values of a stretch that one task may hold


def group_key(by: list[str]):
    """A string that is equal where all of ``by`` are, nulls included."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], gather: int = GATHER) -> DataFrame:
    """(_g, n, q): ``q`` holds the quantile of each of ``shares`` by group key (see ``group_key``), linear between neighbours.

    The row of a rank is sought in a stretch of values, at first all of its group. A round takes 63 pivots of the stretch from
    a sketch, counts its rows between pivots, and goes on between the two that hold the rank: some 1/60 of the rows. A
    stretch of at most ``gather`` rows is sorted in a task, one of a single value needs no more. So no task holds more than a
    sketch, 127 counts or ``gather`` values of a quantile. Null values don't count; a group of nulls alone has no row.
    """
    rows = materialize(df.where(F.col(value).isNotNull()).select(group_key(by).alias("_g"), F.col(value).cast("double").alias("_x")), "values")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    share = F.posexplode(F.array(*map(F.lit, shares))).alias("_p", "_share")
    asked = sizes.select("*", share).withColumn("_at", F.col("_share") * (F.col("n") - 1))
    # _k: rows of the stretch before the rank; _size: rows of the stretch
    open_ = materialize(asked.select("_g", "n", "_p", F.floor("_at").alias("_k"), (F.col("_at") - F.floor("_at")).alias("_part"), "_low", "_high", F.col("n").alias("_size")), "stretches")
    source, key, closed = rows, ["_g"], []
    while True:
        flat, small = F.col("_low") == F.col("_high"), F.col("_size") <= gather
        closed.append(open_.where(flat).select("_g", "n", "_p", F.col("_low").alias("q")))
        kth = lambda i: F.element_at("_sorted", F.least(F.col("_k") + i, F.col("_size")).cast("int"))
        sorted_ = source.join(open_.where(~flat & small), key).where("_x between _low and _high").groupBy("_g", "n", "_p", "_k", "_part", "_size").agg(F.sort_array(F.collect_list("_x")).alias("_sorted"))
        closed.append(sorted_.select("_g", "n", "_p", (kth(1) + (kth(2) - kth(1)) * F.col("_part")).alias("q")))
        open_ = open_.where(~flat & ~small)
        if open_.isEmpty():
            break
        one = ["_g", "_p"]
        inside = materialize(source.join(open_.select(*one, "_low", "_high"), key).where("_x between _low and _high").select(*one, "_x"), "stretch")
        pivots = inside.groupBy(*one).agg(F.percentile_approx("_x", [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)], ACCURACY).alias("_pivots"))
        # a value that is a pivot has a cell of its own
        cell = F.size(F.filter("_pivots", lambda v: v < F.col("_x"))) + F.size(F.filter("_pivots", lambda v: v <= F.col("_x")))
        counts = inside.join(pivots, one).groupBy(*one, cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
        each = counts.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("_cell", "_n", "_min", "_max"))).alias("_c"))
        upto = F.expr("transform(_c, (c, i) -> aggregate(slice(_c, 1, i + 1), 0L, (t, d) -> t + d._n))")
        found = open_.drop("_low", "_high", "_size").join(each, one).withColumn("_upto", upto)
        # the cell of rank _k, and of the next rank
        here = F.size(F.filter("_upto", lambda u: u <= F.col("_k"))) + 1
        found = found.withColumns({"_i": here, "_before": F.when(here > 1, F.element_at("_upto", F.greatest(here - 1, F.lit(1)))).otherwise(F.lit(0))})
        found = found.withColumns({"_own": F.element_at("_c", F.col("_i")), "_end": F.element_at("_upto", F.col("_i"))})
        following = F.when(F.col("_i") < F.size("_c"), F.element_at("_c", F.least(F.col("_i") + 1, F.size("_c")))["_min"]).otherwise(F.col("_own._max"))
        parted = F.col("_k") + 1 == F.col("_end")
        found = materialize(found.withColumns({"_next": following, "_parted": parted}), "found")
        last = F.col("_own._max")
        closed.append(found.where("_parted").select("_g", "n", "_p", (last + (F.col("_next") - last) * F.col("_part")).alias("q")))
        open_ = found.where("not _parted").select(
            "_g", "n", "_p", (F.col("_k") - F.col("_before")).alias("_k"), "_part", F.col("_own._min").alias("_low"), F.col("_own._max").alias("_high"), F.col("_own._n").alias("_size")
        )
        source, key = inside, one
    whole = closed[0]
    for part in closed[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("_g", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "q"))), lambda s: s["q"]).alias("q"))
