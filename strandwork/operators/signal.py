"""Fragment signals: midpoint counts, histograms relative to sites, heatmaps, rolling values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LONG_FRAGMENT, SHORT_FRAGMENT
from ..functions import scalar
from .intervals import BIN, point_join


def midpoints(
    fragments: DataFrame, long: tuple[int, int] = LONG_FRAGMENT, short: tuple[int, int] = SHORT_FRAGMENT, offset: int = 0, strict: bool = False
) -> DataFrame:
    """(chr, ref_start, tlen) -> (chr, pos, cls, len) of the leftmost mates of either class; no mapping-quality filter.

    ``strict`` is the rule of the fits: bases have to be left after both offsets, and the class is that of what is left.
    """
    left = F.col("tlen") - 2 * offset
    cls = scalar.fragment_class(left if strict else F.col("tlen"), long, short)
    valid = (F.col("tlen") > 0) & (left > 0) if strict else (F.col("tlen") != 0) & (left >= 0)
    pos = scalar.fragment_midpoint(F.col("ref_start"), F.col("tlen"), offset)
    return fragments.where(valid).select("chr", pos.alias("pos"), cls.alias("cls"), F.abs("tlen").cast("int").alias("len")).where("cls is not null")


def midpoint_histogram(mids: DataFrame) -> DataFrame:
    """(chr, pos, cls) -> (chr, pos, cls, n): partial counts before the shuffle, so a hot base costs nothing more."""
    return mids.groupBy("chr", "pos", "cls").agg(F.count("*").alias("n"))


def length_position_counts(fragments: DataFrame, low: int, high: int, offset: int = 0) -> DataFrame:
    """(chr, len, pos, n) for fragments of a width in [low, high]."""
    keep = fragments.where(scalar.valid_fragment(F.col("tlen"), low, high, offset))
    pos = scalar.fragment_midpoint(F.col("ref_start"), F.col("tlen"), offset)
    return keep.groupBy("chr", F.abs("tlen").cast("int").alias("len"), pos.alias("pos")).agg(F.count("*").alias("n"))


def segment_counts(segments: DataFrame, mids: DataFrame, width: int = BIN) -> DataFrame:
    """Counts of midpoints by (segment_id, pos, cls), only those that aren't 0; segments may overlap."""
    at = midpoint_histogram(mids)
    met = point_join(at, segments.select("segment_id", "chr", "start", "end"), width=width)
    return met.select("segment_id", "chr", "pos", "cls", "n")


def dense_counts(segments: DataFrame, counts: DataFrame, classes: tuple[str, ...] = ("short", "long")) -> DataFrame:
    """Adds to each segment an array of counts by base for each class, zeros included (a segment is a few thousand bases).

    The counts of a segment are put in order once; each adds the zeros since the one before it and itself.
    """
    hit = F.struct(F.col("pos").cast("long").alias("pos"), F.col("n").cast("int").alias("n"))
    packed = counts.groupBy("segment_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("cls") == c, hit))).alias(f"_{c}") for c in classes))
    rows = segments.join(packed, "segment_id", "left")

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0), n.cast("int"))

    def dense(c: str) -> Column:
        hits, before = F.col(f"_{c}"), F.col("start") - 1
        each = F.transform(hits, lambda h, i: F.concat(zeros(h["pos"] - F.coalesce(F.get(hits, i - 1)["pos"], before) - 1), F.array(h["n"])))
        last = F.coalesce(F.try_element_at(hits, F.lit(-1))["pos"], before)
        return F.flatten(F.concat(F.coalesce(each, F.array().cast("array<array<int>>")), F.array(zeros(F.col("end") - last))))

    return rows.withColumns({c: dense(c) for c in classes}).drop(*(f"_{c}" for c in classes))


def around(sites: DataFrame, mids: DataFrame, reach: int, pos: str = "pos", strand: str | None = None) -> DataFrame:
    """Midpoints within ``reach`` of sites (site_id, chr, centre[, strand]): adds rel, mirrored on the strand ``-``."""
    ends = sites.select("site_id", "chr", "centre", *([strand] if strand else []), (F.col("centre") - reach).alias("_a"), (F.col("centre") + reach).alias("_b"))
    met = point_join(mids, ends, pos, ("_a", "_b")).drop("_a", "_b")
    rel = F.col(pos) - F.col("centre")
    return met.withColumn("rel", F.when(F.col(strand) == "-", -rel).otherwise(rel) if strand else rel)


def heatmap(sites: DataFrame, mids: DataFrame, reach: int, strand: str | None = None) -> DataFrame:
    """(len, rel, n): fragments by length and place relative to the sites."""
    return around(sites, mids, reach, strand=strand).groupBy("len", "rel").agg(F.count("*").alias("n"))


def pileup(heat: DataFrame, lengths: tuple[int, int], n_sites: int) -> DataFrame:
    """(rel, per_site): fragments of some lengths by place, for each site."""
    some = F.sum(F.when(F.col("len").between(*lengths), F.col("n")).otherwise(0))
    return heat.groupBy("rel").agg((some / F.lit(n_sites)).alias("per_site"))


def length_shares(heat: DataFrame) -> DataFrame:
    """(len, percent) of all fragments of a heatmap."""
    by = heat.groupBy("len").agg(F.sum("n").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("len", (100 * F.col("n") / F.col("total")).alias("percent"))  # total is one row


def site_count_histogram(sites: DataFrame, mids: DataFrame, reach: int) -> DataFrame:
    """(rel, value, n): how many sites (a row each) have ``value`` midpoints at ``rel``; sites without any count as value 0."""
    offsets = F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).alias("rel")
    every = sites.agg(F.count("*").alias("sites")).select("sites", offsets)
    # Sites of one place have the same counts, and places meet only the bases around them.
    places = sites.groupBy("chr", "centre").agg(F.count("*").alias("_sites")).select("chr", "centre", "_sites", offsets)
    places = places.select("chr", (F.col("centre") + F.col("rel")).alias("pos"), "rel", "_sites")
    counts = mids.groupBy("chr", "pos").agg(F.count("*").alias("value"))
    seen = places.hint("merge").join(counts, ["chr", "pos"]).groupBy("rel", "value").agg(F.sum("_sites").alias("n"))
    zero = every.join(seen.groupBy("rel").agg(F.sum("n").alias("some")), "rel", "left").select(
        "rel", F.lit(0).cast("long").alias("value"), (F.col("sites") - F.coalesce("some", F.lit(0))).alias("n")
    )
    return seen.unionByName(zero.where("n > 0"))


def density(points: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 10) -> DataFrame:
    """(x_bin, y_bin, n): a two-dimensional histogram with ``bins`` equal bins a side; the upper end is in the last bin."""

    def at(c: str, low: float, high: float) -> Column:
        return F.least(F.lit(bins), F.width_bucket(F.col(c).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)))

    keep = points.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return keep.groupBy(at(x, *x_range).cast("int").alias("x_bin"), at(y, *y_range).cast("int").alias("y_bin")).agg(F.count("*").alias("n"))


def rolling(df: DataFrame, values: dict[str, Column], reach: int, keys: tuple[str, ...] = ("chr",), at: str = "pos", width: int = BIN) -> DataFrame:
    """Adds aggregates over the rows whose ``at`` lies within ``reach``; ``values`` maps names to aggregate columns.

    Rows are dealt to bins of positions, and to the next bin if they lie within ``reach`` of it; each row's own window
    lies whole in its home bin. So neither a long chromosome nor a hot one needs a task of its own.
    """
    bins = F.sequence(F.floor((F.col(at) - reach) / width), F.floor((F.col(at) + reach) / width))
    rows = df.withColumn("_bin", F.explode(bins))
    window = Window.partitionBy(*keys, "_bin").orderBy(at).rangeBetween(-reach, reach)
    rows = rows.withColumns({name: agg.over(window) for name, agg in values.items()})
    return rows.where(F.col("_bin") == F.floor(F.col(at) / width)).drop("_bin")
