"""Intervals on chromosomes: joins, islands, tiles, coverage, stitching, linkers.

Intervals are 1-based and closed unless a function says otherwise. Every join has the chromosome and a bin of positions
as equality keys, so no pair of far-away rows meets; every running value is computed in bins of even numbers of rows and
then over bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_probability
from ..storage import materialize

BIN = 1 << 14
NARROW = 1 << 10  # bins of stretches of some hundred positions
CELL = 1 << 8  # positions whose rows are never parted
BINS_A_TASK = 32


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_ends: tuple[str, str] = ("start", "end"),
    right_ends: tuple[str, str] = ("r_start", "r_end"),
    key: str = "chr",
    width: int = BIN,
) -> DataFrame:
    """Pairs of rows on one chromosome that overlap (left.start <= right.end and left.end >= right.start).

    Both sides are dealt to the bins that they touch; a pair is kept in the first bin that both touch. Columns other
    than ``key`` must differ between the sides. Backwards and null intervals overlap nothing.
    """
    (a, b), (c, d) = left_ends, right_ends
    one = left.where(F.col(a) <= F.col(b)).withColumn("_bin", F.explode(_bins(F.col(a), F.col(b), width)))
    two = right.where(F.col(c) <= F.col(d)).withColumn("_bin", F.explode(_bins(F.col(c), F.col(d), width)))
    first = F.greatest(F.floor(F.col(a) / width), F.floor(F.col(c) / width))
    met = one.join(two, [key, "_bin"]).where((F.col(a) <= F.col(d)) & (F.col(b) >= F.col(c)) & (F.col("_bin") == first))
    return met.drop("_bin")


def point_join(
    points: DataFrame, intervals: DataFrame, pos: str = "pos", ends: tuple[str, str] = ("start", "end"), key: str = "chr", width: int = BIN
) -> DataFrame:
    """Pairs of a point and an interval that holds it. Only intervals are dealt to several bins."""
    a, b = ends
    one = points.withColumn("_bin", F.floor(F.col(pos) / width))
    two = intervals.where(F.col(a) <= F.col(b)).withColumn("_bin", F.explode(_bins(F.col(a), F.col(b), width)))
    return one.join(two, [key, "_bin"]).where(F.col(pos).between(F.col(a), F.col(b))).drop("_bin")


def contained(segments: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Segments (chr, start, end, ...) that lie whole in a region (chr, r_start, r_end, ...), with the region."""
    met = overlap_join(segments, regions, width=width)
    return met.where("start >= r_start and end <= r_end")


def binned(df: DataFrame, at: str, key: str = "chr", width: int | None = None) -> DataFrame:
    """Adds ``_bin``, which grows with ``at``: bins of ``width`` positions, or else of even numbers of rows.

    Even bins are cut between cells of 256 positions after their rows are counted, some 32 bins for each shuffle partition, so
    a task holds about the mean however rows lie. A bin holds its share and at most one cell more. Rows without a
    place or key have no bin and go.
    """
    if width:
        return df.withColumn("_bin", F.floor(F.col(at) / width))
    bins = BINS_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_cell", F.floor(F.col(at) / CELL))
    cells = rows.where(F.col("_cell").isNotNull() & F.col(key).isNotNull()).groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    share = cells.agg(F.greatest(F.lit(1), F.ceil(F.sum("_n") / bins)).alias("_share"))  # one row
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cells.join(F.broadcast(share)).select(key, "_cell", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / F.col("_share")).alias("_bin"))
    return rows.join(cuts, [key, "_cell"]).drop("_cell")


def running(
    df: DataFrame, value: Column, how: str, name: str, order: list[str], key: str = "chr", at: str = "start", width: int | None = None, own: bool = True
) -> DataFrame:
    """Adds the running max or sum of ``value`` over the rows of a chromosome up to and including each (without ``own``: up to
    the one before it), by ``order``.

    Rows run in bins of ``at`` (the first of ``order``), see ``binned``; then one row for each bin runs over the bins. So a
    chromosome with a third of all rows is spread like any other. Rows are read twice.
    """
    f = {"max": F.max, "sum": F.sum}[how]
    rows = binned(df, at, key, width).withColumn("_v", value)
    inside = Window.partitionBy(key, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(key, "_bin").agg(f("_v").alias("_all")).withColumn("_before", f("_all").over(before)).drop("_all")
    rows = rows.withColumn("_in", f("_v").over(inside)).join(bins, [key, "_bin"])
    zero = F.lit(0)
    both = F.greatest("_in", "_before") if how == "max" else F.coalesce("_in", zero) + F.coalesce("_before", zero)
    return rows.withColumn(name, both).drop("_bin", "_v", "_in", "_before")


def islands(df: DataFrame, gap: int = 1, width: int | None = None) -> DataFrame:
    """Adds ``island`` (from 0 by chromosome) to (chr, start, end): rows that touch, or lie less than ``gap`` + 1 apart.

    A row begins an island if it starts after the greatest end before it plus ``gap``. Rows are written as they come; only
    their different spans run, are written with the mark of a new island, and give their island back to the rows.
    """
    order = ["start", "end"]
    whole = materialize(df, "intervals")
    rows = materialize(binned(whole.select("chr", *order).distinct(), "start", width=width), "spans")
    inside = Window.partitionBy("chr", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("chr", "_bin").agg(F.max("end").alias("_all")).withColumn("_carried", F.max("_all").over(before)).drop("_all")
    rows = rows.withColumn("_reach", F.max("end").over(inside)).join(bins, ["chr", "_bin"])
    new = F.col("start") > F.coalesce(F.greatest("_reach", "_carried"), F.lit(-(1 << 62))) + gap
    rows = materialize(rows.select("chr", *order, "_bin", new.cast("long").alias("_new")), "islands")
    counts = rows.groupBy("chr", "_bin").agg(F.sum("_new").alias("_all")).withColumn("_before", F.sum("_all").over(before)).drop("_all")
    upto = Window.partitionBy("chr", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_in", F.sum("_new").over(upto)).join(counts, ["chr", "_bin"])
    return whole.join(found.select("chr", *order, (F.col("_in") + F.coalesce("_before", F.lit(0)) - 1).alias("island")), ["chr", *order])


def island_extents(df: DataFrame, gap: int = 1) -> DataFrame:
    """(chr, start, end) -> (chr, island, start, end, n) of each island."""
    found = islands(df, gap)
    return found.groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def tiles(sizes: DataFrame, length: int = 5000, overlap: int = 1000) -> DataFrame:
    """(chr, size) -> (chr, start, end): segments of ``length`` bases, each beginning ``length - overlap`` after the last."""
    step = length - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col("size") - overlap) / step) - 1)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("_i")
    rows = sizes.where("size > 0").select("chr", "size", starts)
    start = F.col("_i") * step + 1
    return rows.select("chr", start.alias("start"), F.least(start + length - 1, F.col("size")).alias("end"))


def coverage(df: DataFrame) -> DataFrame:
    """(chr, start, end) -> (chr, start, end, depth): the maximal stretches between changes of the number of rows."""
    ends = df.where("start <= end")
    steps = ends.select("chr", F.col("start").alias("pos"), F.lit(1).alias("d")).unionByName(
        ends.select("chr", (F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))
    )
    steps = materialize(steps.groupBy("chr", "pos").agg(F.sum("d").alias("d")).where("d <> 0"), "steps")
    runs = running(steps, F.col("d"), "sum", "depth", ["pos"], at="pos")
    after = following(runs, "pos", "next")
    return after.where("depth > 0").select("chr", F.col("pos").alias("start"), (F.col("next") - 1).alias("end"), "depth")


def following(df: DataFrame, at: str, name: str, width: int | None = None) -> DataFrame:
    """Adds the next greater ``at`` of the chromosome, or null; ``at`` is distinct by chromosome."""
    rows = binned(df, at, width=width)
    inside = Window.partitionBy("chr", "_bin").orderBy(at)
    bins = rows.groupBy("chr", "_bin").agg(F.min(at).alias("_min"))
    bins = bins.withColumn("_next", F.lead("_min").over(Window.partitionBy("chr").orderBy("_bin"))).drop("_min")
    rows = rows.withColumn("_lead", F.lead(at).over(inside)).join(bins, ["chr", "_bin"])
    return rows.withColumn(name, F.coalesce("_lead", "_next")).drop("_bin", "_lead", "_next")


def per_base(df: DataFrame) -> DataFrame:
    """Adds ``pos``, a row for each base of [start, end]."""
    return df.where("start <= end").withColumn("pos", F.explode(F.sequence("start", "end")))


def stitch(df: DataFrame, values: list[str], by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Averages per-base values over the segments that cover a base, cleaned as probabilities."""
    return df.groupBy(*by).agg(*(clean_probability(F.avg(v)).alias(v) for v in values), F.count("*").alias("n_segments"))


def trimmed(df: DataFrame, segments: DataFrame, values: list[str], trim: int = 500, by: tuple[str, ...] = ("chr", "pos")) -> DataFrame:
    """Per-base values (chr, pos, start, end of their segment) without those within ``trim`` of a segment's edge: (by, values).

    Instead of averaging overlaps. The first and the last segment of a chromosome keep their outer edges; of segments that
    still overlap the last one counts. Bases that no trimmed segment holds have no row.
    """
    ends = segments.groupBy("chr").agg(F.min("start").alias("_first"), F.max("end").alias("_last"))  # a row for each chromosome
    low, high = (F.col("pos") >= F.col("start") + trim) | (F.col("start") == F.col("_first")), (F.col("pos") <= F.col("end") - trim) | (F.col("end") == F.col("_last"))
    last = F.struct("start", "end")
    return df.join(ends, "chr").where(low & high).groupBy(*by).agg(*(clean_probability(F.max_by(v, last)).alias(v) for v in values))


def uncovered(region: DataFrame, segments: DataFrame) -> DataFrame:
    """Stretches (chr, start, end) of regions (chr, r_start, r_end) that no segment covers."""
    ends = segments.select("chr", "start", "end")
    met = overlap_join(ends, region.select("chr", "r_start", "r_end"))
    cut = met.select("chr", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    both = cut.unionByName(region.select("chr", F.col("r_start").alias("start"), F.col("r_end").alias("end")))
    # A base is uncovered if only the region itself is there.
    runs = coverage(both)
    return runs.where("depth = 1").select("chr", "start", "end")


def nearest_below(asked: DataFrame, marks: DataFrame, who: str, name: str, key: str = "chr") -> DataFrame:
    """(key, at) and marks (key, pos, who) -> (key, at, name) for the distinct places: the nearest marks below ``at``, for ``other_than``.

    Marks are taken by place and places in order, so it doesn't matter how many marks lie between. Marks without ``who`` go.
    """
    places = marks.where(F.col(who).isNotNull()).groupBy(key, "pos").agg(F.min(who).alias("_least"), F.max(who).alias("_most"))
    places = materialize(places, "places")
    # Of a run of places of one and the same alone, each knows the last place before the run.
    before = running(places, F.struct("pos", "_least", "_most"), "max", "_last", ["pos"], key, "pos", own=False)
    same = (F.col("_last._least") == F.col("_least")) & (F.col("_last._most") == F.col("_most")) & (F.col("_least") == F.col("_most"))
    before = before.select(*places.columns, F.when(~F.coalesce(same, F.lit(False)), F.col("_last.pos")).alias("_past"))
    runs = running(materialize(before, "places"), F.col("_past"), "max", "_else", ["pos"], key, "pos")
    near = F.struct("pos", "_least", "_most", "_else")
    rows = runs.select(key, "pos", near.alias("_near"), F.lit(True).alias("_mark"))
    places = asked.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, F.col("at").alias("pos")).distinct()
    rows = materialize(rows.unionByName(places.withColumn("_mark", F.lit(False)), allowMissingColumns=True), "places")
    found = running(rows, F.col("_near"), "max", name, ["pos", "_mark"], key, "pos")
    return found.where("not _mark").select(key, F.col("pos").alias("at"), name)


def other_than(who: Column, near: Column) -> Column:
    """Of what ``nearest_below`` found, the nearest place with a mark that isn't of ``who`` alone; null if there is none."""
    alone = (near["_least"] == who) & (near["_most"] == who)
    return F.when(alone, near["_else"]).when(who.isNotNull(), near["pos"])


def linkers(dyads: DataFrame, half: int = 73, width: int = 15) -> DataFrame:
    """(chr, dyad) -> two half-open stretches [start, end) beside each nucleosome; none where the left one would pass 0."""
    d = F.col("dyad")
    pair = F.array(
        F.struct((d - half - width).alias("start"), (d - half).alias("end")), F.struct((d + half).alias("start"), (d + half + width).alias("end"))
    )
    return dyads.where(d - half - width > 0).select("chr", "dyad", F.explode(pair).alias("x")).select("chr", "dyad", "x.start", "x.end")


def first_match(rows: DataFrame, points: list[str], marks: DataFrame, pos: str, order: str, row_id: str, reach: int, value: str, name: str) -> DataFrame:
    """(row_id, name): the ``value`` of the first mark within ``reach`` of a row's points, by the points' order, then the
    marks'. marks: (chr, pos, order, value). Rows without a match are left out; null points match nothing."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(p).alias("_p")) for i, p in enumerate(points))))
    each = rows.select(row_id, "chr", pairs.alias("x")).select(row_id, "chr", "x.i", "x._p").where("_p is not null")
    first = F.min(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v"))).alias("_first")
    near = marks.groupBy("chr", F.col(pos).alias("_m")).agg(first).select("chr", (F.col("_m") - reach).alias("_from"), (F.col("_m") + reach).alias("_to"), "_first")
    met = point_join(each, near, "_p", ("_from", "_to"), width=2 * reach + 1)
    return met.groupBy(row_id).agg(F.min(F.struct("i", "_first"))["_first"]["_v"].alias(name))


def names_at(rows: DataFrame, points: list[str], spans: DataFrame, ends: tuple[str, str], value: str, row_id: str, name: str) -> DataFrame:
    """(row_id, name): the distinct sorted comma-joined ``value`` of spans that hold one of a row's points strictly inside."""
    each = rows.select(row_id, "chr", F.explode(F.array(*points)).alias("_p")).where("_p is not null")
    a, b = ends
    inner = spans.select("chr", (F.col(a) + 1).alias("_from"), (F.col(b) - 1).alias("_to"), F.col(value).alias("_v"))
    return point_join(each, inner, "_p", ("_from", "_to"), width=NARROW).groupBy(row_id).agg(F.array_join(F.sort_array(F.collect_set("_v")), ",").alias(name))
