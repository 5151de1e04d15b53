"""Differences between samples: merged site scores, statistics by cluster, z-scores of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DIFF_ABS, DIFF_P, DYAD_MARK, HALF_NUCLEOSOME, SHIFT_THRESHOLD, SITE_MIN_SCORE, TABLE_MIN_PERCENT
from ..functions.scalar import sample_suffix, t_quantile, two_sided_p
from .intervals import overlap_join, point_join
from .link import pair_category
from .quantile import group_key, quantiles


def merge_sites(samples: list[DataFrame], keys: tuple[str, ...] = ("tf", "chr", "start", "end"), minimum: float = SITE_MIN_SCORE) -> DataFrame:
    """Sites (keys, score) of ordered samples -> keys and scoreA, scoreB, ...; kept if any score exceeds ``minimum``.

    One aggregation of the samples' union instead of a chain of full joins: each row is shuffled once.
    """
    n = len(samples)
    rows = reduce(DataFrame.unionByName, (s.select(*keys, "score", F.lit(i).alias("_i")) for i, s in enumerate(samples)))
    merged = rows.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("score"))).alias(f"score{sample_suffix(i)}") for i in range(n)))
    return merged.where(reduce(lambda a, b: a | b, (F.coalesce(f"score{sample_suffix(i)}", F.lit(0.0)) > minimum for i in range(n))))


def percent_by_cluster(genes: DataFrame, sizes: DataFrame, clusters: list[int], minimum: float = TABLE_MIN_PERCENT) -> DataFrame:
    """(tf, gene, cluster) and (cluster, size) -> tf and a column c1, c2, ... of the percentage of a cluster's genes with a
    site; rows that are all zero, all over ``minimum`` or nowhere over it are left out."""
    n = genes.groupBy("tf", "cluster").agg(F.countDistinct("gene").alias("n"))
    share = n.join(sizes, "cluster").select("tf", "cluster", (100 * F.col("n") / F.col("size")).alias("p"))
    columns = [f"c{c + 1}" for c in clusters]
    wide = share.groupBy("tf").pivot("cluster", clusters).agg(F.first("p"))
    wide = wide.select("tf", *(F.coalesce(F.col(str(c)), F.lit(0.0)).alias(k) for c, k in zip(clusters, columns, strict=True)))
    over = F.array(*columns)
    return wide.where(F.exists(over, lambda p: p > minimum) & ~F.forall(over, lambda p: p > minimum))


def mean_change(sites: DataFrame, scores: list[str], by: tuple[str, ...] = ("cluster", "tf")) -> DataFrame:
    """(by, diff of each later score to the first): sums of known differences over the number of all rows."""
    changes = [(F.sum(F.col(s) - F.col(scores[0])) / F.count("*")).alias(f"diff_{s}") for s in scores[1:]]
    return sites.groupBy(*by).agg(F.count("*").alias("n"), *changes)


def spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, low, q1, median, q3, high): quartiles, and two population standard deviations around the mean."""
    mean, sd = F.avg(value), F.stddev_pop(value)
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), mean.alias("mean"), (mean - 2 * sd).alias("low"), (mean + 2 * sd).alias("high"))
    found = quantiles(df, value, by, [0.25, 0.5, 0.75]).select("_g", "q")
    met = rows.withColumn("_g", group_key(by)).join(found, "_g", "left")
    return met.select(*by, "n", "mean", "low", *(F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))), "high")


def confidence(df: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """(by, mean, low, high): the mean and its interval by Student's t; no interval for a single value."""
    half = t_quantile(F.count(value) - 1, (1 + level) / 2) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def strongest_change(nucs: DataFrame, change: DataFrame, half: int = HALF_NUCLEOSOME) -> DataFrame:
    """(name, tf, diff): by nucleosome that both samples have, the change of greatest size between its two dyads and
    ``half`` bases around them.

    nucs: (name, chr, dyadA, dyadB); change: (chr, pos, tf, diff), averaged over segments. Nucleosomes without a change
    have no row.
    """
    both = nucs.where("dyadA is not null and dyadB is not null")
    near, far = F.least("dyadA", "dyadB"), F.greatest("dyadA", "dyadB")
    ends = both.select("name", "chr", F.least(far - half, near).alias("start"), F.greatest(near + half, far).alias("end"))
    met = point_join(change, ends)
    return met.groupBy("name", "tf").agg(F.max_by("diff", F.struct(F.abs("diff"), "diff")).alias("diff"))


def change(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chr", "pos", "tf")) -> DataFrame:
    """Two samples' stitched posteriors (keys, prob) -> keys, probA, probB and diff, B less A; a base that one sample lacks
    counts 0 there. One aggregation of their union; rows that repeat a key are averaged within their sample."""
    both = a.select(*keys, F.lit(0).alias("_s"), "prob").unionByName(b.select(*keys, F.lit(1).alias("_s"), "prob"))
    of = lambda i: F.coalesce(F.avg(F.when(F.col("_s") == i, F.col("prob"))), F.lit(0.0))
    return both.groupBy(*keys).agg(of(0).alias("probA"), of(1).alias("probB")).withColumn("diff", F.col("probB") - F.col("probA"))


def between_samples(a: DataFrame, b: DataFrame, nucs: DataFrame, sites: DataFrame, p_cut: float = DIFF_P, least: float = DIFF_ABS) -> DataFrame:
    """What differs between two decoded samples: (chr, start, end, tf, diff, probA, probB, z, p_value) of the sites.

    a, b: stitched posteriors (chr, pos, tf, prob); nucs: linked nucleosomes (name, chr, dyadA, dyadB), at which no change is
    expected but the background's; sites: (chr, start, end, tf). A site's change is that of its bases with the greatest
    difference; it stands out against the strongest changes around the nucleosomes.
    """
    changed = change(a, b)
    background = strongest_change(nucs, changed.select("chr", "pos", "tf", "diff"))
    met = point_join(changed, sites.select("chr", "start", "end", F.col("tf").alias("_tf"))).where("tf = _tf")
    strongest = F.max_by(F.struct("diff", "probA", "probB"), F.struct(F.abs("diff"), "diff", "pos"))
    rows = met.groupBy("chr", "start", "end", "tf").agg(strongest.alias("c")).select("chr", "start", "end", "tf", "c.*")
    return z_scores(rows, background.select("tf", "diff"), p_cut, least)


def change_by_category(nucs: DataFrame, changed: DataFrame) -> DataFrame:
    """(category, tf, n, mean, up, down): changes (name, tf, diff) of linked nucleosomes (name, dyadA, dyadB) by whether both
    samples have the nucleosome."""
    kinds = nucs.where("dyadA is not null or dyadB is not null").withColumns(pair_category()).select("name", "category")
    up, down = (F.count_if(F.col("diff") > 0), F.count_if(F.col("diff") < 0))
    return kinds.join(changed, "name").groupBy("category", "tf").agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), up.alias("up"), down.alias("down"))


def z_scores(change: DataFrame, background: DataFrame, p_cut: float = DIFF_P, least: float = DIFF_ABS) -> DataFrame:
    """(chr, start, end, tf, diff, probA, probB) against the (tf, diff) of the background -> those that stand out.

    Adds z (population standard deviation) and the two-sided p_value; keeps p_value < p_cut, abs(diff) > least and
    probabilities of 1 at most. Factors whose background doesn't vary give nothing.
    """
    stats = background.groupBy("tf").agg(F.avg("diff").alias("_m"), F.stddev_pop("diff").alias("_s"))
    z = (F.col("diff") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))
    rows = change.where(F.abs("diff") > least).where("probA <= 1 and probB <= 1").join(stats, "tf").withColumn("z", z)
    return rows.where("z is not null").withColumn("p_value", two_sided_p(F.col("z"))).where(F.col("p_value") < p_cut).drop("_m", "_s")


def region_nucleosomes(linked: DataFrame, n: int, regions: DataFrame, threshold: int = SHIFT_THRESHOLD, half: int = DYAD_MARK) -> DataFrame:
    """Marks of linked nucleosomes in regions (chr, r_start, r_end), a row for each sample that has one.

    linked: as ``link.link`` gives it. (chr, r_start, r_end, sample, dyad, start, end, strength, shift, previous): the mark is
    ``half`` bases to either side of the dyad; shift is ``later``, ``earlier`` or ``same`` by what it moved from the sample
    before; previous is the dyad that it is joined to, null for the first sample or where that sample has none. A
    nucleosome is in a region if its least dyad and its greatest are, but for their marks.
    """
    names = [sample_suffix(i) for i in range(n)]
    dyads = F.array(*(f"dyad{x}" for x in names))
    top, foot = F.array_min(dyads) + half + 2, F.array_max(dyads) - half
    rows = linked.withColumns({"_top": top, "_foot": foot}).withColumns({"_a": F.least("_top", "_foot"), "_b": F.greatest("_top", "_foot")})
    met = overlap_join(rows, regions, left_ends=("_a", "_b")).where("_top >= r_start and _foot <= r_end")

    def mark(i: int) -> Column:
        dyad, none = F.col(f"dyad{names[i]}").cast("long"), F.lit(None).cast("long")
        before = F.col(f"dyad{names[i - 1]}").cast("long") if i else none
        moved = dyad - before
        kind = F.when(moved > threshold, "later").when(moved < -threshold, "earlier").otherwise("same")
        strength = 0.9 * F.col(f"pdyad{names[i]}")
        return F.struct(F.lit(names[i]).alias("sample"), dyad.alias("dyad"), (dyad - half).alias("start"), (dyad + half).alias("end"), strength.alias("strength"), kind.alias("shift"), before.alias("previous"))

    return met.select("chr", "r_start", "r_end", F.inline(F.array(*map(mark, range(n))))).where("dyad is not null")


def region_sites(merged: DataFrame, n: int, regions: DataFrame, minimum: float = SITE_MIN_SCORE) -> DataFrame:
    """Sites of ``merge_sites`` in regions (chr, r_start, r_end), kept if any score exceeds ``minimum``: (chr, r_start, r_end, tf,
    start, end, centre, scoreA, scoreB, ..., changed). A missing score is 0; a site is changed if one sample's score is
    below ``minimum`` and another's above it."""
    scores = [f"score{sample_suffix(i)}" for i in range(n)]
    rows = merged.select("chr", "tf", "start", "end", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in scores))
    low, high = F.array_min(F.array(*scores)), F.array_max(F.array(*scores))
    met = overlap_join(rows, regions).where((F.col("start") < F.col("r_end")) & (high > minimum))
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    return met.select("chr", "r_start", "r_end", "tf", "start", "end", centre.alias("centre"), *scores, (low < minimum).alias("changed"))
