"""Queries over fragment signals and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import fit, intervals, occupancy, signal
from . import tables as T

QUERIES: dict[str, T.Query] = {}
SQL: dict[str, str] = {}
query = T.registered(QUERIES, SQL)


@query(f"WITH {T.MIDS} SELECT * FROM hist")
def midpoint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.midpoint_histogram(T.midpoints(spark, sf_dir))


@query(
    f"""WITH {T.FRAGMENTS} SELECT chr, CAST(abs(tlen) AS INTEGER) AS len, CAST(floor((ref_start + 1 + ref_start + tlen) / 2) AS BIGINT) AS pos, count(*) AS n
    FROM fragments WHERE tlen > 0 AND tlen BETWEEN 10 AND 250 GROUP BY ALL"""
)
def length_position_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.length_position_counts(T.fragments(spark, sf_dir), 10, 250)


@query(
    f"""WITH {T.SPANS}, d AS (SELECT chr, pos, sum(d) AS d FROM (SELECT chr, start AS pos, 1 AS d FROM spans UNION ALL SELECT chr, "end" + 1, -1 FROM spans) GROUP BY ALL HAVING sum(d) <> 0),
    r AS (SELECT chr, pos AS start, lead(pos) OVER (PARTITION BY chr ORDER BY pos) - 1 AS "end", CAST(sum(d) OVER (PARTITION BY chr ORDER BY pos) AS BIGINT) AS depth FROM d)
    SELECT * FROM r WHERE depth > 0"""
)
def fragment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coverage(T.spans(spark, sf_dir))


@query(
    f"""WITH {T.MIDS}, spans AS (SELECT chr, ref_start + tlen AS "end" FROM fragments WHERE tlen > 0), sizes AS (SELECT chr, max("end") AS size FROM spans GROUP BY chr), {T.TILES}
    SELECT t.chr, t.start, t."end", m.cls, CAST(sum(m.n) AS BIGINT) AS n FROM tiles t JOIN hist m ON t.chr = m.chr AND m.pos BETWEEN t.start AND t."end" GROUP BY ALL"""
)
def segment_tiling_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = T.tiles(spark, sf_dir)
    counts = signal.segment_counts(tiles, T.midpoints(spark, sf_dir)).groupBy("segment_id", "cls").agg(F.sum("n").alias("n"))
    return counts.join(tiles, "segment_id").select("chr", "start", "end", "cls", "n")


@query(
    f"""WITH {T.MIDS}, spans AS (SELECT chr, ref_start + tlen AS "end" FROM fragments WHERE tlen > 0), sizes AS (SELECT chr, max("end") AS size FROM spans GROUP BY chr), {T.TILES}
    SELECT t.chr, t.start, CAST(t."end" - t.start + 1 AS INTEGER) AS n_bases, CAST(coalesce(sum(m.n) FILTER (m.cls = 'short'), 0) AS BIGINT) AS n_short,
      CAST(coalesce(max(m.n) FILTER (m.cls = 'long'), 0) AS INTEGER) AS most_long
    FROM tiles t LEFT JOIN hist m ON t.chr = m.chr AND m.pos BETWEEN t.start AND t."end" GROUP BY t.chr, t.start, t."end" """
)
def dense_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = T.tiles(spark, sf_dir)
    dense = signal.dense_counts(tiles, signal.segment_counts(tiles, T.midpoints(spark, sf_dir)))
    total = F.aggregate("short", F.lit(0).cast("long"), lambda a, x: a + x)
    return dense.select("chr", "start", F.size("short").alias("n_bases"), total.alias("n_short"), F.array_max("long").alias("most_long"))


ISLANDS = """e AS (SELECT chr, start, "end", max("end") OVER (PARTITION BY chr ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, event_id FROM spans),
    i AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS island FROM e)"""


@query(f"""WITH {T.SPANS}, {ISLANDS} SELECT chr, island, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY chr, island""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.island_extents(T.spans(spark, sf_dir))


@query(
    f"""WITH {T.MIDS}, spans AS (SELECT chr, ref_start + tlen AS "end" FROM fragments WHERE tlen > 0), sizes AS (SELECT chr, max("end") AS size FROM spans GROUP BY chr), {T.TILES},
    v AS (SELECT t.chr, m.pos, sum(m.n) / (5.0 + t.start % 7) AS score FROM tiles t JOIN hist m ON t.chr = m.chr AND m.pos BETWEEN t.start AND t."end" GROUP BY t.chr, m.pos, t.start)
    SELECT chr, pos, round(least(avg(score), 1), 6) AS score, count(*) AS n_segments FROM v GROUP BY chr, pos"""
)
def overlap_average_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = T.tiles(spark, sf_dir)
    counts = signal.segment_counts(tiles, T.midpoints(spark, sf_dir)).groupBy("segment_id", "chr", "pos").agg(F.sum("n").alias("n"))
    scores = counts.join(tiles.select("segment_id", "start"), "segment_id").withColumn("score", F.col("n") / (5.0 + F.pmod("start", F.lit(7))))
    return intervals.stitch(scores, ["score"]).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {T.MIDS}, spans AS (SELECT chr, ref_start + tlen AS "end" FROM fragments WHERE tlen > 0), sizes AS (SELECT chr, max("end") AS size FROM spans GROUP BY chr), {T.TILES},
    v AS (SELECT t.chr, m.pos, t.start, t."end", sum(m.n) / (5.0 + t.start % 7) AS score FROM tiles t JOIN hist m ON t.chr = m.chr AND m.pos BETWEEN t.start AND t."end" GROUP BY t.chr, m.pos, t.start, t."end"),
    e AS (SELECT chr, min(start) AS a, max("end") AS b FROM tiles GROUP BY chr)
    SELECT chr, pos, round(least(max_by(score, start), 1), 6) AS score FROM v JOIN e USING (chr) WHERE (pos >= start + 500 OR start = a) AND (pos <= "end" - 500 OR "end" = b) GROUP BY chr, pos"""
)
def trimmed_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = T.tiles(spark, sf_dir)
    counts = signal.segment_counts(tiles, T.midpoints(spark, sf_dir)).groupBy("segment_id", "chr", "pos").agg(F.sum("n").alias("n"))
    scores = counts.join(tiles.select("segment_id", "start", "end"), "segment_id").withColumn("score", F.col("n") / (5.0 + F.pmod("start", F.lit(7))))
    return intervals.trimmed(scores, tiles, ["score"]).withColumn("score", F.round("score", 6))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.midpoints(spark, sf_dir).groupBy("chr", "pos").agg(F.count("*").alias("n"))


TRACK = f"{T.MIDS}, track AS (SELECT chr, pos, sum(n) AS n FROM hist GROUP BY ALL)"


@query(f"WITH {TRACK} SELECT chr, pos, CAST(sum(n) OVER (PARTITION BY chr ORDER BY pos RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS total FROM track")
def rolling_sum_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.rolling(_track(spark, sf_dir), {"total": F.sum("n")}, 5).select("chr", "pos", "total")


@query(
    f"""WITH {TRACK} SELECT chr, pos, round(avg(n) OVER w, 6) AS mean, CAST(min(n) OVER w AS BIGINT) AS least FROM track
    WINDOW w AS (PARTITION BY chr ORDER BY pos RANGE BETWEEN 58 PRECEDING AND 58 FOLLOWING)"""
)
def rolling_mean_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal.rolling(_track(spark, sf_dir), {"mean": F.avg("n"), "least": F.min("n")}, 58)
    return rows.select("chr", "pos", F.round("mean", 6).alias("mean"), "least")


@query(
    f"""WITH {T.MIDS}, d AS (SELECT DISTINCT chr, pos AS dyad FROM hist WHERE cls = 'long' AND pos - 88 > 0)
    SELECT chr, dyad, dyad - 88 AS start, dyad - 73 AS "end" FROM d UNION ALL SELECT chr, dyad, dyad + 73, dyad + 88 FROM d"""
)
def linkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dyads = T.midpoints(spark, sf_dir).where("cls = 'long'").select("chr", F.col("pos").alias("dyad")).distinct()
    return intervals.linkers(dyads)


HEAT = f"""{T.MIDS}, {T.SITES}, heat AS (SELECT m.len, CASE WHEN s.strand = '-' THEN s.centre - m.pos ELSE m.pos - s.centre END AS rel, count(*) AS n
    FROM sites s JOIN mids m ON s.chr = m.chr AND m.pos BETWEEN s.centre - 500 AND s.centre + 500 GROUP BY ALL)"""


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.heatmap(T.sites(spark, sf_dir), T.midpoints(spark, sf_dir), 500, "strand")


@query(f"WITH {HEAT} SELECT * FROM heat")
def heatmap_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir)


@query(f"WITH {HEAT} SELECT rel, round(sum(CASE WHEN len BETWEEN 127 AND 187 THEN n ELSE 0 END) / (SELECT count(*) FROM sites), 6) AS per_site FROM heat GROUP BY rel")
def heatmap_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.sites(spark, sf_dir).count()
    return signal.pileup(_heat(spark, sf_dir), (127, 187), n).withColumn("per_site", F.round("per_site", 6))


@query(f"WITH {HEAT} SELECT len, round(100.0 * sum(n) / (SELECT sum(n) FROM heat), 6) AS percent FROM heat GROUP BY len")
def heatmap_length_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.length_shares(_heat(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


COUNTED = f"""{T.MIDS}, {T.SITES}, offs AS (SELECT site_id, chr, centre, rel FROM sites, unnest(range(-5, 6)) t(rel)),
    per AS (SELECT o.site_id, o.rel, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS value FROM offs o LEFT JOIN hist h ON h.chr = o.chr AND h.pos = o.centre + o.rel GROUP BY ALL),
    counted AS (SELECT rel, value, count(*) AS n FROM per GROUP BY ALL)"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.site_count_histogram(T.sites(spark, sf_dir), T.midpoints(spark, sf_dir), 5)


@query(f"WITH {COUNTED} SELECT * FROM counted")
def site_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir)


@query(
    f"""WITH {COUNTED}, m AS (SELECT rel, sum(n) AS total, sum(value * n) / sum(n) AS mean, sum(value * value * n) / sum(n) AS sq FROM counted GROUP BY rel)
    SELECT rel, CAST(total AS BIGINT) AS total, round(mean, 6) AS mean, round(sq - mean * mean, 6) AS var FROM m"""
)
def nb_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.moments(_counted(spark, sf_dir), ["rel"]).select("rel", "total", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(
    f"""WITH RECURSIVE {COUNTED}, m AS (SELECT rel, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(value * n) AS DOUBLE) / sum(n) AS mean, CAST(sum(value * value * n) AS DOUBLE) / sum(n) AS sq, max(value) AS top FROM counted GROUP BY rel),
    fits AS (SELECT * FROM m WHERE sq - mean * mean > mean), above AS (SELECT f.rel, j, CAST(sum(CASE WHEN value > j THEN n ELSE 0 END) AS DOUBLE) AS n FROM fits f JOIN counted USING (rel), unnest(range(0, top)) t(j) GROUP BY f.rel, j),
    halved AS (SELECT rel, CAST(1e-9 AS DOUBLE) AS low, CAST(1e9 AS DOUBLE) AS high, 0 AS step FROM fits UNION ALL
      SELECT rel, CASE WHEN score > 0 THEN r ELSE low END, CASE WHEN score > 0 THEN high ELSE r END, step + 1 FROM
        (SELECT h.rel, any_value(low) AS low, any_value(high) AS high, any_value(step) AS step, any_value((low + high) / 2) AS r, sum(n / ((low + high) / 2 + j)) - any_value(total * ln(1 + mean / ((low + high) / 2))) AS score
         FROM halved h JOIN above USING (rel) JOIN fits ON fits.rel = h.rel WHERE step < 120 GROUP BY h.rel))
    SELECT rel, round(coalesce(CASE WHEN s.rel IS NULL THEN 0.002 END, mean), 6) AS mu, round(coalesce(s.r, 100.0), 4) AS size FROM m LEFT JOIN (SELECT rel, (low + high) / 2 AS r FROM halved WHERE step = 120) s USING (rel)"""
)
def nb_mle_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit.fit_nb(_counted(spark, sf_dir), ["rel"])
    return found.select("rel", F.round("mu", 6).alias("mu"), F.round("size", 4).alias("size"))


@query(
    """WITH q AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS x FROM lineitem)
    SELECT x, round(exp(lgamma(x + 1.7) - lgamma(1.7) - lgamma(x + 1) + 1.7 * ln(1.7 / (1.7 + 9.5)) + x * ln(9.5 / (1.7 + 9.5))), 9) AS p FROM q"""
)
def nb_pmf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = T.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("x")).distinct()
    return values.select("x", F.round(scalar.nb_pmf(F.col("x").cast("double"), F.lit(9.5), F.lit(1.7)), 9).alias("p"))


@query(
    """WITH h AS (SELECT l_returnflag AS grp, CAST(l_quantity AS INTEGER) AS value, count(*) AS n FROM lineitem GROUP BY ALL),
    m AS (SELECT grp, sum(value * n) / sum(n) AS mean, sum(value * value * n) / sum(n) AS sq FROM h GROUP BY grp)
    SELECT grp, round(mean * mean / (sq - mean * mean), 6) AS shape, round(mean / (sq - mean * mean), 6) AS rate FROM m"""
)
def gamma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").cast("int").alias("value"))
    found = fit.gamma_moments(lines.groupBy("grp", "value").agg(F.count("*").alias("n")), ["grp"])
    return found.select("grp", F.round("shape", 6).alias("shape"), F.round("rate", 6).alias("rate"))


@query(
    """WITH c AS (SELECT b.base, sum(length(text) - length(replace(translate(text, 'acgt', 'ACGT'), b.base, ''))) AS n FROM documents, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY b.base)
    SELECT base, round(n / sum(n) OVER (), 6) AS share FROM c"""
)
def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.base_composition(T.table(spark, sf_dir, "documents"), "text").withColumn("share", F.round("share", 6))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of 32 bases for each part."""
    return T.table(spark, sf_dir, "part").select(F.translate(F.md5("p_name"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


PAIRS = """s AS (SELECT translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
    c AS (SELECT CAST(pos AS INTEGER) AS pos, substr(seq, pos, 1) AS cur, substr(seq, pos + 1, 1) AS nxt, count(*) AS n FROM s, unnest(range(1, 32)) t(pos) GROUP BY ALL)"""


@query(f"WITH {PAIRS} SELECT pos, cur, nxt, n, round(n / sum(n) OVER (PARTITION BY pos), 6) AS share FROM c")
def dinucleotide_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.dinucleotide_frequency(_sequences(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"WITH {PAIRS} SELECT pos, cur, nxt, n, round(n / sum(n) OVER (PARTITION BY pos, cur), 6) AS p FROM c")
def dinucleotide_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.dinucleotide_transition(_sequences(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query(
    """WITH s AS (SELECT translate(md5(p_name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
    c AS (SELECT CAST(pos AS INTEGER) AS pos, substr(seq, pos, 1) AS base, count(*) AS n FROM s, unnest(range(1, 33)) t(pos) GROUP BY ALL)
    SELECT pos, base, n, round(n / sum(n) OVER (PARTITION BY pos), 6) AS share FROM c"""
)
def position_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.position_composition(_sequences(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    f"""WITH {T.FRAGMENTS}, p AS (SELECT least(10, CAST(floor(ref_start / 4320.0) AS INTEGER) + 1) AS x_bin, least(10, CAST(floor(value / 50.0) AS INTEGER) + 1) AS y_bin
    FROM fragments WHERE ref_start BETWEEN 0 AND 43200 AND value BETWEEN 0 AND 500) SELECT x_bin, y_bin, count(*) AS n FROM p GROUP BY ALL"""
)
def density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.density(T.fragments(spark, sf_dir), "ref_start", "value", (0, 43200), (0, 500))


@query(
    f"""WITH {T.SPANS}, {T.TILES}, cut AS (SELECT * FROM spans WHERE "end" - start > 100)
    SELECT t.chr, t.start AS r_start, count(*) AS n, CAST(sum(CASE WHEN c.start >= t.start AND c."end" <= t."end" THEN 1 ELSE 0 END) AS BIGINT) AS n_inside
    FROM tiles t JOIN cut c ON c.chr = t.chr AND c.start <= t."end" AND c."end" >= t.start GROUP BY ALL"""
)
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = T.tiles(spark, sf_dir).select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = intervals.overlap_join(T.spans(spark, sf_dir).where("end - start > 100"), regions)
    inside = F.count_if((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")))
    return met.groupBy("chr", "r_start").agg(F.count("*").alias("n"), inside.alias("n_inside"))


@query(
    f"""WITH {T.SPANS}, long AS (SELECT * FROM spans WHERE "end" - start > 150), base AS (SELECT chr, pos FROM sizes, unnest(range(1, size + 1)) t(pos)),
    free AS (SELECT b.chr, b.pos FROM base b WHERE NOT EXISTS (SELECT 1 FROM long l WHERE l.chr = b.chr AND b.pos BETWEEN l.start AND l."end")),
    k AS (SELECT chr, pos, pos - row_number() OVER (PARTITION BY chr ORDER BY pos) AS grp FROM free)
    SELECT chr, min(pos) AS start, max(pos) AS "end" FROM k GROUP BY chr, grp"""
)
def uncovered_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = T.sizes(spark, sf_dir).select("chr", F.lit(1).cast("long").alias("r_start"), F.col("size").alias("r_end"))
    return intervals.uncovered(region, T.spans(spark, sf_dir).where("end - start > 150"))


STATES = "(VALUES (1, 'background'), (2, 'ABF1_1'), (3, 'ABF1_2'), (4, 'REB1'), (5, 'nucleosome'), (6, 'nucleosome'), (6, 'nuc_center'), (7, 'nucleosome')) s(state, dbf)"
POSTERIOR = "p AS (SELECT l_returnflag AS chr, l_partkey AS pos, l_linenumber AS state, l_discount AS prob FROM lineitem)"


def _occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "background"), (2, "ABF1_1"), (3, "ABF1_2"), (4, "REB1"), (5, "nucleosome"), (6, "nucleosome"), (6, "nuc_center"), (7, "nucleosome")]
    posterior = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_linenumber").alias("state"), F.col("l_discount").alias("prob")
    )
    return occupancy.by_factor(posterior, spark.createDataFrame(rows, "state int, dbf string"))


@query(f"WITH {POSTERIOR} SELECT chr, pos, dbf, round(sum(prob), 6) AS prob FROM p JOIN {STATES} USING (state) GROUP BY ALL")
def occupancy_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir).withColumn("prob", F.round("prob", 6))


@query(
    f"""WITH {POSTERIOR} SELECT chr, pos, round(sum(CASE WHEN dbf = 'background' THEN prob ELSE 0 END), 6) AS background, round(sum(CASE WHEN dbf = 'REB1' THEN prob ELSE 0 END), 6) AS REB1,
    round(sum(CASE WHEN dbf = 'nucleosome' THEN prob ELSE 0 END), 6) AS nucleosome FROM p JOIN {STATES} USING (state) GROUP BY ALL"""
)
def occupancy_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = ["background", "REB1", "nucleosome"]
    return occupancy.wide(_occupancy(spark, sf_dir), factors).select("chr", "pos", *(F.round(f, 6).alias(f) for f in factors))


@query(
    f"""WITH {POSTERIOR}, o AS (SELECT chr, pos, upper(split_part(dbf, '_', 1)) AS family, round(sum(prob), 6) AS prob FROM p JOIN {STATES} USING (state) GROUP BY ALL)
    SELECT * FROM o WHERE prob >= 0.155"""
)
def occupancy_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.families(_occupancy(spark, sf_dir), 0.155).withColumn("prob", F.round("prob", 6))
