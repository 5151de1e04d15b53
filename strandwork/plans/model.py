"""Queries of the occupancy model: decoding, training, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, hmm, intervals, occupancy, signal
from . import tables as T

QUERIES: dict[str, T.Query] = {}
SQL: dict[str, str] = {}
query = T.registered(QUERIES, SQL)


def small_model() -> hmm.Model:
    """Two short motifs and the nucleosome, with counts alone: the driver's tables have no bases."""
    motifs = {"ABF1": [[0.7, 0.1, 0.1, 0.1]] * 5, "REB1": [[0.1, 0.1, 0.1, 0.7]] * 7}
    weights = {"background": 0.9, "nucleosome": 0.02, "ABF1": 0.05, "REB1": 0.03}
    mean = 0.01
    hump = tuple(mean * (1 + 20 * (1 - abs(i - 73) / 73)) for i in range(147))
    counts = {"long": hmm.Counts((mean, 1.0), (mean, 1.0), (hump, 1.0)), "short": hmm.Counts((0.05, 1.0), (0.3, 1.0), ((0.05,) * 147, 1.0))}
    return hmm.Model(motifs, [0.25] * 4, weights, counts=counts, use_sequence=False)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = T.tiles(spark, sf_dir)
    return signal.dense_counts(tiles, signal.segment_counts(tiles, T.midpoints(spark, sf_dir)))


@query()
def hmm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.decode_factors(_segments(spark, sf_dir), small_model())
    return found.groupBy("chr", "pos", "dbf").agg(F.avg("prob").alias("prob"))


@query()
def hmm_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, history = hmm.train(_segments(spark, sf_dir), small_model())
    rows = [(k, float(w), float(history[-1])) for k, w in sorted(model.weights.items())]
    return spark.createDataFrame(rows, "dbf string, weight double, log_likelihood double")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-base track: midpoint counts as scores, with their islands' ends."""
    mids = signal.midpoint_histogram(T.midpoints(spark, sf_dir))
    track = mids.groupBy("chr", "pos").agg(
        F.sum("n").cast("double").alias("dyad_score"), F.coalesce(F.sum(F.when(F.col("cls") == "short", F.col("n"))), F.lit(0)).cast("double").alias("occ_score")
    )
    return track.join(T.sizes(spark, sf_dir), "chr").withColumn("first", F.lit(1)).withColumnRenamed("size", "last")


def _walk(back: str, ahead: str) -> str:
    """Greedy picks in SQL, a round at a time, from track (chr, pos, k, ...): a row that has the highest k of all rows that are
    left and cover it is picked, and whatever a pick of higher k covers goes. back and ahead bound where a row's coverers lie."""
    near = f"(PARTITION BY chr ORDER BY pos RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return f"""walk AS (SELECT chr, pos, k, w, false AS pick FROM track UNION ALL
    SELECT chr, pos, k, w, pick FROM (SELECT *, max(CASE WHEN pick THEN k END) OVER {near} AS best FROM
      (SELECT chr, pos, k, w, k = max(k) OVER {near} AS pick FROM walk WHERE NOT pick)) WHERE pick OR best IS NULL OR best < k),
    picks AS (SELECT chr, pos, k, w FROM walk WHERE pick)"""


SIZES = """sizes AS (SELECT chr, max(ref_start + tlen) AS size FROM fragments WHERE tlen > 0 GROUP BY chr)"""


@query(
    f"""WITH RECURSIVE {T.MIDS}, {SIZES}, track AS (SELECT chr, pos, sum(n) AS score, coalesce(sum(n) FILTER (cls = 'short'), 0) AS occ, CAST(sum(n) AS BIGINT) * 10000000 - pos AS k, 0 AS w FROM hist GROUP BY chr, pos),
    {_walk("58", "58")}, free AS (SELECT p.chr, p.pos FROM picks p JOIN sizes USING (chr) WHERE p.pos - 58 >= 1 AND p.pos + 58 <= size
      AND NOT EXISTS (SELECT 1 FROM picks q WHERE q.chr = p.chr AND q.pos BETWEEN p.pos - 116 AND p.pos + 116 AND q.k > p.k))
    SELECT chr, free.pos AS dyad, CAST(max(score) FILTER (track.pos = free.pos) AS DOUBLE) AS dyad_score, round(CAST(sum(occ) AS DOUBLE) / 117, 6) AS avg_occ_score,
      CASE WHEN count(*) = 117 THEN CAST(min(occ) AS DOUBLE) ELSE 0.0 END AS min_occ_score
    FROM free JOIN track USING (chr) WHERE track.pos BETWEEN free.pos - 58 AND free.pos + 58 GROUP BY chr, free.pos"""
)
def greedy_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.dyads(_scores(spark, sf_dir)).withColumn("avg_occ_score", F.round("avg_occ_score", 6))


@query(
    f"""WITH RECURSIVE {T.MIDS}, {SIZES}, track AS (SELECT cls || ' ' || chr AS chr, pos, CAST(n AS BIGINT) * 10000000 - pos AS k, CASE WHEN cls = 'long' THEN 13 ELSE 8 END AS w FROM hist),
    {_walk("(2 * w - 1)", "w")}, called AS (SELECT split_part(chr, ' ', 1) AS tf, split_part(chr, ' ', 2) AS chr, pos, w, CAST(ceil(k / 10000000) AS DOUBLE) AS score FROM picks),
    placed AS (SELECT tf, chr, w, score, CAST(floor((greatest(pos - w, 1) + least(pos + 2 * w, size + 1)) / 2) AS BIGINT) AS centre FROM called JOIN sizes USING (chr))
    SELECT tf, chr, centre AS start, centre + w AS "end", w AS width, score FROM placed"""
)
def site_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = T.midpoints(spark, sf_dir).groupBy("chr", "pos", F.col("cls").alias("tf")).agg(F.count("*").cast("double").alias("score"))
    rows = tracks.join(T.sizes(spark, sf_dir), "chr").withColumn("first", F.lit(1)).withColumnRenamed("size", "last")
    return calls.sites(rows.withColumn("width", F.when(F.col("tf") == "long", 13).otherwise(8)))


@query(
    """WITH s AS (SELECT l_linestatus AS tf, l_returnflag || l_linenumber AS variant, 5 + l_linenumber AS width, 'chr' || (l_suppkey % 16) AS chr, l_partkey AS pos, max(l_discount) AS score FROM lineitem GROUP BY ALL)
    SELECT tf, chr, pos, score, variant, CAST(width AS INTEGER) AS width FROM (SELECT *, row_number() OVER (PARTITION BY tf, chr, pos ORDER BY score DESC, variant) AS k FROM s) WHERE k = 1"""
)
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.table(spark, sf_dir, "lineitem")
    keys = [
        F.col("l_linestatus").alias("tf"),
        F.concat("l_returnflag", "l_linenumber").alias("variant"),
        (F.col("l_linenumber") + 5).cast("int").alias("width"),
        F.concat(F.lit("chr"), F.pmod("l_suppkey", F.lit(16))).alias("chr"),
        F.col("l_partkey").alias("pos"),
    ]
    return occupancy.best_variant(lines.groupBy(*keys).agg(F.max("l_discount").alias("score")))


WEIGHTS = """w AS (SELECT l_shipdate AS segment_id, CASE l_linenumber WHEN 1 THEN 'background' WHEN 2 THEN 'nucleosome' WHEN 3 THEN 'unknown' ELSE 'TF' || l_linenumber END AS dbf, sum(l_quantity) AS expected FROM lineitem GROUP BY ALL),
    n AS (SELECT dbf, sum(expected) AS n FROM w GROUP BY dbf), weights AS (SELECT dbf, n / sum(n) OVER () AS weight FROM n)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    dbf = F.when(number == 1, "background").when(number == 2, "nucleosome").when(number == 3, "unknown").otherwise(F.concat(F.lit("TF"), number))
    starts = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("segment_id"), dbf.alias("dbf")).agg(F.sum("l_quantity").alias("expected"))
    return occupancy.weights(starts)


@query(f"WITH {WEIGHTS} SELECT dbf, round(weight, 6) AS weight FROM weights")
def m_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {WEIGHTS}, o AS (SELECT *, dbf LIKE 'TF%' AND weight > 0.1 AS big FROM weights), s AS (SELECT count(*) FILTER (big) AS k, sum(weight) FILTER (NOT big) AS rest FROM o)
    SELECT dbf, round(CASE WHEN k = 0 THEN weight WHEN big THEN 0.1 ELSE weight * (1 - k * 0.1) / rest END, 6) AS weight FROM o, s"""
)
def m_step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.capped(_weights(spark, sf_dir), 0.1).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {T.SPANS}, {T.TILES} SELECT chr, start, "end" FROM tiles"""
)
def segment_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.tiles(T.sizes(spark, sf_dir))
