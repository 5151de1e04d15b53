"""The driver's tables read as genomic ones.

An event is a fragment: its type is the chromosome, its minute since 2024 the aligned start, its value the length.
Fragments longer than both classes serve as binding sites, those between the classes as genes, and the three remainders
of the user's number are three samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fragment_midpoint
from ..operators import intervals, signal

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(queries: dict[str, Query], sqls: dict[str, str]) -> Callable:
    """A decorator that puts a query, and its SQL if there is one, under the function's name."""

    def with_sql(sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return with_sql


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, value, chr, ref_start, tlen)"""
    minute = F.expr("timestampdiff(MINUTE, cast('2024-01-01' as timestamp_ntz), cast(ts as timestamp_ntz))")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("event_type").alias("chr"), minute.alias("ref_start"), F.floor("value").cast("int").alias("tlen"))
    return rows


def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.midpoints(fragments(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, start, end) of fragments with a base."""
    rows = fragments(spark, sf_dir).where("tlen > 0")
    return rows.select("event_id", "chr", (F.col("ref_start") + 1).alias("start"), (F.col("ref_start") + F.col("tlen")).alias("end"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy("chr").agg(F.max("end").alias("size"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 5000 bases, every 4000."""
    rows = intervals.tiles(sizes(spark, sf_dir))
    return rows.withColumn("segment_id", F.xxhash64("chr", "start"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, chr, centre, strand, width, score)"""
    rows = fragments(spark, sf_dir).where("tlen > 187")
    centre = fragment_midpoint(F.col("ref_start"), F.col("tlen"))
    strand = F.when(F.pmod("user_id", F.lit(2)) == 0, "+").otherwise("-")
    return rows.select(F.col("event_id").alias("site_id"), "chr", centre.alias("centre"), strand.alias("strand"), (F.col("value") / 500).alias("score"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of ``constants.GENES``; row is the number of the event."""
    rows = fragments(spark, sf_dir).where("tlen between 81 and 126")
    plus = F.pmod("user_id", F.lit(2)) == 0
    left, right = F.col("ref_start") + 1, F.col("ref_start") + F.col("tlen")
    way = F.when(plus, 1).otherwise(-1)
    tss, tts = F.when(plus, left).otherwise(right), F.when(plus, right).otherwise(left)
    return rows.select(
        "chr",
        F.concat(F.lit("Y"), F.col("event_id"), F.when(plus, "W").otherwise("C")).alias("orf"),
        way.alias("strand"),
        (tss + way * 30).alias("plus1"),
        (tss - way * 150).alias("minus1"),
        tss.alias("tss"),
        tts.alias("tts"),
        (tss + way * 5).alias("orf_start"),
        (tts - way * 5).alias("orf_end"),
        F.col("event_id").alias("row"),
    )


def calls(spark: SparkSession, sf_dir: str, sample: int) -> DataFrame:
    """(chr, dyad, dyad_score, min_occ_score): the distinct midpoints of a sample's long fragments."""
    rows = fragments(spark, sf_dir).where((F.pmod("user_id", F.lit(3)) == sample) & F.col("tlen").between(127, 187))
    centre = fragment_midpoint(F.col("ref_start"), F.col("tlen"))
    return rows.groupBy("chr", centre.alias("dyad")).agg((F.max("value") / 190).alias("dyad_score"), (F.max("value") / 200).alias("min_occ_score"))


# The same tables in SQL, to begin a query with.
FRAGMENTS = """fragments AS (SELECT event_id, user_id, value, event_type AS chr, CAST(epoch_us(ts) // 60000000 - 28401120 AS BIGINT) AS ref_start,
  CAST(floor(value) AS INTEGER) AS tlen FROM events)"""
MIDS = FRAGMENTS + """, mids AS (SELECT chr, CAST(floor((ref_start + 1 + ref_start + tlen) / 2) AS BIGINT) AS pos,
  CASE WHEN abs(tlen) BETWEEN 127 AND 187 THEN 'long' WHEN abs(tlen) BETWEEN 0 AND 80 THEN 'short' END AS cls, CAST(abs(tlen) AS INTEGER) AS len
  FROM fragments WHERE tlen > 0 AND (abs(tlen) BETWEEN 127 AND 187 OR abs(tlen) BETWEEN 0 AND 80)),
  hist AS (SELECT chr, pos, cls, count(*) AS n FROM mids GROUP BY ALL)"""
SPANS = FRAGMENTS + """, spans AS (SELECT event_id, chr, ref_start + 1 AS start, ref_start + tlen AS "end" FROM fragments WHERE tlen > 0),
  sizes AS (SELECT chr, max("end") AS size FROM spans GROUP BY chr)"""
TILES = """tiles AS (SELECT chr, i * 4000 + 1 AS start, least(i * 4000 + 5000, size) AS "end"
  FROM sizes, unnest(range(0, CAST(greatest(0, ceil((size - 1000) / 4000) - 1) AS BIGINT) + 1)) t(i))"""
SITES = """sites AS (SELECT event_id AS site_id, chr, CAST(floor((ref_start + 1 + ref_start + tlen) / 2) AS BIGINT) AS centre,
  CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, value / 500 AS score FROM fragments WHERE tlen > 187)"""
GENES = """g0 AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS strand, ref_start + 1 AS l, ref_start + tlen AS r FROM fragments WHERE tlen BETWEEN 81 AND 126),
  g1 AS (SELECT *, CASE WHEN strand = 1 THEN l ELSE r END AS tss, CASE WHEN strand = 1 THEN r ELSE l END AS tts FROM g0),
  genes AS (SELECT chr, 'Y' || event_id || CASE WHEN strand = 1 THEN 'W' ELSE 'C' END AS orf, strand, tss + strand * 30 AS plus1, tss - strand * 150 AS minus1,
    tss, tts, tss + strand * 5 AS orf_start, tts - strand * 5 AS orf_end, event_id AS "row" FROM g1),
  extent AS (SELECT *, greatest(tss, tts, orf_start, orf_end) AS top, least(tss, tts, orf_start, orf_end) AS foot FROM genes)"""
CALLS = """calls AS (SELECT user_id % 3 AS sample, chr, CAST(floor((ref_start + 1 + ref_start + tlen) / 2) AS BIGINT) AS dyad, max(value) / 190 AS dyad_score,
  max(value) / 200 AS min_occ_score FROM fragments WHERE tlen BETWEEN 127 AND 187 GROUP BY ALL)"""
