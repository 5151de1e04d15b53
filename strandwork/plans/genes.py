"""Queries that set calls and sites against genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import annotate, link
from ..operators.intervals import first_match
from . import tables as T

QUERIES: dict[str, T.Query] = {}
SQL: dict[str, str] = {}
query = T.registered(QUERIES, SQL)

PROMOTERS = f"""{T.FRAGMENTS}, {T.GENES}, p0 AS (SELECT *, CASE WHEN strand = 1 THEN greatest(1, tss - 2000) ELSE tss + 1 END AS s, CASE WHEN strand = 1 THEN tss - 1 ELSE tss + 2000 END AS e FROM extent),
    promoters AS (SELECT p.chr, p.orf, CASE WHEN p.strand = 1 THEN greatest(p.s, max(o.top) FILTER (o.top < p.e)) ELSE p.s END AS promoter_start,
      CASE WHEN p.strand = 1 THEN p.e ELSE least(p.e, min(o.foot) FILTER (o.foot > p.s)) END AS promoter_end
      FROM p0 p LEFT JOIN extent o ON o.chr = p.chr AND o.orf <> p.orf GROUP BY p.chr, p.orf, p.strand, p.s, p.e)"""


@query(f"WITH {PROMOTERS} SELECT * FROM promoters")
def promoter_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.promoters(T.genes(spark, sf_dir)).select("chr", "orf", "promoter_start", "promoter_end")


def _downstream(raise_start: str) -> str:
    return f"""{T.FRAGMENTS}, {T.GENES}, d0 AS (SELECT *, CASE WHEN strand = 1 THEN tts + 1 ELSE greatest(1, tts - 500) END AS s, CASE WHEN strand = 1 THEN tts + 500 ELSE tts - 1 END AS e FROM extent)
    SELECT p.chr, p.orf, CASE WHEN p.strand = {raise_start} THEN greatest(p.s, max(o.top) FILTER (o.top < p.e)) ELSE p.s END AS downstream_start,
      CASE WHEN p.strand = {raise_start} THEN p.e ELSE least(p.e, min(o.foot) FILTER (o.foot > p.s)) END AS downstream_end
    FROM d0 p LEFT JOIN extent o ON o.chr = p.chr AND o.orf <> p.orf GROUP BY p.chr, p.orf, p.strand, p.s, p.e"""


@query("WITH " + _downstream("-1"))
def downstream_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.downstreams(T.genes(spark, sf_dir)).select("chr", "orf", "downstream_start", "downstream_end")


@query("WITH " + _downstream("1"))
def downstream_clip_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.downstreams(T.genes(spark, sf_dir), strict_compat=True).select("chr", "orf", "downstream_start", "downstream_end")


def _nucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two samples' calls of each 100 bases side by side, named by place."""
    rows = T.calls(spark, sf_dir, 0).withColumn("i", F.lit(0)).unionByName(T.calls(spark, sf_dir, 1).withColumn("i", F.lit(1)))
    cell = F.floor(F.col("dyad") / 100)
    wide = rows.groupBy("chr", cell.alias("cell")).agg(
        *(F.min(F.when(F.col("i") == i, F.col("dyad"))).alias(f"dyad{c}") for i, c in enumerate("AB")),
        *(F.max(F.when(F.col("i") == i, F.col("dyad_score"))).alias(f"pdyad{c}") for i, c in enumerate("AB")),
    )
    return wide.withColumn("name", F.concat_ws(":", "chr", "cell")).withColumns(link.shifts(2))


NUCS = f"""{T.CALLS}, nucs AS (SELECT chr || ':' || CAST(floor(dyad / 100) AS BIGINT) AS name, chr, min(dyad) FILTER (sample = 0) AS "dyadA", min(dyad) FILTER (sample = 1) AS "dyadB",
    max(dyad_score) FILTER (sample = 0) AS "pdyadA", max(dyad_score) FILTER (sample = 1) AS "pdyadB" FROM calls WHERE sample < 2 GROUP BY chr, floor(dyad / 100)),
    pts AS (SELECT name, chr, 0 AS i, "dyadA" AS p FROM nucs WHERE "dyadA" IS NOT NULL UNION ALL SELECT name, chr, 1, "dyadB" FROM nucs WHERE "dyadB" IS NOT NULL)"""


@query(
    f"""WITH {T.FRAGMENTS}, {T.GENES}, {NUCS}, hit AS (SELECT name, orf, row_number() OVER (PARTITION BY name ORDER BY i, "row") AS k FROM pts JOIN genes g ON g.chr = pts.chr AND abs(p - plus1) <= 50)
    SELECT nucs.name, orf AS plus1 FROM nucs LEFT JOIN hit ON hit.name = nucs.name AND k = 1"""
)
def first_match_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = T.genes(spark, sf_dir).select("chr", F.col("plus1").alias("at"), "row", "orf")
    nucs = _nucs(spark, sf_dir)
    found = first_match(nucs, ["dyadA", "dyadB"], marks, "at", "row", "name", 50, "orf", "plus1")
    return nucs.select("name").join(found, "name", "left")


ANNOTATED = f"""{PROMOTERS}, {NUCS},
    h1 AS (SELECT name, orf, row_number() OVER (PARTITION BY name ORDER BY i, "row") AS k FROM pts JOIN genes g ON g.chr = pts.chr AND abs(p - plus1) <= 50),
    h2 AS (SELECT name, orf, row_number() OVER (PARTITION BY name ORDER BY i, "row") AS k FROM pts JOIN genes g ON g.chr = pts.chr AND abs(p - minus1) <= 50),
    hp AS (SELECT name, string_agg(DISTINCT g.orf, ',' ORDER BY g.orf) AS orf FROM pts JOIN promoters g ON g.chr = pts.chr AND p > promoter_start AND p < promoter_end GROUP BY name),
    ho AS (SELECT name, string_agg(DISTINCT g.orf, ',' ORDER BY g.orf) AS orf FROM pts JOIN extent g ON g.chr = pts.chr AND p > foot AND p < top GROUP BY name),
    b AS (SELECT n.*, h1.orf AS plus1, h2.orf AS minus1, hp.orf AS p, ho.orf AS o FROM nucs n LEFT JOIN h1 ON h1.name = n.name AND h1.k = 1 LEFT JOIN h2 ON h2.name = n.name AND h2.k = 1
      LEFT JOIN hp ON hp.name = n.name LEFT JOIN ho ON ho.name = n.name),
    d0 AS (SELECT *, CASE WHEN strand = 1 THEN tts + 1 ELSE greatest(1, tts - 500) END AS s, CASE WHEN strand = 1 THEN tts + 500 ELSE tts - 1 END AS e FROM extent),
    down AS (SELECT p.chr, p.orf, CASE WHEN p.strand = -1 THEN greatest(p.s, max(x.top) FILTER (x.top < p.e)) ELSE p.s END AS d_start,
      CASE WHEN p.strand = -1 THEN p.e ELSE least(p.e, min(x.foot) FILTER (x.foot > p.s)) END AS d_end
      FROM d0 p LEFT JOIN extent x ON x.chr = p.chr AND x.orf <> p.orf GROUP BY p.chr, p.orf, p.strand, p.s, p.e),
    hd AS (SELECT DISTINCT name FROM pts JOIN down g ON g.chr = pts.chr AND p > d_start AND p < d_end),
    annotated AS (SELECT *, CASE WHEN plus1 IS NULL AND minus1 IS NULL THEN p END AS promoter, CASE WHEN plus1 IS NULL AND minus1 IS NULL AND p IS NULL THEN o END AS orf,
      plus1 IS NULL AND minus1 IS NULL AND p IS NULL AND o IS NULL AND name IN (SELECT name FROM hd) AS behind FROM b)"""


@query(f"WITH {ANNOTATED} SELECT name, plus1, minus1, promoter, orf FROM annotated")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.annotate(_nucs(spark, sf_dir), T.genes(spark, sf_dir), ["dyadA", "dyadB"]).select("name", "plus1", "minus1", "promoter", "orf")


@query(
    f"""WITH {ANNOTATED}, c AS (SELECT CASE WHEN behind THEN 'Downstream_nuc' WHEN orf IS NOT NULL THEN 'ORF_transcript_nuc' WHEN promoter IS NOT NULL THEN 'Promoter_nuc'
      WHEN plus1 IS NOT NULL AND minus1 IS NOT NULL THEN '+1_-1_nuc_both' WHEN plus1 IS NOT NULL THEN '+1_nuc_only' WHEN minus1 IS NOT NULL THEN '-1_nuc_only'
      ELSE 'Intergenic_nuc' END AS location, CASE WHEN "dyadA" IS NULL OR "dyadB" IS NULL THEN '4_not_always_present' WHEN abs("dyadB" - "dyadA") <= 20 THEN '1_no_shift'
      ELSE '2_directional_shift' END AS shift_type FROM annotated), n AS (SELECT shift_type, location, count(*) AS n FROM c GROUP BY ALL)
    SELECT shift_type, location, n, round(100.0 * n / sum(n) OVER (PARTITION BY shift_type), 6) AS percent FROM n"""
)
def annotation_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.annotate(_nucs(spark, sf_dir), T.genes(spark, sf_dir), ["dyadA", "dyadB"])
    rows = rows.withColumn("location", annotate.location()).withColumn("shift_type", link.shift_class(["shift_AB"]))
    return annotate.cross_tab(rows, "location", ["shift_type"]).withColumn("percent", F.round("percent", 6))


@query(
    """WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderstatus, o_orderpriority, n, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS percent FROM n"""
)
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate.cross_tab(T.table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderstatus"])
    return found.withColumn("percent", F.round("percent", 6))


@query(
    f"""WITH {T.FRAGMENTS}, {T.GENES}, {T.SITES}, sp AS (SELECT chr, orf, "row", CASE WHEN strand = 1 THEN minus1 ELSE plus1 END - 73 AS s, CASE WHEN strand = 1 THEN plus1 ELSE minus1 END + 73 AS e FROM genes),
    ch AS (SELECT * FROM sites WHERE NOT (score > 0.1 AND score / 5 > 0.1))
    SELECT site_id, string_agg(orf, ',' ORDER BY "row", orf) AS gene FROM ch LEFT JOIN sp ON sp.chr = ch.chr AND centre - 5 <= e AND centre + 5 >= s AND s <= e GROUP BY site_id"""
)
def promoter_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = T.sites(spark, sf_dir).select("site_id", "chr", (F.col("centre") - 5).alias("start"), (F.col("centre") + 5).alias("end"), F.col("score").alias("scoreA"), (F.col("score") / 5).alias("scoreB"))
    return annotate.promoter_sites(sites, T.genes(spark, sf_dir), ["scoreA", "scoreB"], "site_id").select("site_id", "gene")


@query(
    f"""WITH {T.SPANS}, {T.GENES}, {T.SITES}, b AS (SELECT chr, pos FROM sizes, unnest(range(1, size + 1)) t(pos)),
    c AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM sites s WHERE s.chr = b.chr AND b.pos BETWEEN s.centre - 5 AND s.centre + 5) THEN 'site'
      WHEN EXISTS (SELECT 1 FROM extent g WHERE g.chr = b.chr AND b.pos BETWEEN g.foot AND g.top) THEN 'gene' ELSE 'other' END AS cls FROM b)
    SELECT cls, count(*) AS bases FROM c GROUP BY cls"""
)
def genome_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = T.sites(spark, sf_dir).select("chr", (F.col("centre") - 5).alias("start"), (F.col("centre") + 5).alias("end"))
    bodies = T.genes(spark, sf_dir).select("chr", F.least(*annotate.ENDS).alias("start"), F.greatest(*annotate.ENDS).alias("end"))
    return annotate.genome_composition(T.sizes(spark, sf_dir), {"site": sites, "gene": bodies})


def _first_of(kind: str, short: str) -> str:
    return f"""{short} AS (SELECT {kind} AS gene, ("dyadB" - "dyadA") * CASE WHEN right(split_part({kind}, '-', 1), 1) = 'W' THEN 1 ELSE -1 END AS shift, "pdyadA" AS pa, "pdyadB" AS pb,
      row_number() OVER (PARTITION BY {kind} ORDER BY name) AS k FROM annotated WHERE {kind} IS NOT NULL)"""


@query(
    f"""WITH {ANNOTATED}, {_first_of("plus1", "p1")}, {_first_of("minus1", "m1")},
    bodies AS (SELECT gene, avg(coalesce("pdyadA", 0)) AS pa, avg(coalesce("pdyadB", 0)) AS pb FROM (SELECT unnest(string_split(orf, ',')) AS gene, "pdyadA", "pdyadB" FROM annotated WHERE orf IS NOT NULL) GROUP BY gene),
    f AS (SELECT * FROM p1 WHERE k = 1), l AS (SELECT * FROM m1 WHERE k = 1),
    every AS (SELECT gene FROM f UNION SELECT gene FROM l UNION SELECT gene FROM bodies)
    SELECT every.gene, f.shift AS "p1_shift_AB", f.pa AS "p1_pdyadA", f.pb AS "p1_pdyadB", l.shift AS "m1_shift_AB", l.pa AS "m1_pdyadA", l.pb AS "m1_pdyadB",
      round(bodies.pa, 6) AS "orf_pdyadA", round(bodies.pb, 6) AS "orf_pdyadB"
    FROM every LEFT JOIN f ON f.gene = every.gene LEFT JOIN l ON l.gene = every.gene LEFT JOIN bodies ON bodies.gene = every.gene"""
)
def gene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.annotate(_nucs(spark, sf_dir), T.genes(spark, sf_dir), ["dyadA", "dyadB"])
    found = annotate.gene_features(rows, 2, "name")
    return found.withColumns({c: F.round(c, 6) for c in ("orf_pdyadA", "orf_pdyadB")})


@query(
    """WITH g AS (SELECT 'chr' || (p_size % 16) AS chr, p_name AS gene, '+' AS strand, p_partkey AS start, p_partkey + p_size AS "end" FROM part)
    SELECT chr, gene, strand, min(start) AS start, max("end") AS "end" FROM g GROUP BY chr, gene, strand"""
)
def gene_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.table(spark, sf_dir, "part")
    attributes = F.concat(F.lit('gene_id "x'), F.col("p_partkey"), F.lit('"; gene_name "'), F.col("p_name"), F.lit('";'))
    gtf = part.select(F.pmod("p_size", F.lit(16)).cast("string").alias("seqname"), F.lit("+").alias("strand"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), attributes.alias("attributes"))
    return annotate.gene_extents(gtf)


@query(
    """SELECT p_partkey, upper(split_part(p_type || '_' || p_size, '_', 1)) AS family, right(split_part(p_brand, '-', 1), 1) = 'W' AS forward,
    CASE WHEN p_size - 25 < 0 THEN -1 ELSE 1 END AS direction, round(least(CASE WHEN p_size = 0 THEN 0 ELSE p_retailprice / p_size / 100 END, 1), 6) AS p FROM part"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scalar.clean_probability(F.try_divide("p_retailprice", "p_size") / 100)
    return T.table(spark, sf_dir, "part").select(
        "p_partkey",
        scalar.motif_family(F.concat_ws("_", "p_type", "p_size")).alias("family"),
        scalar.forward_orf(F.col("p_brand")).alias("forward"),
        scalar.sign(F.col("p_size") - 25).alias("direction"),
        F.round(p, 6).alias("p"),
    )
