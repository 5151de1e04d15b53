"""Queries over linked samples and differences between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import KMEANS_ROUNDS
from ..functions.scalar import ERFC
from ..operators import cluster, diff, fit, link
from ..operators.occupancy import union_all
from ..operators.signal import midpoint_histogram
from . import tables as T

QUERIES: dict[str, T.Query] = {}
SQL: dict[str, str] = {}
query = T.registered(QUERIES, SQL)


def _linked(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return link.link([T.calls(spark, sf_dir, i) for i in range(n)])


# Two lists of a chromosome merged step by step: the heads are taken together if they are close, else the earlier one alone.
LINKED = f"""{T.FRAGMENTS}, {T.CALLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sample, chr ORDER BY dyad) AS k FROM calls WHERE min_occ_score > 0.1),
    pairs AS (SELECT DISTINCT chr, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM ranked UNION ALL
      SELECT chr, i + CAST(x AS INTEGER), j + CAST(y AS INTEGER), CASE WHEN x THEN da END, CASE WHEN y THEN db END FROM
        (SELECT s.chr, s.i, s.j, a.dyad AS da, b.dyad AS db, a.dyad IS NOT NULL AND (b.dyad IS NULL OR a.dyad - b.dyad <= 73) AS x, b.dyad IS NOT NULL AND (a.dyad IS NULL OR b.dyad - a.dyad <= 73) AS y
         FROM pairs s LEFT JOIN ranked a ON a.sample = 0 AND a.chr = s.chr AND a.k = s.i LEFT JOIN ranked b ON b.sample = 1 AND b.chr = s.chr AND b.k = s.j) WHERE x OR y),
    two AS (SELECT chr, a, b FROM pairs WHERE a IS NOT NULL OR b IS NOT NULL)"""
LINKED_THREE = f"""{LINKED}, mean AS (SELECT *, coalesce(b, a) AS z, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) // 2 END AS m FROM two),
    rows2 AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY m, a NULLS LAST, b NULLS LAST) AS k FROM mean),
    thirds AS (SELECT DISTINCT chr, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c FROM ranked UNION ALL
      SELECT chr, i + CAST(x AS INTEGER), j + CAST(y AS INTEGER), CASE WHEN x THEN a END, CASE WHEN x THEN b END, CASE WHEN y THEN c END FROM
        (SELECT *, k IS NOT NULL AND (c IS NULL OR hit OR older) AS x, c IS NOT NULL AND (k IS NULL OR hit OR NOT older) AS y FROM
          (SELECT s.chr, s.i, s.j, r.k, r.a, r.b, n.dyad AS c, CASE WHEN r.b IS NULL THEN n.dyad BETWEEN r.low - 73 AND r.high + 73 ELSE abs(n.dyad - r.b) <= 73 END AS hit,
             CASE WHEN r.b IS NULL THEN r.low <= n.dyad ELSE r.b < n.dyad END AS older
           FROM thirds s LEFT JOIN rows2 r ON r.chr = s.chr AND r.k = s.i LEFT JOIN ranked n ON n.sample = 2 AND n.chr = s.chr AND n.k = s.j)) WHERE x OR y),
    three AS (SELECT chr, a, b, c FROM thirds WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL)"""


def _named(letters: str, table: str) -> str:
    """The linked rows of ``table`` with each sample's scores, shifts and names, in SQL."""
    columns = ", ".join(f'{x} AS "dyad{x.upper()}", {x}_.min_occ_score AS "occupancy{x.upper()}", {x}_.dyad_score AS "pdyad{x.upper()}"' for x in letters)
    joins = " ".join(f"LEFT JOIN ranked {x}_ ON {x}_.sample = {i} AND {x}_.chr = l.chr AND {x}_.dyad = l.{x}" for i, x in enumerate(letters))
    shifts = ", ".join(f'{b} - {a} AS "shift_{a.upper()}{b.upper()}"' for a, b in zip(letters, letters[1:], strict=False))
    order = f"coalesce({', '.join(letters)}), " + ", ".join(f"{x} NULLS FIRST" for x in letters)
    return f"SELECT l.chr, {columns}, {shifts}, 'nuc_' || (row_number() OVER (ORDER BY l.chr, {order}) - 1) AS name FROM {table} l {joins}"


@query(f"WITH RECURSIVE {LINKED} {_named('ab', 'two')}")
def greedy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.named(_linked(spark, sf_dir, 2), 2)


@query(f"WITH RECURSIVE {LINKED_THREE} {_named('abc', 'three')}")
def greedy_link_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.named(_linked(spark, sf_dir, 3), 3)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples side by side: the first call of each 100 bases, with shifts."""
    rows = None
    for i in range(3):
        one = T.calls(spark, sf_dir, i).withColumn("cell", F.floor(F.col("dyad") / 100)).withColumn("i", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("chr", "cell").agg(*(F.min(F.when(F.col("i") == i, F.col("dyad"))).alias(f"dyad{c}") for i, c in enumerate("ABC")))
    return wide.withColumns(link.shifts(3))


GRID = f"""{T.FRAGMENTS}, {T.CALLS}, grid AS (SELECT chr, CAST(floor(dyad / 100) AS BIGINT) AS cell, min(dyad) FILTER (sample = 0) AS "dyadA", min(dyad) FILTER (sample = 1) AS "dyadB",
    min(dyad) FILTER (sample = 2) AS "dyadC" FROM calls GROUP BY ALL), shifted AS (SELECT *, "dyadB" - "dyadA" AS "shift_AB", "dyadC" - "dyadB" AS "shift_BC" FROM grid)"""


@query(f'WITH {GRID} SELECT chr, cell, "shift_AB", "shift_BC" FROM shifted')
def sample_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("chr", "cell", "shift_AB", "shift_BC")


@query(f'WITH {GRID} SELECT chr, cell, "shift_AB" AS "shift_AB_first", "shift_AB" + "shift_BC" AS "shift_BC_first" FROM shifted')
def prefix_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir).withColumns(link.cumulative_shifts(["shift_AB", "shift_BC"]))
    return rows.select("chr", "cell", "shift_AB_first", "shift_BC_first")


@query(
    f"""WITH {GRID} SELECT chr, cell, CASE WHEN "shift_AB" IS NULL OR "shift_BC" IS NULL THEN '4_not_always_present'
    WHEN abs("shift_AB") <= 20 AND abs("shift_BC") <= 20 THEN '1_no_shift'
    WHEN abs("shift_AB") > 20 AND abs("shift_BC") > 20 AND sign("shift_AB") <> sign("shift_BC") THEN '3_nondirectional_shift' ELSE '2_directional_shift' END AS shift_type FROM shifted"""
)
def shift_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("chr", "cell", link.shift_class(["shift_AB", "shift_BC"]).alias("shift_type"))


@query(
    f"""WITH {GRID} SELECT chr, cell, CASE WHEN "dyadA" IS NULL THEN 'null_A' WHEN "dyadB" IS NULL THEN 'null_B' ELSE 'not_null' END AS category,
    greatest("dyadA", "dyadB") AS dyad FROM shifted WHERE "dyadA" IS NOT NULL OR "dyadB" IS NOT NULL"""
)
def pair_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir).where("dyadA is not null or dyadB is not null")
    return rows.withColumns(link.pair_category()).select("chr", "cell", "category", "dyad")


@query(f"""WITH {GRID} SELECT chr, least("dyadA", "dyadB", "dyadC") - 73 AS start, greatest("dyadA", "dyadB", "dyadC") + 74 AS "end" FROM shifted""")
def linked_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.beds(_grid(spark, sf_dir), 3)


def _sites(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Line items as binding sites: a sample for each return flag, scored by discount."""
    rows = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("tf"), F.concat(F.lit("chr"), F.pmod("l_suppkey", F.lit(16))).alias("chr"), F.col("l_partkey").alias("start"), "l_returnflag", F.col("l_discount").alias("score")
    ).withColumn("end", F.col("start") + 11)
    best = rows.groupBy("l_returnflag", "tf", "chr", "start", "end").agg(F.max("score").alias("score"))
    return [best.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "ANR"]


MERGED = """s AS (SELECT l_returnflag AS f, l_linestatus AS tf, 'chr' || (l_suppkey % 16) AS chr, l_partkey AS start, l_partkey + 11 AS "end", max(l_discount) AS score FROM lineitem GROUP BY ALL),
    a AS (SELECT * EXCLUDE (f) FROM s WHERE f = 'A'), n AS (SELECT * EXCLUDE (f) FROM s WHERE f = 'N'), r AS (SELECT * EXCLUDE (f) FROM s WHERE f = 'R'),
    j AS (SELECT tf, chr, start, "end", a.score AS "scoreA", n.score AS "scoreB", r.score AS "scoreC" FROM a FULL JOIN n USING (tf, chr, start, "end") FULL JOIN r USING (tf, chr, start, "end")),
    merged AS (SELECT * FROM j WHERE coalesce("scoreA", 0) > 0.05 OR coalesce("scoreB", 0) > 0.05 OR coalesce("scoreC", 0) > 0.05)"""


@query(f"WITH {MERGED} SELECT * FROM merged")
def outer_merge_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.merge_sites(_sites(spark, sf_dir), minimum=0.05)


@query(
    f"""WITH {MERGED} SELECT chr AS cluster, tf, count(*) AS n, round(coalesce(sum("scoreB" - "scoreA"), NULL) / count(*), 6) AS "diff_scoreB",
    round(sum("scoreC" - "scoreA") / count(*), 6) AS "diff_scoreC" FROM merged GROUP BY chr, tf"""
)
def mean_diff_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.merge_sites(_sites(spark, sf_dir), minimum=0.05).withColumnRenamed("chr", "cluster")
    found = diff.mean_change(rows, ["scoreA", "scoreB", "scoreC"])
    return found.select("cluster", "tf", "n", *(F.round(c, 6).alias(c) for c in ("diff_scoreB", "diff_scoreC")))


@query(
    f"""WITH {MERGED}, d AS (SELECT tf, "scoreB" - "scoreA" AS d FROM merged) SELECT tf, count(d) AS n, round(avg(d), 6) AS mean, round(avg(d) - 2 * stddev_pop(d), 6) AS low,
    round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3, round(avg(d) + 2 * stddev_pop(d), 6) AS high FROM d GROUP BY tf"""
)
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.merge_sites(_sites(spark, sf_dir), minimum=0.05).withColumn("d", F.col("scoreB") - F.col("scoreA"))
    found = diff.spread(rows, "d", ["tf"])
    return found.select("tf", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sites in genes: factor by priority, gene by customer, cluster by nation."""
    nation = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gene"), F.pmod("c_nationkey", F.lit(4)).cast("int").alias("cluster"))
    sites = T.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tf"), F.col("o_custkey").alias("gene"))
    return sites.join(nation, "gene")


@query(
    """WITH g AS (SELECT c_custkey AS gene, c_nationkey % 4 AS cluster FROM customer), sz AS (SELECT cluster, count(*) AS size FROM g GROUP BY cluster),
    n AS (SELECT o_orderpriority AS tf, cluster, count(DISTINCT gene) AS n FROM orders JOIN g ON gene = o_custkey GROUP BY ALL),
    p AS (SELECT tf, cluster, 100.0 * n / size AS p FROM n JOIN sz USING (cluster)),
    w AS (SELECT tf, coalesce(max(p) FILTER (cluster = 0), 0) AS c1, coalesce(max(p) FILTER (cluster = 1), 0) AS c2, coalesce(max(p) FILTER (cluster = 2), 0) AS c3, coalesce(max(p) FILTER (cluster = 3), 0) AS c4 FROM p GROUP BY tf)
    SELECT tf, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, round(c4, 6) AS c4 FROM w
    WHERE greatest(c1, c2, c3, c4) > 86.5 AND least(c1, c2, c3, c4) <= 86.5"""
)
def percent_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = T.table(spark, sf_dir, "customer").groupBy(F.pmod("c_nationkey", F.lit(4)).cast("int").alias("cluster")).agg(F.count("*").alias("size"))
    found = diff.percent_by_cluster(_orders(spark, sf_dir), sizes, [0, 1, 2, 3], minimum=86.5)
    return found.select("tf", *(F.round(c, 6).alias(c) for c in ("c1", "c2", "c3", "c4")))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("chr"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 10).alias("end"), F.col("l_returnflag").alias("tf"),
        (F.col("l_discount") - F.col("l_tax")).alias("diff"), F.col("l_tax").alias("probA"), F.col("l_discount").alias("probB")
    )


Z = """c AS (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS chr, l_partkey AS start, l_partkey + 10 AS "end", l_returnflag AS tf, l_discount - l_tax AS diff, l_tax AS "probA", l_discount AS "probB" FROM lineitem),
    b AS (SELECT tf, avg(diff) AS m, stddev_pop(diff) AS s FROM c GROUP BY tf)"""


@query(
    f"""WITH {Z} SELECT chr, start, "end", tf, round(diff, 6) AS diff, round((diff - m) / s, 4) AS z FROM c JOIN b USING (tf) WHERE abs(diff) > 0.001 AND abs((diff - m) / s) > 1.959963984540054"""
)
def z_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    found = diff.z_scores(rows, rows.select("tf", "diff"))
    return found.select("chr", "start", "end", "tf", F.round("diff", 6).alias("diff"), F.round("z", 4).alias("z"))


#: The p-value's polynomial in SQL, over t.
POLYNOMIAL = "(" * 9 + f"{ERFC[-1]}" + "".join(f" * t + {c})" for c in ERFC[::-1][1:])


@query(
    f"""WITH {Z}, x AS (SELECT c.*, (diff - m) / s AS z, abs((diff - m) / s) / sqrt(2.0) AS x FROM c JOIN b USING (tf) WHERE abs(diff) > 0.001), y AS (SELECT *, 1 / (1 + x / 2) AS t FROM x),
    p AS (SELECT *, t * exp(-x * x + {POLYNOMIAL}) AS p FROM y)
    SELECT chr, start, "end", tf, round(diff, 6) AS diff, round("probA", 6) AS "probA", round("probB", 6) AS "probB", round(z, 4) AS z, round(p, 6) AS p_value FROM p WHERE p < 0.05"""
)
def differential_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    found = diff.z_scores(rows, rows.select("tf", "diff"))
    digits = {"diff": 6, "probA": 6, "probB": 6, "z": 4, "p_value": 6}
    return found.select("chr", "start", "end", "tf", *(F.round(c, k).alias(c) for c, k in digits.items()))


def _posterior(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Line items of a return flag as a posterior: a probability for each supplier's chromosome, part and line status."""
    rows = T.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    keys = [F.concat(F.lit("chr"), F.pmod("l_suppkey", F.lit(16))).alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("tf")]
    return rows.select(*keys, (F.col("l_discount") * 10).alias("prob"))


@query(
    """WITH s AS (SELECT l_returnflag AS f, 'chr' || (l_suppkey % 16) AS chr, l_partkey AS pos, l_linestatus AS tf, avg(l_discount * 10) AS prob FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    a AS (SELECT chr, pos, tf, prob AS pa FROM s WHERE f = 'A'), r AS (SELECT chr, pos, tf, prob AS pr FROM s WHERE f = 'R')
    SELECT chr, pos, tf, round(coalesce(pa, 0), 6) AS "probA", round(coalesce(pr, 0), 6) AS "probB", round(coalesce(pr, 0) - coalesce(pa, 0), 6) + 0.0 AS diff FROM a FULL JOIN r USING (chr, pos, tf)"""
)
def posterior_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.change(_posterior(spark, sf_dir, "A"), _posterior(spark, sf_dir, "R"))
    return found.select("chr", "pos", "tf", *((F.round(c, 6) + 0.0).alias(c) for c in ("probA", "probB", "diff")))


@query(
    f"""WITH p AS (SELECT l_returnflag AS f, 'chr' || (l_suppkey % 16) AS chr, l_partkey * 100 AS pos, 'f' || (l_linenumber % 3) AS tf, avg(round(l_discount * 100) * round(l_discount * 100) / 256) AS prob FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    w AS (SELECT chr, pos, tf, coalesce(max(prob) FILTER (f = 'A'), 0) AS "probA", coalesce(max(prob) FILTER (f = 'R'), 0) AS "probB" FROM p GROUP BY ALL), d AS (SELECT *, "probB" - "probA" AS diff FROM w),
    n AS (SELECT l_orderkey || '-' || l_linenumber AS name, 'chr' || (l_suppkey % 16) AS chr, l_partkey * 100 AS a, l_partkey * 100 + CAST(l_quantity AS BIGINT) AS b FROM lineitem WHERE l_returnflag = 'N'),
    around AS (SELECT name, tf, max_by(diff, abs(diff) * 1000000 + sign(diff)) AS diff FROM n JOIN d ON d.chr = n.chr AND pos BETWEEN least(b - 73, a) AND greatest(a + 73, b) GROUP BY ALL),
    b AS (SELECT tf, avg(diff) AS m, stddev_pop(diff) AS s FROM around GROUP BY tf),
    sites AS (SELECT DISTINCT 'chr' || (l_suppkey % 16) AS chr, l_partkey * 100 AS start, l_partkey * 100 + 11 AS "end", 'f' || (l_linenumber % 3) AS tf FROM lineitem WHERE l_returnflag = 'N'),
    c AS (SELECT s.*, diff, "probA", "probB" FROM sites s JOIN d ON d.chr = s.chr AND d.tf = s.tf AND pos BETWEEN start AND "end" QUALIFY row_number() OVER (PARTITION BY s.chr, start, s.tf ORDER BY abs(diff) DESC, diff DESC, pos DESC) = 1),
    x AS (SELECT c.*, (diff - m) / s AS z, abs((diff - m) / s) / sqrt(2.0) AS x FROM c JOIN b USING (tf) WHERE abs(diff) > 0.001), y AS (SELECT *, 1 / (1 + x / 2) AS t FROM x),
    q AS (SELECT *, t * exp(-x * x + {POLYNOMIAL}) AS p FROM y)
    SELECT chr, start, "end", tf, round(diff, 6) AS diff, round("probA", 6) AS "probA", round("probB", 6) AS "probB", round(z, 4) AS z, round(p, 6) AS p_value FROM q WHERE p < 0.05"""
)
def tf_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem")
    chrom, pos, tf = F.concat(F.lit("chr"), F.pmod("l_suppkey", F.lit(16))).alias("chr"), F.col("l_partkey") * 100, F.concat(F.lit("f"), F.pmod("l_linenumber", F.lit(3))).alias("tf")
    percent = F.round(F.col("l_discount") * 100)
    a, b = (rows.where(F.col("l_returnflag") == f).select(chrom, pos.alias("pos"), tf, (percent * percent / 256).alias("prob")) for f in "AR")
    rest = rows.where(F.col("l_returnflag") == "N")
    nucs = rest.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), chrom, pos.alias("dyadA"), (pos + F.col("l_quantity").cast("long")).alias("dyadB"))
    sites = rest.select(chrom, pos.alias("start"), (pos + 11).alias("end"), tf).distinct()
    found = diff.between_samples(a, b, nucs, sites)
    digits = {"diff": 6, "probA": 6, "probB": 6, "z": 4, "p_value": 6}
    return found.select("chr", "start", "end", "tf", *(F.round(c, k).alias(c) for c, k in digits.items()))


@query(
    f"""WITH {GRID}, n AS (SELECT chr || ':' || cell AS name, CASE WHEN "dyadA" IS NULL THEN 'null_A' WHEN "dyadB" IS NULL THEN 'null_B' ELSE 'not_null' END AS category FROM shifted
    WHERE "dyadA" IS NOT NULL OR "dyadB" IS NOT NULL),
    v AS (SELECT chr || ':' || CAST(floor(ref_start / 100) AS BIGINT) AS name, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tf, round(value) - 100 AS diff FROM fragments)
    SELECT category, tf, count(*) AS n, round(avg(diff), 6) AS mean, count(*) FILTER (diff > 0) AS up, count(*) FILTER (diff < 0) AS down FROM n JOIN v USING (name) GROUP BY ALL"""
)
def change_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    nucs = _grid(spark, sf_dir).withColumn("name", F.concat_ws(":", "chr", "cell"))
    rows = T.fragments(spark, sf_dir).withColumn("name", F.concat_ws(":", "chr", F.floor(F.col("ref_start") / 100)))
    tf = F.when(F.pmod("user_id", F.lit(2)) == 0, "even").otherwise("odd").alias("tf")
    found = diff.change_by_category(nucs, rows.select("name", tf, (F.round("value") - 100).alias("diff")))
    return found.withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH {GRID}, {T.MIDS.replace(T.FRAGMENTS + ", ", "")}, b AS (SELECT *, least("dyadA", "dyadB") AS near, greatest("dyadA", "dyadB") AS far FROM shifted WHERE "dyadA" IS NOT NULL AND "dyadB" IS NOT NULL),
    v AS (SELECT chr, pos, cls AS tf, n * (CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END) AS diff FROM hist)
    SELECT b.chr || ':' || b.cell AS name, v.tf, CAST(max_by(v.diff, abs(v.diff) * 1000000 + v.diff) AS BIGINT) AS diff FROM b JOIN v ON v.chr = b.chr AND v.pos BETWEEN least(far - 73, near) AND greatest(near + 73, far) GROUP BY ALL"""
)
def strongest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    nucs = _grid(spark, sf_dir).withColumn("name", F.concat_ws(":", "chr", "cell")).select("name", "chr", "dyadA", "dyadB")
    signed = F.col("n") * F.when(F.pmod("pos", F.lit(2)) == 0, 1).otherwise(-1)
    change = midpoint_histogram(T.midpoints(spark, sf_dir)).select("chr", "pos", F.col("cls").alias("tf"), signed.alias("diff"))
    return diff.strongest_change(nucs, change)


def _kmeans(vectors: str, k: int, shown: str) -> str:
    """k-means in SQL: ``vectors`` gives v (a list) and more columns; ``shown`` is selected from them and ``cluster``, from 0."""
    seeds = ["k1 AS (SELECT min(v) AS c FROM u)"]
    for i in range(2, k + 1):
        known = " UNION ALL ".join(f"SELECT c FROM k{j}" for j in range(1, i))
        seeds.append(f"k{i} AS (SELECT v AS c FROM (SELECT u.v, min(list_distance(u.v, s.c)) AS far FROM u, ({known}) s GROUP BY u.v) ORDER BY far DESC, v LIMIT 1)")
    near = "list_transform(cs, lambda c: list_distance(v, c))"
    return f"""WITH RECURSIVE x AS MATERIALIZED ({vectors}), u AS MATERIALIZED (SELECT DISTINCT v FROM x), {", ".join(seeds)},
    m AS (SELECT 0 AS r, [{", ".join(f"(SELECT c FROM k{i})" for i in range(1, k + 1))}] AS cs UNION ALL
      SELECT r + 1, list(c ORDER BY k) FROM (SELECT r, k, list(a ORDER BY i) AS c FROM
        (SELECT r, k, i, avg(y) AS a FROM (SELECT r, list_position(far, list_min(far)) AS k, unnest(v) AS y, unnest(range(len(v))) AS i
          FROM (SELECT r, v, {near} AS far FROM m, x WHERE r < {KMEANS_ROUNDS})) GROUP BY ALL) GROUP BY ALL) GROUP BY r),
    e AS (SELECT cs, list_transform(cs, lambda c: list_avg(c)) AS means FROM m ORDER BY r DESC LIMIT 1),
    f AS (SELECT x.*, means, {near} AS far FROM x, e), g AS (SELECT *, means[list_position(far, list_min(far))] AS own FROM f)
    SELECT {shown} FROM (SELECT *, CAST(len(list_filter(means, lambda y: y < own)) AS INTEGER) AS cluster FROM g)"""


@query(_kmeans("SELECT vec_id, list_transform(embedding, lambda y: least(coalesce(CAST(y AS DOUBLE), 0), 1)) AS v FROM embeddings", 4, "vec_id, cluster + 1 AS occ_cluster"))
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = T.table(spark, sf_dir, "embeddings")
    columns = [f"pdyad{i}" for i in range(table.agg(F.max(F.size("embedding"))).first()[0])]
    rows = table.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)))
    return cluster.cluster_occupancy(rows, columns, 4).select("vec_id", "occ_cluster")


@query(
    _kmeans(
        """SELECT c_custkey, [(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer),
        (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer)]::DOUBLE[] AS v FROM customer""",
        4,
        "c_custkey, cluster",
    )
)
def kmeans_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["c_acctbal", "c_nationkey"]
    return cluster.cluster_scaled(T.table(spark, sf_dir, "customer"), columns, 4).select("c_custkey", "cluster")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'),
    i AS (SELECT k FROM a INTERSECT SELECT k FROM b), x AS (SELECT k FROM a EXCEPT SELECT k FROM b)
    SELECT 'both' AS kind, k, CAST(NULL AS BIGINT) AS n FROM i UNION ALL SELECT 'only_f', k, NULL FROM x UNION ALL SELECT 'all', NULL, count(*) FROM orders"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FP")
    return union_all(
        [
            a.intersect(b).select(F.lit("both").alias("kind"), "k"),
            a.subtract(b).select(F.lit("only_f").alias("kind"), "k"),
            orders.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "n"),
        ]
    )


def _hashed(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({key} || ':{seed}'), 1, 15) AS BIGINT)"


@query(
    f"""WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_hashed("o_orderkey", 9)}, o_orderkey) AS place FROM orders), n AS (SELECT count(*) AS n FROM orders),
    d AS (SELECT {_hashed("i", 9)} % n + 1 AS place, count(*) AS draws FROM n, unnest(range(n)) t(i) GROUP BY ALL)
    SELECT o_orderkey, draws FROM ranked JOIN d USING (place)"""
)
def draws_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are orders."""
    orders = T.table(spark, sf_dir, "orders").select("o_orderkey")
    return fit.drawn(orders, "o_orderkey", orders.count(), 9)


@query(
    f"""WITH {T.SPANS}, room AS (SELECT chr, size - 49 AS places, coalesce(sum(size - 49) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sizes WHERE size >= 50),
    d AS (SELECT i AS draw, {_hashed("i", 10)} % (SELECT sum(places) FROM room) AS spot FROM (SELECT count(*) AS n FROM spans) m, unnest(range(n)) t(i))
    SELECT draw, chr, CAST(spot - first + 1 AS BIGINT) AS start, CAST(spot - first + 50 AS BIGINT) AS "end" FROM d JOIN room ON spot >= first AND spot < first + places"""
)
def random_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many stretches of 50 bases as there are fragments."""
    return fit.random_segments(T.sizes(spark, sf_dir), T.spans(spark, sf_dir).count(), 50, 10)


REGION_MARKS = " UNION ALL ".join(
    f"""SELECT chr, r_start, r_end, '{x}' AS sample, "dyad{x}" AS dyad, "dyad{x}" - 25 AS start, "dyad{x}" + 25 AS "end", 0.9 * "pdyad{x}" AS strength,
    CASE WHEN {f'"dyad{x}" - "dyad{p}" > 20' if p else 'false'} THEN 'later' WHEN {f'"dyad{x}" - "dyad{p}" < -20' if p else 'false'} THEN 'earlier' ELSE 'same' END AS shift,
    {f'"dyad{p}"' if p else 'CAST(NULL AS BIGINT)'} AS previous FROM met WHERE "dyad{x}" IS NOT NULL"""
    for p, x in zip(["", "A", "B"], "ABC", strict=True)
)


@query(
    f"""WITH RECURSIVE {LINKED_THREE}, sizes AS (SELECT event_type AS chr, max(ref_start + tlen) AS size FROM fragments JOIN events USING (event_id) WHERE tlen > 0 GROUP BY ALL), {T.TILES},
    named AS ({_named("abc", "three")}), met AS (SELECT n.*, t.start AS r_start, t."end" AS r_end FROM named n JOIN tiles t ON n.chr = t.chr
      AND least("dyadA", "dyadB", "dyadC") + 27 >= t.start AND greatest("dyadA", "dyadB", "dyadC") - 25 <= t."end") {REGION_MARKS}"""
)
def region_nucleosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each segment's view shows of the nucleosomes of three samples."""
    regions = T.tiles(spark, sf_dir).select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return diff.region_nucleosomes(_linked(spark, sf_dir, 3), 3, regions)


@query(
    f"""WITH {MERGED}, regions AS (SELECT 'chr' || (s_suppkey % 16) AS chr, min(s_suppkey) * 7 AS r_start, min(s_suppkey) * 7 + 400 AS r_end FROM supplier GROUP BY ALL)
    SELECT m.chr, r_start, r_end, tf, start, "end", CAST((start + "end") // 2 AS BIGINT) AS centre, coalesce("scoreA", 0) AS "scoreA", coalesce("scoreB", 0) AS "scoreB", coalesce("scoreC", 0) AS "scoreC",
    least(coalesce("scoreA", 0), coalesce("scoreB", 0), coalesce("scoreC", 0)) < 0.08 AS changed FROM merged m JOIN regions r ON m.chr = r.chr AND start < r_end AND "end" >= r_start
    WHERE greatest("scoreA", "scoreB", "scoreC") > 0.08"""
)
def region_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of three samples in a region of each chromosome."""
    key = F.concat(F.lit("chr"), F.pmod("s_suppkey", F.lit(16)))
    first = T.table(spark, sf_dir, "supplier").groupBy(key.alias("chr")).agg((F.min("s_suppkey") * 7).alias("r_start"))
    merged = diff.merge_sites(_sites(spark, sf_dir), minimum=0.05)
    return diff.region_sites(merged, 3, first.withColumn("r_end", F.col("r_start") + 400), minimum=0.08)
