"""Queries that write the library's files, read them again, and give what was read; and queries of column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import scalar
from ..operators import diff, hmm, intervals, occupancy, signal
from ..sources import readers, sequence, sinks
from ..storage import kept, shared_dir
from . import signals
from . import tables as T

QUERIES: dict[str, T.Query] = {}
SQL: dict[str, str] = {}
query = T.registered(QUERIES, SQL)


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _shown(codes: str) -> F.Column:
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), "").alias(codes)


SCORES = """s AS (SELECT l_linestatus AS tf, 'chr' || (l_suppkey % 16) AS chr, CAST(l_partkey AS BIGINT) AS start, CAST(l_partkey + 11 AS BIGINT) AS "end", CAST(11 AS INTEGER) AS width,
    max(l_discount) AS score FROM lineitem GROUP BY ALL)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey").cast("long")
    keys = [F.col("l_linestatus").alias("tf"), F.concat(F.lit("chr"), F.pmod("l_suppkey", F.lit(16))).alias("chr"), start.alias("start"), (start + 11).alias("end"), F.lit(11).alias("width")]
    return rows.groupBy(*keys).agg(F.max("l_discount").cast("double").alias("score"))


@query(f"WITH {SCORES} SELECT * FROM s")
def site_scores_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "site-scores")
    sinks.site_scores(_scores(spark, sf_dir), path)
    return readers.site_scores(spark, path)


@query(f"WITH {SCORES} SELECT tf, chr, start AS pos, score AS prob FROM s WHERE score >= 1e-4")
def posterior_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "posterior")
    sinks.posterior(_scores(spark, sf_dir).select("tf", "chr", F.col("start").alias("pos"), F.col("score").alias("prob")), path)
    return spark.read.parquet(path)


@query(f"WITH {T.MIDS} SELECT chr, pos, CAST(sum(CASE WHEN cls = 'long' THEN n ELSE 0 END) AS BIGINT) AS n FROM hist GROUP BY chr, pos HAVING sum(CASE WHEN cls = 'long' THEN n ELSE 0 END) <> 0")
def sparse_signal_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "signal")
    rows = T.midpoints(spark, sf_dir).groupBy("chr", "pos").agg(F.count_if(F.col("cls") == "long").alias("n"))
    sinks.sparse(rows, path)
    return spark.read.parquet(path)


@query(
    f"""WITH {T.FRAGMENTS}, {T.SITES}, b AS (SELECT chr, CAST(centre - 5 AS INTEGER) AS start, CAST(centre + 6 AS INTEGER) AS "end", 's' || site_id AS name, CAST(floor(score * 1000) AS INTEGER) AS score, strand FROM sites)
    SELECT *, CAST(floor((start + "end") / 2) AS BIGINT) AS centre FROM b"""
)
def site_bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, centre = _path(spark, "sites"), F.col("centre")
    name, score = F.concat(F.lit("s"), F.col("site_id")).alias("name"), F.floor(F.col("score") * 1000).cast("int").alias("score")
    sinks.bed(T.sites(spark, sf_dir).select("chr", (centre - 5).alias("start"), (centre + 6).alias("end"), name, score, "strand"), path)
    return readers.sites(spark, path)


@query(f"WITH {T.FRAGMENTS}, {T.CALLS} SELECT DISTINCT chr, CAST(dyad - 73 AS INTEGER) AS start, CAST(dyad + 73 AS INTEGER) AS \"end\", dyad FROM calls")
def dyad_bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, d = _path(spark, "dyads"), F.col("dyad")
    rows = T.calls(spark, sf_dir, 0).unionByName(T.calls(spark, sf_dir, 1)).unionByName(T.calls(spark, sf_dir, 2))
    sinks.bed(rows.select("chr", (d - 73).alias("start"), (d + 73).alias("end")).distinct(), path)
    return readers.dyads(spark, path)


@query(f'WITH {T.SPANS}, {T.TILES} SELECT chr, start, "end" FROM tiles')
def segment_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "segments")
    sinks.tsv(intervals.tiles(T.sizes(spark, sf_dir)), path)
    return readers.segments(spark, path).select("chr", "start", "end")


@query(
    """WITH o AS (SELECT CAST(l_suppkey % 16 AS BIGINT) AS segment_id, CAST(l_partkey AS BIGINT) AS pos, coalesce(sum(l_discount / 7) FILTER (l_linestatus = 'F'), 0) AS f,
      coalesce(sum(l_discount / 7) FILTER (l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY ALL)
    SELECT segment_id, pos, CAST(printf('%.5e', f) AS DOUBLE) AS "F", CAST(printf('%.5e', o) AS DOUBLE) AS "O" FROM o"""
)
def binding_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "binding")
    segment = F.pmod("l_suppkey", F.lit(16)).cast("long").alias("segment_id")
    rows = T.table(spark, sf_dir, "lineitem").groupBy(segment, F.col("l_partkey").cast("long").alias("pos"), F.col("l_linestatus").alias("dbf")).agg(F.sum(F.col("l_discount") / 7).alias("prob"))
    sinks.binding(occupancy.wide(rows, ["F", "O"], ("segment_id", "pos")), path)
    return spark.read.schema("segment_id long, pos long, F double, O double").option("sep", "\t").option("header", True).csv(path)


@query(
    f"""WITH {T.FRAGMENTS}, {T.CALLS}, {SCORES} SELECT 'dyads' AS "table", chr, dyad AS pos, dyad_score AS score FROM calls WHERE sample = 1
    UNION ALL SELECT 'sites', chr, start, score FROM s"""
)
def call_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _path(spark, "calls")
    sinks.calls(root, {"dyads": T.calls(spark, sf_dir, 0), "sites": _scores(spark, sf_dir)})
    sinks.calls(root, {"dyads": T.calls(spark, sf_dir, 1)})
    read = lambda name, at, score: spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("table"), "chr", F.col(at).alias("pos"), F.col(score).alias("score"))
    return read("dyads", "dyad", "dyad_score").unionByName(read("sites", "start", "score"))


@query(f"WITH {T.SPANS} SELECT chr, CAST(size AS BIGINT) AS size FROM sizes WHERE chr <> 'view'")
def chrom_sizes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "sizes")
    T.sizes(spark, sf_dir).select(F.concat_ws("\t", "chr", "size").alias("value")).write.text(path)
    return readers.chrom_sizes(spark, path, without=("view",))


@query(
    """WITH r AS (SELECT 'p' || p_partkey AS chr, regexp_replace(p_name, '\\s', '', 'g') AS seq FROM part)
    SELECT chr, CAST(length(seq) AS BIGINT) AS size, substr(seq, 2, 6) AS seq, translate(regexp_replace(upper(substr(seq, 2, 6)), '[^ACGT]', '4', 'g'), 'ACGT', '0123') AS codes FROM r WHERE length(seq) >= 7"""
)
def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: the name is the sequence, broken into lines where it has blanks."""
    path = _path(spark, "fasta")
    name = F.concat(F.lit(">p"), F.col("p_partkey"), F.lit(" a part\n"), F.regexp_replace("p_name", r"\s+", "\n"))
    T.table(spark, sf_dir, "part").select(name.alias("value")).write.text(path)
    records = readers.fasta(spark, path)
    sizes = readers.fasta_sizes(records).where("size >= 7")
    pieces = readers.with_sequence(sizes.select("chr", "size", F.lit(2).alias("start"), F.lit(7).alias("end")), records)
    return pieces.select("chr", "size", "seq", _shown("codes"))


@query("SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ','), ',')) AS member FROM part")
def list_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", scalar.members(F.replace("p_name", F.lit(" "), F.lit(","))).alias("member"))


@query(
    """WITH r AS (SELECT 's' || (s_suppkey % 7) AS chr, string_agg(s_name, '' ORDER BY s_suppkey) AS seq FROM supplier GROUP BY ALL),
    p AS (SELECT DISTINCT 's' || (l_suppkey % 7) AS chr, CAST(l_partkey AS BIGINT) AS start, CAST(l_partkey + l_quantity AS BIGINT) AS "end" FROM lineitem)
    SELECT p.chr, start, "end", substr(seq, start, "end" - start + 1) AS seq, CAST(length(seq) AS BIGINT) AS size FROM p JOIN r USING (chr) WHERE start > 0 AND "end" <= length(seq)"""
)
def indexed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as long records in lines of 60, indexed, cut into pieces and joined to stretches of their line items."""
    key = lambda c: F.concat(F.lit("s"), F.col(c) % 7)
    names = T.table(spark, sf_dir, "supplier").groupBy(key("s_suppkey").alias("chr")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name")))["s_name"], "").alias("s"))
    lines = F.concat(F.lit(">"), F.col("chr"), F.lit("\n"), F.regexp_replace(F.regexp_replace("s", "(.{60})", "$1\n"), "\n$", ""))
    path = _path(spark, "records")
    names.select(lines.alias("value")).coalesce(1).write.text(path)
    made = next(r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    index = sequence.index_fasta(spark, made, split_bytes=1000)
    stretches = T.table(spark, sf_dir, "lineitem").select(key("l_suppkey").alias("chr"), F.col("l_partkey").cast("long").alias("start"), (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("end")).distinct()
    stretches = stretches.join(index.select("chr", F.col("length").alias("size")), "chr").where("start > 0 and end <= size")
    return sequence.with_sequence(stretches, sequence.chunks(spark, made, index, width=128), width=128).select("chr", "start", "end", "seq", "size")


BAM_SIZE = 1 << 28


@query(
    f"""WITH {T.FRAGMENTS} SELECT event_id % 2 AS sample, chr, ref_start, count(*) AS n, CAST(sum(tlen) AS BIGINT) AS total FROM fragments
    WHERE chr IN ('click', 'view') AND ref_start >= 2000 AND ref_start < 30000 GROUP BY ALL"""
)
def bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of fragments written as BAM and read by region."""
    rows, paths = T.fragments(spark, sf_dir), []
    sizes = {r[0]: BAM_SIZE for r in rows.select("chr").distinct().collect()}
    for k in (0, 1):
        paths.append(_path(spark, f"bam-{k}"))
        sinks.bam(rows.where(F.col("event_id") % 2 == k), paths[k], sizes)
    here = readers.bam(spark, paths, ["0", "1"]).where("chr in ('click', 'view') and ref_start >= 2000 and ref_start < 30000")
    return here.groupBy(F.col("sample").cast("long").alias("sample"), "chr", "ref_start").agg(F.count("*").alias("n"), F.sum("tlen").alias("total"))


@query(
    """SELECT p_partkey, CAST(p_size AS DOUBLE) AS a1, CAST(3 AS DOUBLE) AS c1, CAST(2 AS DOUBLE) AS g1, CAST(1 AS DOUBLE) AS t1, CAST(4 + p_size AS DOUBLE) AS a2,
    CAST(3 AS DOUBLE) AS c2, CAST(2 AS DOUBLE) AS g2, CAST(p_partkey AS DOUBLE) AS t2, CAST(0 AS DOUBLE) AS n2 FROM part"""
)
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(a: F.Column, c: float, g: float, t: F.Column) -> F.Column:
        return F.struct(a.cast("double").alias("a"), F.lit(c).alias("c"), F.lit(g).alias("g"), t.cast("double").alias("t"), F.lit(0.5).alias("n"))

    motif = F.array(row(F.col("p_partkey"), 2.0, 3.0, F.col("p_size") + 4), row(F.lit(1), 2.0, 3.0, F.col("p_size")))
    found = T.table(spark, sf_dir, "part").select("p_partkey", scalar.reverse_complement(motif).alias("m"))
    return found.select("p_partkey", *(F.col("m")[i][b].alias(f"{b}{i + 1}") for i in (0, 1) for b in "acgt"), F.col("m")[1]["n"].alias("n2"))


@query(
    """WITH s AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part) SELECT x, round(exp(-(x - 25) * (x - 25) / 200) / (10 * sqrt(2 * pi())), 9) AS normal,
    round(exp(2.5 * ln(0.2) + 1.5 * ln(x) - 0.2 * x - lgamma(2.5)), 9) AS gamma FROM s"""
)
def distribution_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x")).distinct()
    normal = scalar.normal_pdf(F.col("x"), F.lit(25.0), F.lit(10.0))
    return rows.select("x", F.round(normal, 9).alias("normal"), F.round(scalar.gamma_pdf(F.col("x"), F.lit(2.5), F.lit(0.2)), 9).alias("gamma"))


@query(
    f"""WITH {T.FRAGMENTS} SELECT event_id, tlen <> 0 AND tlen - 8 >= 0 AND abs(tlen) BETWEEN 127 AND 187 AS plain, tlen > 0 AND tlen - 8 > 0 AND abs(tlen - 8) BETWEEN 127 AND 187 AS strict FROM fragments"""
)
def fragment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments under the decoder's rule and the fits' stricter one, with an offset of 4."""
    rules = {k: scalar.valid_fragment(F.col("tlen"), 127, 187, 4, strict=k == "strict") for k in ("plain", "strict")}
    return T.fragments(spark, sf_dir).select("event_id", *(c.alias(k) for k, c in rules.items()))


@query(
    f"""WITH {T.FRAGMENTS}, {T.CALLS}, d AS (SELECT DISTINCT chr, dyad FROM calls WHERE dyad - 88 > 0), l AS (SELECT chr, dyad - 88 AS start FROM d UNION SELECT chr, dyad + 73 FROM d),
    m AS (SELECT chr, CAST(floor((ref_start + 5 + ref_start + 4 + tlen - 8) / 2) AS BIGINT) AS pos, count(*) AS n FROM fragments WHERE tlen > 8 AND tlen - 8 BETWEEN 0 AND 80 GROUP BY ALL)
    SELECT rel, value, count(*) AS n FROM (SELECT k - 7 AS rel, coalesce(m.n, 0) AS value FROM l CROSS JOIN range(15) r(k) LEFT JOIN m ON m.chr = l.chr AND m.pos = start + 1 + k) GROUP BY ALL"""
)
def linker_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short fragments beside nucleosomes under the fits' rule, with an offset of 4."""
    dyads = T.calls(spark, sf_dir, 0).unionByName(T.calls(spark, sf_dir, 1)).unionByName(T.calls(spark, sf_dir, 2)).select("chr", "dyad").distinct()
    short = signal.midpoints(T.fragments(spark, sf_dir), offset=4, strict=True).where("cls = 'short'")
    return signal.site_count_histogram(api.linker_sites(dyads), short, 7)


Z = "1.959963984540054"


@query(
    f"""WITH v AS (SELECT l_returnflag AS kind, l_linestatus AS status, avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS e, count(*) - 1 AS df, CAST({Z} AS DOUBLE) AS z FROM lineitem GROUP BY ALL),
    q AS (SELECT *, e * (z + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / df**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / df**3
      + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / df**4) AS half FROM v)
    SELECT kind, status, round(mean, 4) AS mean, round(mean - half, 4) AS low, round(mean + half, 4) AS high FROM q"""
)
def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("double").alias("v"))
    return diff.confidence(rows, "v", ["kind", "status"]).select("kind", "status", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query(
    f"""WITH s AS (SELECT translate(substr({" || ".join(f"md5(p_name || '{i}')" for i in range(5))}, 1, 147), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part),
    c AS (SELECT pos, substr(seq, pos, 1) AS cur, substr(seq, pos + 1, 1) AS nxt, count(*) AS n FROM s, unnest(range(10, 137)) t(pos) GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY pos, cur) AS p FROM c),
    e AS (SELECT i AS a, i + 1 AS b, 1.0::DOUBLE AS prob FROM (SELECT unnest(range(1, 9)) UNION ALL SELECT unnest(range(522, 531))) t(i)
      UNION ALL SELECT 518 + i, 522, 1.0 FROM range(4) t(i)
      UNION ALL SELECT 9, 10 + i, (SELECT count(*) FROM s WHERE substr(seq, 10, 1) = substr('ACGT', i + 1, 1)) / (SELECT count(*) FROM s) FROM range(4) t(i)
      UNION ALL SELECT 10 + 4 * g + i, 14 + 4 * g + j, coalesce(p, 0) FROM range(127) x(g), range(4) y(i), range(4) z(j)
        LEFT JOIN p ON pos = g + 10 AND cur = substr('ACGT', i + 1, 1) AND nxt = substr('ACGT', j + 1, 1))
    SELECT CAST(a AS INTEGER) AS "from", CAST(b AS INTEGER) AS "to", round(prob, 6) AS prob FROM e"""
)
def dinucleotide_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nucleosome fitted to 147 bases for each part, written as text, read into a model, written and read again."""
    letters = F.concat(*(F.md5(F.concat("p_name", F.lit(str(i)))) for i in range(5)))
    names = T.table(spark, sf_dir, "part").select("p_name").repartition(spark.sparkContext.defaultParallelism)  # a file may be one task
    pieces = names.select(F.translate(F.substring(letters, 1, 147), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    blank = hmm.Model({}, [0.25] * 4, {"background": 0.9, "nucleosome": 0.1})
    one, two = _path(spark, "dinucleotides"), _path(spark, "dinucleotides")
    sinks.dinucleotides(spark, api.fit_nucleosome(pieces, blank), one)
    sinks.dinucleotides(spark, readers.dinucleotide_model(spark, one, blank), two)
    return readers.dinucleotides(spark, two).withColumn("prob", F.round("prob", 6))


@query(signals.SQL["length_position_counts"])
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the second call, which reads what the first one kept."""

    def counted() -> DataFrame:
        return signal.length_position_counts(T.fragments(spark, sf_dir), 10, 250)

    for _ in range(2):
        found = kept("length-position", counted, spark, [f"{sf_dir}/events.parquet"], {"low": 10, "high": 250})
    return found
