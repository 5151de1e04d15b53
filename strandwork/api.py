"""Entry points: fit a model, decode segments, call nucleosomes and sites, look at a region."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, parse
from .constants import DINUCLEOTIDE_SAMPLE, EM_ROUNDS, EM_SEED, EM_SEGMENTS, HALF_NUCLEOSOME, LINKER, NB_EXCLUDED_CHR, NB_FALLBACK, NUCLEOSOME, SITE_REACH
from .functions import scalar
from .operators import calls, diff, fit, hmm, intervals, occupancy, signal
from .sources import readers, sinks
from .storage import kept, materialize


def segment_table(segments: DataFrame, fragments: DataFrame, config: Config, sequence: DataFrame | None = None, tech: str = "MNase") -> DataFrame:
    """Segments with codes (if there is a sequence) and a count array for each class, named class_tech."""
    mids = signal.midpoints(fragments, config.long, config.short, config.offset)
    rows = signal.dense_counts(segments, signal.segment_counts(segments, mids))
    rows = rows.withColumnsRenamed({"long": f"long_{tech}", "short": f"short_{tech}"})
    return rows if sequence is None else rows.join(readers.with_sequence(segments, sequence).select("segment_id", "codes"), "segment_id")


def _one(histogram: DataFrame) -> tuple[float, float]:
    row = fit.fit_nb(histogram.withColumn("all", F.lit(1)), ["all"]).first()
    return (row["mu"], row["size"]) if row else NB_FALLBACK


def linker_sites(dyads: DataFrame) -> DataFrame:
    """(site_id, chr, centre) of linkers: a stretch [start, end) holds midpoints counted from 0, one less than ``midpoints`` counts."""
    beside = intervals.linkers(dyads).withColumn("centre", F.col("start") + 1 + LINKER // 2)
    return beside.select("chr", "centre").distinct().withColumn("site_id", F.xxhash64("chr", "centre"))


def fit_counts(fragments: DataFrame, dyads: DataFrame, sites: DataFrame, config: Config) -> dict[str, hmm.Counts]:
    """Count distributions of the two classes: nucleosomes by offset with one mean size, sites for short ones, linkers else.
    Fragments count by the fits' own, strict rule."""
    mids = signal.midpoints(fragments, config.long, config.short, config.offset, strict=True)
    short, long = mids.where("cls = 'short'"), mids.where("cls = 'long'")
    places = dyads.where(F.col("chr") != NB_EXCLUDED_CHR).select("chr", F.col("dyad").alias("centre"))
    places = places.withColumn("site_id", F.xxhash64("chr", "centre")).distinct()
    by = {r["rel"]: (r["mu"], r["size"]) for r in fit.fit_nb(signal.site_count_histogram(places, long, HALF_NUCLEOSOME), ["rel"]).collect()}
    values = [by.get(i - HALF_NUCLEOSOME, NB_FALLBACK) for i in range(NUCLEOSOME)]
    phi = sum(v[1] for v in values) / NUCLEOSOME
    motif = sites.select("chr", "centre").distinct().withColumn("site_id", F.xxhash64("chr", "centre"))
    motif_short = _one(signal.site_count_histogram(motif, short, SITE_REACH).groupBy("value").agg(F.sum("n").alias("n")))
    beside = linker_sites(dyads.where(~F.col("chr").contains("micron")))
    other = {k: _one(signal.site_count_histogram(beside, m, LINKER // 2).groupBy("value").agg(F.sum("n").alias("n"))) for k, m in (("short", short), ("long", long))}
    return {
        f"long_{config.tech}": hmm.Counts(other["long"], other["long"], (tuple(v[0] for v in values), phi)),
        f"short_{config.tech}": hmm.Counts(other["short"], motif_short, ((other["short"][0],) * NUCLEOSOME, other["short"][1])),
    }


def fit_sequence(sequence: DataFrame, dyads: DataFrame, motifs: dict[str, list[list[float]]]) -> hmm.Model:
    """A model of bases: background composition, motifs and an unknown one, and the nucleosome's dinucleotides."""
    share = {r["base"]: r["share"] for r in fit.base_composition(sequence).collect()}
    background = [share[b] for b in "ACGT"]
    motifs = dict(motifs) | {"unknown": hmm.unknown_motif(background)}
    places = dyads.select("chr", "dyad").distinct().withColumn("k", F.concat_ws(":", "chr", "dyad"))
    some = fit.drawn(places, "k", DINUCLEOTIDE_SAMPLE, EM_SEED).withColumn("_i", F.explode(F.sequence(F.lit(1), "draws")))
    start = F.col("dyad") - HALF_NUCLEOSOME
    there = some.join(sequence, "chr").where((start > 0) & (F.col("dyad") + HALF_NUCLEOSOME <= F.length("seq")))
    pieces = fit.eligible(there.select(F.substring("seq", start.cast("int"), F.lit(NUCLEOSOME)).alias("seq")))
    base_model = hmm.Model(motifs, background, hmm.initial_weights(motifs, background))
    return fit_nucleosome(pieces, base_model)


def fit_nucleosome(pieces: DataFrame, model: hmm.Model) -> hmm.Model:
    """``model`` with the base composition and dinucleotides of sequences (seq) of 147 bases; as it is if there are none."""
    bases = {(r["pos"], r["base"]): r["share"] for r in fit.position_composition(pieces).collect()}
    steps = {(r["pos"], r["cur"], r["nxt"]): r["p"] for r in fit.dinucleotide_transition(pieces).collect()}
    if not bases:
        return model
    ends = [[bases.get((p, b), 0.0) for b in "ACGT"] for p in (*range(1, hmm.HEAD + 1), *range(NUCLEOSOME - hmm.TAIL + 1, NUCLEOSOME + 1))]
    first = [bases.get((hmm.HEAD + 1, b), 0.0) for b in "ACGT"]
    middle = range(hmm.HEAD + 1, hmm.HEAD + hmm.MIDDLE)
    rows = [[[steps.get((p, a, b), 0.0) for b in "ACGT"] for a in "ACGT"] for p in middle]
    return replace(model, first=first, transitions=rows, ends=ends)


def train(
    segments: DataFrame, model: hmm.Model, counts: dict[str, hmm.Counts], rounds: int = EM_ROUNDS, most: int | None = EM_SEGMENTS, path: str | None = None
) -> tuple[hmm.Model, list[float]]:
    """Learns the weights on at most ``most`` segments (500, in an order by hash; None: all of them). Several assays are
    several entries of counts. Rounds are kept under ``path``, see ``hmm.train``."""
    some = segments if most is None else fit.sampled(segments, "segment_id", most, EM_SEED)
    return hmm.train(some, replace(model, counts=counts, use_sequence=model.use_sequence and "codes" in segments.columns), rounds, path=path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    return readers.bam(spark, path) if path.endswith(".bam") else spark.read.parquet(path)


def _signals(spark: SparkSession, segments: DataFrame, configs: list[Config]) -> DataFrame:
    """Segments with codes and the counts of each config's fragments; a config without fragments adds none."""
    rows = readers.with_sequence(segments, readers.sequence(spark, configs[0].fasta)).drop("seq")
    for c in configs:
        if c.fragments:
            found = segment_table(segments, _fragments(spark, c.fragments), c, tech=c.tech)
            rows = rows.join(found.select("segment_id", f"long_{c.tech}", f"short_{c.tech}"), "segment_id")
    return rows


def run_training(spark: SparkSession, config: str | list[str], segments: str, out: str, rounds: int = EM_ROUNDS) -> tuple[hmm.Model, list[float]]:
    """From INI files (one for each assay, sequence from the first) and a table of segments to a trained model under ``out``.

    Keeps the settings, each round and the model there; run again, it goes on after the last finished round. Without
    fragments in any config, the model is of the sequence alone. Fragments are BAM, or Parquet of (chr, ref_start, tlen).
    """
    texts = [spark.read.text(p, wholetext=True).first()[0] for p in ([config] if isinstance(config, str) else config)]
    configs = [parse(t) for t in texts]
    if len({c.tech for c in configs}) < len(configs):
        raise ValueError("each assay's config needs its own tech")
    spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1).write.mode("overwrite").parquet(f"{out}/settings")
    first = configs[0]
    dyads, sites = readers.dyads(spark, first.dyads), readers.sites(spark, first.sites)
    model = fit_sequence(readers.fasta(spark, first.fasta), dyads, readers.motifs(spark, first.motifs))
    counts: dict[str, hmm.Counts] = {}
    for c in configs:
        if c.fragments:
            counts |= fit_counts(_fragments(spark, c.fragments), dyads, sites, c)
    rows = _signals(spark, readers.segments(spark, segments), configs)
    model, history = train(rows, model, counts, rounds, path=f"{out}/rounds")
    model.save(spark, f"{out}/model")
    return model, history


def run_decoding(spark: SparkSession, trained: str, segments: str, out: str) -> DataFrame:
    """The sparse posterior of a table of segments under the model and settings that ``run_training`` left in ``trained``;
    posterior and log likelihoods are kept under ``out``."""
    configs = [parse(r["text"]) for r in spark.read.parquet(f"{trained}/settings").orderBy("i").collect()]
    model = hmm.Model.load(spark, f"{trained}/model")
    rows = materialize(_signals(spark, readers.segments(spark, segments), configs), "signals")
    found = materialize(hmm.decode_scored(rows, model), "decoded")
    found.where("state is null").select("segment_id", "log_likelihood").write.mode("overwrite").parquet(f"{out}/likelihoods")
    sinks.posterior(found.where("state is not null").drop("log_likelihood"), f"{out}/posterior")
    return spark.read.parquet(f"{out}/posterior")


def background_track(posterior: DataFrame, segments: DataFrame, model: hmm.Model) -> DataFrame:
    """(chr, pos, prob): the chance that a base is background, averaged over the segments that cover it."""
    return stitched(posterior, segments, factors(segments.sparkSession, model)).where("dbf = 'background'").select("chr", "pos", "prob")


def decode(segments: DataFrame, model: hmm.Model, path: str) -> DataFrame:
    """Writes the sparse posterior of all segments under ``path`` and reads it again."""
    sinks.posterior(hmm.decode(segments, model), path)
    return segments.sparkSession.read.parquet(path)


def factors(spark: SparkSession, model: hmm.Model) -> DataFrame:
    return spark.createDataFrame(model.factors(), "state int, dbf string")


def stitched(posterior: DataFrame, segments: DataFrame, states: DataFrame) -> DataFrame:
    """(chr, pos, dbf, prob): sums by factor, averaged over the segments that cover a base (those without a row count 0)."""
    sums = occupancy.by_factor(posterior, states).withColumnRenamed("prob", "total")
    covers = intervals.coverage(segments.select("chr", "start", "end"))
    met = intervals.point_join(sums, covers)
    return met.select("chr", "pos", "dbf", F.least(F.col("total") / F.col("depth"), F.lit(1.0)).alias("prob"))


def call_nucleosomes(posterior: DataFrame, segments: DataFrame, model: hmm.Model) -> DataFrame:
    """(chr, dyad, dyad_score, avg_occ_score, min_occ_score) of all nucleosomes."""
    tracks = occupancy.wide(stitched(posterior, segments, factors(segments.sparkSession, model)), ["nuc_center", "nucleosome"])
    extents = intervals.island_extents(segments.select("chr", "start", "end")).select("chr", F.col("start").alias("first"), F.col("end").alias("last"))
    rows = intervals.point_join(tracks, extents, ends=("first", "last"))
    return calls.dyads(rows.withColumnsRenamed({"nuc_center": "dyad_score", "nucleosome": "occ_score"}))


def call_sites(posterior: DataFrame, segments: DataFrame, model: hmm.Model) -> DataFrame:
    """(tf, chr, start, end, width, score) of all factors; a factor's motif variants compete at each base."""
    rows = [(a, name, name.split("_")[0].upper(), len(model.motifs[name])) for name, pair in model.starts().items() for a in pair]
    starts = segments.sparkSession.createDataFrame(rows, "state int, variant string, tf string, width int")
    names = starts.select("state", F.col("variant").alias("dbf"))
    scores = stitched(posterior, segments, names).withColumnsRenamed({"dbf": "variant", "prob": "score"})
    best = occupancy.best_variant(scores.join(F.broadcast(starts.drop("state").distinct()), "variant"))
    extents = intervals.island_extents(segments.select("chr", "start", "end")).select("chr", F.col("start").alias("first"), F.col("end").alias("last"))
    return calls.sites(intervals.point_join(best, extents, ends=("first", "last")))


def region(posterior: DataFrame, segments: DataFrame, model: hmm.Model, chrom: str, start: int, end: int) -> DataFrame:
    """Occupancy (chr, pos, dbf, prob) of a region; raises if a base of it has no segment."""
    spark = segments.sparkSession
    wanted = spark.createDataFrame([(chrom, start, end)], "chr string, r_start long, r_end long")
    here = segments.where((F.col("chr") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
    if not intervals.uncovered(wanted, here).isEmpty():
        raise ValueError(f"{chrom}:{start}-{end} is not covered by segments")
    part = posterior.where((F.col("chr") == chrom) & F.col("pos").between(start, end))
    return stitched(part, here, factors(spark, model))



def compare_region(samples: list[tuple[DataFrame, DataFrame, hmm.Model]], linked: DataFrame, sites: DataFrame, chrom: str, start: int, end: int) -> dict[str, DataFrame]:
    """What a view of a region shows of ordered samples (posterior, segments, model): ``tracks`` (sample, chr, pos, dbf, prob),
    ``nucleosomes`` and ``sites``, see ``diff.region_nucleosomes`` and ``diff.region_sites``."""
    spark, names = linked.sparkSession, [scalar.sample_suffix(i) for i in range(len(samples))]
    wanted = spark.createDataFrame([(chrom, start, end)], "chr string, r_start long, r_end long")
    tracks = [region(*s, chrom, start, end).select(F.lit(name).alias("sample"), "*") for name, s in zip(names, samples, strict=True)]
    return {
        "tracks": occupancy.union_all(tracks),
        "nucleosomes": diff.region_nucleosomes(linked, len(samples), wanted),
        "sites": diff.region_sites(sites, len(samples), wanted),
    }


def count_store(spark: SparkSession, paths: list[str], low: int, high: int, offset: int = 0, root: str | None = None) -> DataFrame:
    """(chr, len, pos, n) of fragments of BAM files (or folders of them), counted once for a version of the files and a width."""
    return kept(
        "length-position",
        lambda: signal.length_position_counts(readers.bam(spark, paths), low, high, offset),
        spark,
        paths,
        {"low": low, "high": high, "offset": offset},
        root,
    )
