"""Readers of genomic files as DataFrames with fixed schemas; every path may be one that only Spark can open."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BED3, BED6, CHROM_SIZES, FASTA_INDEX, GENES, GTF, SEGMENTS, SITE_SCORES, TSS
from ..operators.hmm import Model
from .bam import MAGIC, SCHEMA, SPLIT_BYTES, BamSource, block_length, open_file
from .sequence import chunks, chunks_of, index_fasta
from .sequence import with_sequence as joined_sequence


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t", comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated chr, start, end with a header; ``segment_id`` is a hash of the place."""
    rows = _tsv(spark, path, SEGMENTS, header=True)
    return rows.withColumn("segment_id", F.xxhash64("chr", "start", "end"))


def dyads(spark: SparkSession, path: str) -> DataFrame:
    """BED3 -> (chr, start, end, dyad)."""
    return _tsv(spark, path, BED3).withColumn("dyad", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))


def sites(spark: SparkSession, path: str) -> DataFrame:
    """BED with up to six columns -> (chr, start, end, name, score, strand, centre)."""
    return _tsv(spark, path, BED6).withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))


def chrom_sizes(spark: SparkSession, path: str, without: tuple[str, ...] = ("chrM",)) -> DataFrame:
    """White-space separated name and size."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(part[0].alias("chr"), part[1].cast("long").alias("size"))
    return rows.where(~F.col("chr").isin(*without)).to(spark.createDataFrame([], CHROM_SIZES).schema)


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, FASTA_INDEX)


def tss(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, TSS, header=True).na.drop()


def genes(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated genes with first nucleosomes, columns renamed to ``constants.GENES``; ``row`` is the file's order."""
    names = {
        "Chr": "chr", "ORF": "orf", "Strand": "strand", "+1 nucleosome": "plus1", "-1 nucleosome": "minus1", "TSS": "tss", "TTS": "tts", "ORF Start": "orf_start", "ORF End": "orf_end",
    }
    rows = spark.read.option("header", True).csv(path).withColumnsRenamed(names)
    kinds = dict(x.split() for x in GENES.split(", "))
    whole = [F.col(c).cast("double").cast(t).alias(c) if t in ("int", "long") else F.col(c) for c, t in kinds.items()]
    return rows.select(*whole, F.monotonically_increasing_id().alias("row"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, GTF, comment="#")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq): one row for each record of each file. A record is one string, so a chromosome has to fit a row."""
    files = spark.read.text(path, wholetext=True)
    record = F.explode(F.filter(F.split("value", r"(?:^|\n)>"), lambda r: F.trim(r) != "")).alias("r")
    rows = files.select(record).select(F.split(F.col("r"), r"\r?\n", 2).alias("p"))
    return rows.select(F.split(F.trim(F.col("p")[0]), r"\s+")[0].alias("chr"), F.regexp_replace(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), r"\s", "").alias("seq"))


def fasta_sizes(records: DataFrame) -> DataFrame:
    """(chr, size) of sequences (chr, seq)."""
    return records.select("chr", F.length("seq").cast("long").alias("size"))


def site_scores(spark: SparkSession, path: str) -> DataFrame:
    """(tf, chr, start, end, width, score) as ``sinks.site_scores`` writes them; one factor or chromosome reads its folder only."""
    return spark.read.schema(SITE_SCORES).parquet(path)


def sequence(spark: SparkSession, path: str) -> DataFrame:
    """(chr, chunk, seq) of a FASTA file, in pieces read by byte ranges: by the ``.fai`` beside it, or by an index that is made
    now. A file that only Spark can open, or a folder, is read record by record."""
    try:
        with open_file(path):
            pass
    except (OSError, pa.ArrowInvalid):
        return chunks_of(fasta(spark, path))
    try:
        with open_file(f"{path}.fai"):
            index = fasta_index(spark, f"{path}.fai")
    except OSError:
        index = index_fasta(spark, path)
    return chunks(spark, path, index)


def with_sequence(segs: DataFrame, records: DataFrame) -> DataFrame:
    """Adds seq and codes to segments, from ``sequence`` or from whole records (chr, seq); raises where a segment leaves its
    record. Segments of unknown chromosomes go."""
    return joined_sequence(segs, records if "chunk" in records.columns else chunks_of(records))


def motifs(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    """Motifs of a MEME file (a small text): name -> rows of four probabilities."""
    found: dict[str, list[list[float]]] = {}
    name = None
    for row in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n")).alias("line")).toLocalIterator():
        line = row["line"].strip()
        if not line or line.startswith("URL "):
            continue
        if line.startswith("MOTIF"):
            name = line.split()[1]
            found[name] = []
        elif name and not line.startswith("letter"):
            found[name].append([float(x) for x in line.split()[:4]])
    return found


def dinucleotides(spark: SparkSession, path: str) -> DataFrame:
    """(from, to, prob) edges, 1-based; lines that begin with # don't count."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    return rows.select(part[0].cast("int").alias("from"), part[1].cast("int").alias("to"), part[2].cast("double").alias("prob"))


def dinucleotide_model(spark: SparkSession, path: str, model: Model) -> Model:
    """``model`` with the nucleosome's steps from a file of edges."""
    return model.with_edges([tuple(r) for r in dinucleotides(spark, path).collect()])


def bam(spark: SparkSession, path: str | list[str], samples: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Fragments (chr, ref_start, tlen, sample) of BAM files or folders of them, stacked; unplaced reads are left out.

    Files are read in pieces of ``split_bytes``, cut at blocks. Filters on chr, ref_start and sample reach the source: with a
    ``.bai`` beside a file, only blocks that its index names are opened. ``samples`` names each path's sample (by default a
    file's name). Files that aren't in blocks, or that only Spark can open, are inflated whole, a task for each.
    """
    found = []
    for i, p in enumerate([path] if isinstance(path, str) else path):
        try:
            fs, at = pafs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (pafs.LocalFileSystem(), p)
        except pa.ArrowInvalid:
            return _bam_whole(spark, path, samples)
        info = fs.get_file_info(at)
        inside = [p]
        if info.type == pafs.FileType.Directory:
            names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(at)))
            inside = [f"{p.rstrip('/')}/{n}" for n in names if n.endswith(".bam") and n[0] not in "._"]
        found += [(x, samples[i] if samples else x.rsplit("/", 1)[-1].removesuffix(".bam")) for x in inside]
    for x, _ in found:
        with open_file(x) as file:
            if block_length(file.read_at(min(64, file.size()), 0)) is None:
                return _bam_whole(spark, path, samples)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    options = {"paths": json.dumps([x for x, _ in found]), "samples": json.dumps([s for _, s in found]), "split_bytes": str(split_bytes)}
    return spark.read.format(BamSource.name()).options(**options).load()


def _bam_whole(spark: SparkSession, path: str | list[str], samples: list[str] | None) -> DataFrame:
    """As ``bam``, a row for each file, which has to be smaller than 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, sample in zip(batch.column(0), batch.column(1), strict=True):
                data = gzip.decompress(content.as_py())
                if data[:4] != MAGIC:
                    raise ValueError("not a BAM file")
                at = 8 + struct.unpack_from("<i", data, 4)[0]
                n_refs, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
                for _ in range(n_refs):
                    size = struct.unpack_from("<i", data, at)[0]
                    names.append(data[at + 4 : at + 3 + size].decode())
                    at += 8 + size
                rows: list[tuple] = []
                while at < len(data):
                    size, ref, pos = struct.unpack_from("<iii", data, at)
                    if ref >= 0:
                        rows.append((names[ref], pos, struct.unpack_from("<i", data, at + 32)[0]))
                    at += 4 + size
                    if len(rows) == 100_000 or at >= len(data) and rows:
                        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([sample.as_py()] * len(rows))], ["chr", "ref_start", "tlen", "sample"])
                        rows = []

    def read(p: str, name: str | None) -> DataFrame:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(p)
        of = F.lit(name) if name else F.regexp_extract("path", r"([^/]*?)(?:\.bam)?$", 1)
        return rows.select("content", of.alias("sample")).mapInArrow(run, SCHEMA)

    paths = [path] if isinstance(path, str) else path
    return reduce(DataFrame.unionByName, (read(p, samples[i] if samples else None) for i, p in enumerate(paths)))
