"""Sequences in pieces: FASTA records read by byte ranges through their index, and joined to segments piece by piece.

A record's index says where its first base is, and how many bases and bytes a line has, so base b (from 0) is at byte
offset + b // linebases * linewidth + b % linebases. No record is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import base_codes
from ..storage import materialize
from .bam import open_file

WIDTH = 1 << 14  # bases of a piece
SPLIT_BYTES = 32 << 20
STRETCH = 1 << 20  # bases that a task reads at once
CHUNKS = "chr string, chunk long, seq string"


def index_fasta(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(chr, length, offset, linebases, linewidth) of a FASTA file, found by many tasks: what a ``.fai`` file holds.

    Every task looks through a range of bytes for headers; where a task's last record ends is told by the next header, of
    which the driver sees one offset for each range. Lines of a record other than its last have to be of one length.
    """
    with open_file(path) as file:
        size = file.size()
        ends = size == 0 or file.read_at(1, size - 1) == b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.column(0).to_pylist():
                start, end = split * split_bytes, min(size, (split + 1) * split_bytes)
                rows = []
                with open_file(path) as file:
                    data = (b"\n" if start == 0 else file.read_at(1, start - 1)) + file.read_at(end - start, start)
                    at = data.find(b"\n>")
                    while at >= 0:
                        offset, line = start + at, b""
                        while b"\n" not in line and offset + len(line) < size:
                            line += file.read_at(min(1 << 12, size - offset - len(line)), offset + len(line))
                        name = line.split(b"\n", 1)[0]
                        first, text = offset + len(name) + 1, b""
                        while b"\n" not in text and first + len(text) < size:
                            text += file.read_at(min(1 << 12, size - first - len(text)), first + len(text))
                        bases = text.split(b"\n", 1)[0]
                        words = name[1:].split()
                        rows.append((split, offset, words[0].decode() if words else "", first, 0 if bases[:1] == b">" else len(bases.rstrip(b"\r")), len(bases) + 1))
                        at = data.find(b"\n>", at + 1)
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays(cols, ["split", "at", "chr", "offset", "linebases", "linewidth"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    n = max(1, -(-size // split_bytes))
    found = spark.range(n, numPartitions=n).mapInArrow(run, "split long, at long, chr string, offset long, linebases int, linewidth int")
    found = materialize(found, "headers")
    first = {r["split"]: r["at"] for r in found.groupBy("split").agg(F.min("at").alias("at")).collect()}
    after, later = [], size
    for split in range(n - 1, -1, -1):
        after.append((split, later))
        later = first.get(split, later)
    inside = F.lead("at").over(Window.partitionBy("split").orderBy("at"))
    found = found.withColumn("_next", inside).join(spark.createDataFrame(after, "split long, _after long"), "split")
    end = F.coalesce("_next", "_after")
    # Bytes of whole lines and of the last one; the file's last line may lack its line feed.
    total = end - F.col("offset") + F.when((end == size) & F.lit(not ends), F.col("linewidth") - F.col("linebases")).otherwise(0)
    length = F.floor(total / F.col("linewidth")) * F.col("linebases") + F.greatest(F.lit(0), F.pmod(total, F.col("linewidth").cast("long")) - (F.col("linewidth") - F.col("linebases")))
    return found.select("chr", F.when(F.col("linebases") > 0, length).otherwise(0).cast("long").alias("length"), "offset", "linebases", "linewidth")


def chunks(spark: SparkSession, path: str, index: DataFrame, width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """(chr, chunk, seq): pieces of ``width`` bases, numbered from 0, of the records of an index (as ``readers.fasta_index``
    gives it). A task reads the bytes of its stretches only; lines of uneven length raise."""
    whole = stretch // width * width or width
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(whole).cast("long"))
    asked = index.where("length > 0").select("*", F.explode(starts).alias("start"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.repartition(n, "chr", "start").select("chr", "start", F.least(F.col("start") + whole, "length").alias("end"), "offset", "linebases", "linewidth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(path) as file:
            for batch in batches:
                for r in batch.to_pylist():
                    byte = lambda b, r=r: r["offset"] + b // r["linebases"] * r["linewidth"] + b % r["linebases"]
                    a, b = byte(r["start"]), byte(r["end"] - 1) + 1
                    lines = file.read_at(b - a, a).replace(b"\r", b"").split(b"\n")
                    data, before = b"".join(lines), r["start"] % r["linebases"]
                    even = all(len(x) == r["linebases"] for x in lines[1:-1]) and (len(lines) == 1 or len(lines[0]) + before == r["linebases"])
                    if len(data) != r["end"] - r["start"] or not even or b">" in data:
                        raise ValueError(f"lines of {r['chr']} are of uneven length, or its index is another file's")
                    seqs = [data[i : i + width].decode() for i in range(0, len(data), width)]
                    first = r["start"] // width
                    cols = [pa.array([r["chr"]] * len(seqs)), pa.array(range(first, first + len(seqs)), pa.int64()), pa.array(seqs)]
                    yield pa.RecordBatch.from_arrays(cols, ["chr", "chunk", "seq"])

    return asked.mapInArrow(run, CHUNKS)


def chunks_of(records: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chr, seq) of whole records -> (chr, chunk, seq), for stores that only Spark opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seq = seq.as_py() or ""
                for i in range(0, max(1, len(seq)), STRETCH // width * width):
                    seqs = [seq[k : k + width] for k in range(i, min(max(1, len(seq)), i + STRETCH // width * width), width)]
                    cols = [pa.array([name] * len(seqs), pa.string()), pa.array(range(i // width, i // width + len(seqs)), pa.int64()), pa.array(seqs, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["chr", "chunk", "seq"])

    return records.select("chr", "seq").mapInArrow(run, CHUNKS)


def with_sequence(segs: DataFrame, pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds seq and codes to segments (chr, start, end, ...) from ``chunks``; raises where a segment leaves its record.

    A segment meets only the pieces it touches, so a long chromosome is spread over all tasks. Segments of unknown
    chromosomes go. Rows that repeat are all returned.
    """
    places = segs.select("chr", "start", "end").where("chr is not null and start <= end").distinct()
    known = pieces.where("chunk = 0").select("chr").distinct()
    first, last = (F.greatest(F.lit(0), F.floor((F.col(c) - 1) / width)) for c in ("start", "end"))
    touched = places.join(known, "chr", "left_semi").withColumn("chunk", F.explode(F.sequence(first, last)))
    at = F.col("chunk") * width
    a, b = F.greatest("start", at + 1), F.least("end", at + width)
    piece = F.substring(F.coalesce("seq", F.lit("")), (a - at).cast("int"), F.greatest(F.lit(0), b - a + 1).cast("int"))
    met = touched.join(pieces, ["chr", "chunk"], "left").select("chr", "start", "end", F.struct("chunk", piece.alias("piece")).alias("p"))
    whole = met.groupBy("chr", "start", "end").agg(F.array_join(F.sort_array(F.collect_list("p"))["piece"], "").alias("seq"))
    inside = (F.col("start") > 0) & (F.length("seq") == F.col("end") - F.col("start") + 1)
    whole = whole.withColumn("seq", F.when(inside, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("segment outside of "), F.col("chr"))).cast("string")))
    return segs.join(whole, ["chr", "start", "end"]).select(*segs.columns, "seq").withColumn("codes", base_codes(F.col("seq")))
