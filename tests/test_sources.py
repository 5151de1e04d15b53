import gzip
import struct

import pytest
from strandwork import api
from strandwork.config import Config
from strandwork.sources import readers, sinks


def test_fasta_and_slices(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nNNac\n>c2\nGGG\n")
    records = readers.fasta(spark, str(tmp_path / "a.fa"))
    assert {(r["chr"], r["seq"]) for r in records.collect()} == {("c1", "ACGTNNac"), ("c2", "GGG")}
    segs = spark.createDataFrame([("c1", 3, 7)], "chr string, start long, end long")
    row = readers.with_sequence(segs, records).first()
    assert row["seq"] == "GTNNa" and row["codes"] == [2, 3, 4, 4, 0]
    outside = readers.with_sequence(spark.createDataFrame([("c2", 1, 4)], "chr string, start long, end long"), records)
    with pytest.raises(Exception, match="segment outside of c2"):
        outside.collect()


def test_motifs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("MEME version 4\n\nMOTIF X_1 x\nletter-probability matrix: w= 2\n 0.1 0.2 0.3 0.4\n1 0 0 0\nURL http://x\n\nMOTIF Y\nletter-probability\n0.25 0.25 0.25 0.25\n")
    assert readers.motifs(spark, str(tmp_path / "m.txt")) == {"X_1": [[0.1, 0.2, 0.3, 0.4], [1, 0, 0, 0]], "Y": [[0.25] * 4]}


def test_bam(spark, tmp_path):
    def record(ref, pos, tlen):
        body = struct.pack("<iiBBHHHiiii", ref, pos, 2, 30, 0, 0, 99, 0, ref, pos, tlen) + b"r\0"
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chrI\0" + struct.pack("<i", 1000)
    parts = [head + record(0, 10, 150), record(0, 159, -150) + record(-1, -1, 0)]
    (tmp_path / "x.bam").write_bytes(b"".join(map(gzip.compress, parts)))
    assert sorted(tuple(r) for r in readers.bam(spark, str(tmp_path / "x.bam")).collect()) == [("chrI", 10, 150, "x"), ("chrI", 159, -150, "x")]


def test_tables(spark, tmp_path):
    (tmp_path / "n.bed").write_text("chrI\t10\t11\nchrII\t5\t8\n")
    assert [r["dyad"] for r in readers.dyads(spark, str(tmp_path / "n.bed")).orderBy("chr").collect()] == [10, 6]
    (tmp_path / "s").write_text("chrI 230218\nchrM  85779\n")
    assert [tuple(r) for r in readers.chrom_sizes(spark, str(tmp_path / "s")).collect()] == [("chrI", 230218)]
    (tmp_path / "g.csv").write_text("Chr,ORF,Strand,+1 nucleosome,-1 nucleosome,TSS,TTS,ORF Start,ORF End\nchrI,YAL1W,1,130.0,,100,900,110,890\n")
    gene = readers.genes(spark, str(tmp_path / "g.csv")).first()
    assert (gene["plus1"], gene["minus1"], gene["tss"], gene["strand"]) == (130, None, 100, 1)
    (tmp_path / "d").write_text("# x\n1 2 0.5\n2 3 1\n")
    assert [tuple(r) for r in readers.dinucleotides(spark, str(tmp_path / "d")).orderBy("from").collect()] == [(1, 2, 0.5), (2, 3, 1.0)]


def test_posterior_sink_replaces_its_chromosomes(spark, tmp_path):
    schema, path = "chr string, pos long, state int, prob double", str(tmp_path / "p")
    sinks.posterior(spark.createDataFrame([("a", 1, 0, 0.5), ("b", 1, 0, 0.5), ("a", 2, 1, 1e-5)], schema), path)
    sinks.posterior(spark.createDataFrame([("a", 9, 0, 0.7)], schema), path)
    assert sorted((r["chr"], r["pos"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 1)]
    sinks.tsv(spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first()["v"] == "x,y"


def test_fit_of_a_planted_signal(spark):
    """Fragments around planted dyads give a hump of means in the middle."""
    heights = [9, 0, 1, 7, 0] * 4
    at = list(zip(range(1000, 9000, 400), heights, strict=True))
    fragments = [("chrI", d - 74, 147) for d, n in at for _ in range(n)] + [("chrI", d - 54, 147) for d, _ in at] + [("chrI", i * 17, 60) for i in range(500)]
    df = spark.createDataFrame(fragments, "chr string, ref_start int, tlen int")
    dyads = spark.createDataFrame([("chrI", d) for d in range(1000, 9000, 400)], "chr string, dyad long")
    sites = spark.createDataFrame([("chrI", d + 200) for d in range(1000, 9000, 400)], "chr string, centre long")
    counts = api.fit_counts(df, dyads, sites, Config())
    means = counts["long_MNase"].nucleosome[0]
    assert len(means) == 147 and max(range(147), key=means.__getitem__) == 73
    segs = spark.createDataFrame([(1, "chrI", 1, 2000)], "segment_id long, chr string, start long, end long")
    row = api.segment_table(segs, df, Config()).first()
    assert len(row["long_MNase"]) == 2000 and sum(row["long_MNase"]) == 10 + 3
