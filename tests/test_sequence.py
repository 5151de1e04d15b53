"""FASTA by byte ranges: the index, pieces, and segments, against plain slices."""

import random

import pytest
from pyspark.sql import functions as F
from strandwork.sources import readers, sequence


def written(path, records, width, feed="\n", last=True):
    text = "".join(f">{n} of a test{feed}" + feed.join(s[i : i + width] for i in range(0, len(s), width)) + feed for n, s in records)
    path.write_bytes((text if last else text[: -len(feed)]).encode())
    return str(path)


def made(seed, n=6):
    r = random.Random(seed)
    return [(f"c{i}", "".join(r.choices("ACGTNacgt", k=r.choice([1, 59, 60, 61, 500, 4000])))) for i in range(n)]


@pytest.mark.parametrize(("feed", "last", "split"), [("\n", True, 500), ("\n", False, 64), ("\r\n", True, 10_000)])
def test_index_and_pieces(spark, tmp_path, feed, last, split):
    records = made(1)
    path = written(tmp_path / "a.fa", records, 60, feed, last)
    index = sequence.index_fasta(spark, path, split)
    assert {r["chr"]: r["length"] for r in index.collect()} == {n: len(s) for n, s in records}
    pieces = sequence.chunks(spark, path, index, width=100, stretch=250).collect()
    got = {n: "".join(r["seq"] for r in sorted((p for p in pieces if p["chr"] == n), key=lambda p: p["chunk"])) for n, _ in records}
    assert got == dict(records) and max(len(p["seq"]) for p in pieces) == 100


def test_segments_are_slices(spark, tmp_path):
    records, r = made(2), random.Random(5)
    path = written(tmp_path / "a.fa", records, 70)
    rows = [("c0", 1, 1, 0), ("x", 1, 5, 1)]
    for i in range(300):
        n, s = r.choice(records)
        a = r.randint(1, len(s))
        rows.append((n, a, r.randint(a, min(len(s), a + 700)), i))
    rows.append(rows[-1])
    segs = spark.createDataFrame(rows, "chr string, start long, end long, id long")
    seq = dict(records)
    want = sorted((*x, seq[x[0]][x[1] - 1 : x[2]]) for x in rows if x[0] in seq)
    for pieces, width in ((sequence.chunks(spark, path, sequence.index_fasta(spark, path), width=64), 64), (readers.sequence(spark, path), sequence.WIDTH)):
        got = sequence.with_sequence(segs, pieces, width)
        assert sorted(tuple(r)[:5] for r in got.collect()) == want
    for bad in (("c0", 0, 1, 0), ("c0", 1, 10**6, 0), ("c0", 10**7, 10**7 + 5, 0)):
        with pytest.raises(Exception, match="segment outside of c0"):
            readers.with_sequence(spark.createDataFrame([bad], segs.schema), readers.sequence(spark, path)).collect()


def test_index_beside_the_file_and_uneven_lines(spark, tmp_path):
    path = written(tmp_path / "a.fa", [("c", "ACGT" * 50)], 50)
    (tmp_path / "a.fa.fai").write_text("c\t200\t13\t50\t51\n")
    assert readers.sequence(spark, path).first()["seq"] == "ACGT" * 50
    (tmp_path / "b.fa").write_text(">c\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="uneven"):
        readers.sequence(spark, str(tmp_path / "b.fa")).collect()


def test_a_long_record_is_spread(spark, tmp_path):
    """20 million bases and 2000 segments: no task gets more than its part of them."""
    line = ("ACGTTGCAAC" * 8 + "\n") * 1000
    with open(tmp_path / "long.fa", "w") as f:
        f.write(">c\n" + line * 250)
    pieces = readers.sequence(spark, str(tmp_path / "long.fa"))
    per_task = [r["n"] for r in pieces.groupBy(F.spark_partition_id().alias("t")).agg(F.sum(F.length("seq")).alias("n")).collect()]
    assert sum(per_task) == 20_000_000 and max(per_task) <= 10_000_000
    segs = spark.range(2000).select(F.lit("c").alias("chr"), (F.col("id") * 10_000 - F.col("id") % 3 + 4).alias("start")).withColumn("end", F.col("start") + 499)
    one = "ACGTTGCAAC" * 60
    for r in readers.with_sequence(segs, pieces).collect():
        at = (r["start"] - 1) % 10
        assert r["seq"] == one[at : at + 500]
