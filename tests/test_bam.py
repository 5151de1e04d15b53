"""The BAM source: splits, regions through the index, samples, against the rows that were written."""

import struct
import zlib

import numpy as np
import pytest
from strandwork.sources import bam, readers, sinks


def packed(data, size=3000):
    """BGZF blocks of ``size`` bytes of content, so that records lie across blocks."""
    out = b""
    for i in range(0, len(data), size):
        part = data[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bam.END_BLOCK


def record(ref, pos, tlen, r):
    name, length = f"read:{r.integers(1e6)}".encode() + b"\0", int(r.integers(0, 200))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 30, 0, 1, 99, length, ref, max(pos, 0), tlen) + name + struct.pack("<I", length << 4)
    body += r.bytes((length + 1) // 2) + r.bytes(length) + b"NMC\x01"
    return struct.pack("<i", len(body)) + body


def head(sizes):
    text = b"@HD\tVN:1.6\n" + b"@CO\t" + b"x" * 5000 + b"\n"
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sizes))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in sizes)


@pytest.fixture(scope="module")
def plain(tmp_path_factory):
    """A file of records of many lengths, without an index, and its rows."""
    r = np.random.default_rng(1)
    rows = sorted((int(r.integers(0, 3)), int(r.integers(0, 50_000)), int(r.integers(-300, 300))) for _ in range(4000))
    path = tmp_path_factory.mktemp("bam") / "one.bam"
    data = head([("c1", 1 << 20), ("c2", 1 << 20), ("c3", 1 << 20)]) + b"".join(record(*x, r) for x in rows) + record(-1, -1, 0, r)
    path.write_bytes(packed(data))
    return str(path), [(f"c{a + 1}", b, c, "one") for a, b, c in rows]


@pytest.mark.parametrize("split", [700, 5000, 40_000, 1 << 30])
def test_every_record_is_read_once_however_a_file_is_split(plain, split):
    path, rows = plain
    reader = bam.BamReader({"path": path, "split_bytes": str(split)})
    parts = reader.partitions()
    found = [tuple(x.values()) for p in parts for b in reader.read(p) for x in b.to_pylist()]
    assert found == rows and (len(parts) > 3 or split > 40_000)


def test_blocks_and_record_starts(plain):
    with bam.open_file(plain[0]) as file:
        blocks = bam.Blocks(file)
        borders, at = [0], 0
        while at < blocks.size:
            at = blocks.at(at)[1]
            borders.append(at)
        for offset in range(0, blocks.size, 997):
            assert blocks.border(offset) == min(b for b in borders if b >= offset)


def test_spark_reads_and_filters(spark, plain):
    path, rows = plain
    df = readers.bam(spark, path, split_bytes=20_000)
    assert sorted(map(tuple, df.collect())) == sorted(rows) and df.rdd.getNumPartitions() > 5
    got = df.where("chr = 'c2' and ref_start > 1000 and ref_start <= 2000").collect()
    assert sorted(map(tuple, got)) == sorted(x for x in rows if x[0] == "c2" and 1000 < x[1] <= 2000)


def test_written_files_and_regions(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(f"c{r.integers(1, 4)}", int(r.integers(0, 40_000_000)), int(r.integers(-200, 200))) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "chr string, ref_start int, tlen int")
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    for k, p in enumerate(paths):
        sinks.bam(df.where(f"ref_start % 2 = {k}"), p, {f"c{i}": 1 << 28 for i in range(1, 4)})
    whole = readers.bam(spark, paths, ["even", "odd"])
    assert sorted(map(tuple, whole.collect())) == sorted((*x, ("even", "odd")[x[1] % 2]) for x in rows)
    here = whole.where("chr = 'c2' and ref_start between 5000000 and 6000000 and sample = 'odd'")
    assert sorted(map(tuple, here.collect())) == sorted((*x, "odd") for x in rows if x[0] == "c2" and 5_000_000 <= x[1] <= 6_000_000 and x[1] % 2)
    assert not [p for folder in paths for p in (tmp_path / folder).iterdir() if p.name.startswith(".")]


def test_a_region_opens_only_its_blocks(spark, tmp_path, monkeypatch):
    rows = [("c1", i * 50, 100) for i in range(60_000)]
    df = spark.createDataFrame(rows, "chr string, ref_start int, tlen int").coalesce(1)
    df.sparkSession.dataSource.register(bam.BamSource)
    df.write.format("strandwork_bam").mode("append").options(path=str(tmp_path), sizes='[["c1", 4000000]]').save()
    path = next(str(p) for p in tmp_path.iterdir() if p.name.endswith(".bam"))
    opened = []
    at = bam.Blocks.at
    monkeypatch.setattr(bam.Blocks, "at", lambda self, offset: opened.append(offset) or at(self, offset))
    reader = bam.BamReader({"path": path})
    everything = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    n_blocks = len(set(opened))
    opened.clear()
    some = bam.BamReader({"path": path})
    list(some.pushFilters([bam.EqualTo(("chr",), "c1"), bam.GreaterThanOrEqual(("ref_start",), 1_500_000), bam.LessThan(("ref_start",), 1_510_000)]))
    found = [x for p in some.partitions() for b in some.read(p) for x in b.column(1).to_pylist()]
    assert everything == 60_000 and n_blocks > 20 and found == list(range(1_500_000, 1_510_000, 50)) and len(set(opened)) <= 4
    none = bam.BamReader({"path": path})
    list(none.pushFilters([bam.EqualTo(("chr",), "c9")]))
    assert none.partitions() == []


def test_bins_hold_whatever_overlaps():
    r = np.random.default_rng(3)
    for _ in range(300):
        a, b = sorted(r.integers(0, bam.LAST, 2).tolist())
        c = min(b, a + int(r.integers(1, 40_000)))
        assert bam.own_bin(a, c) in bam.bins(a, b + 1)
