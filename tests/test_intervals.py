import random

import pytest
from pyspark.sql import functions as F
from strandwork.operators import intervals

SPAN = "chr string, start long, end long"


def random_spans(seed, n, width):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.randint(1, width)
        out.append((r.choice(["a", "b"]), a, a + r.randint(0, 60)))
    return out


def islands_by_hand(spans, gap):
    out, last = {}, {}
    for c, a, b in sorted(spans):
        if c not in last or a > last[c][1] + gap:
            last[c] = [a, b, 0]
            out.setdefault(c, []).append(last[c])
        last[c][1] = max(last[c][1], b)
        last[c][2] += 1
    return sorted((c, *x) for c, xs in out.items() for x in xs)


@pytest.mark.parametrize("gap", [0, 1, 25])
def test_islands(spark, gap):
    spans = random_spans(gap, 150, 3000)
    df = spark.createDataFrame(spans, SPAN)
    found = intervals.islands(df, gap, width=200)
    got = found.groupBy("chr", "island").agg({"start": "min", "end": "max", "*": "count"}).collect()
    assert sorted((r[0], r["min(start)"], r["max(end)"], r["count(1)"]) for r in got) == islands_by_hand(spans, gap)


@pytest.mark.parametrize("gap", [0, 25])
def test_islands_in_even_bins(spark, gap):
    """A third of all rows on 300 positions, copies among them: the same islands, and no bin or task with over twice its share."""
    r = random.Random(5)
    spans = random_spans(9, 1500, 200_000) + [("a", x, x + r.randint(0, 3)) for x in (r.randint(90_000, 90_300) for _ in range(800))] + [("b", 5, 9)] * 200
    df = spark.createDataFrame(spans, SPAN)
    got = intervals.islands(df, gap).groupBy("chr", "island").agg({"start": "min", "end": "max", "*": "count"}).collect()
    assert sorted((r[0], r["min(start)"], r["max(end)"], r["count(1)"]) for r in got) == islands_by_hand(spans, gap)
    assert sorted(r["island"] for r in got if r["chr"] == "a") == list(range(sum(r["chr"] == "a" for r in got)))


def test_even_bins(spark):
    r = random.Random(6)
    rows = [("a", r.randint(1, 1 << 22)) for _ in range(12_000)] + [("a", r.randint(1 << 20, (1 << 20) + 60_000)) for _ in range(6_000)] + [("b", r.randint(1, 9000)) for _ in range(900)] + [("c", None)]
    found = intervals.binned(spark.createDataFrame(rows, "chr string, pos long"), "pos")
    bins = found.groupBy("chr", "_bin").agg({"pos": "min", "*": "count"}).withColumnRenamed("min(pos)", "low").collect()
    assert sum(b["count(1)"] for b in bins) == 18_900
    order = sorted((b["chr"], b["_bin"], b["low"]) for b in bins)
    assert order == sorted(order, key=lambda x: (x[0], x[2]))
    tasks = [t["count"] for t in found.repartition(4, "chr", "_bin").groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(tasks) <= 2 * sum(tasks) / 4


def test_islands_of_the_sample_segments(spark):
    rows = [("chrI", a, a + 4999) for a in (24001, 28001, 60001, 64001, 68001)] + [("chrII", a, a + 4999) for a in (72001, 76001)]
    found = intervals.island_extents(spark.createDataFrame(rows, SPAN)).collect()
    assert sorted((r["chr"], r["start"], r["end"], r["n"]) for r in found) == [("chrI", 24001, 33000, 2), ("chrI", 60001, 73000, 3), ("chrII", 72001, 81000, 2)]


def test_overlap_join_over_bins(spark):
    a, b = random_spans(1, 120, 2000), random_spans(2, 100, 2000)
    one = spark.createDataFrame(a, SPAN)
    two = spark.createDataFrame(b, "chr string, r_start long, r_end long")
    got = sorted((r["chr"], r["start"], r["end"], r["r_start"], r["r_end"]) for r in intervals.overlap_join(one, two, width=37).collect())
    assert got == sorted((c, s, e, x, y) for c, s, e in a for d, x, y in b if c == d and s <= y and e >= x)


def test_coverage_and_uncovered(spark):
    spans = random_spans(3, 60, 800)
    depth = {}
    for c, a, b in spans:
        for p in range(a, b + 1):
            depth[c, p] = depth.get((c, p), 0) + 1
    df = spark.createDataFrame(spans, SPAN)
    got = {(r["chr"], p): r["depth"] for r in intervals.coverage(df).collect() for p in range(r["start"], r["end"] + 1)}
    assert got == depth
    region = spark.createDataFrame([("a", 1, 900)], "chr string, r_start long, r_end long")
    free = {p for r in intervals.uncovered(region, df).collect() for p in range(r["start"], r["end"] + 1)}
    assert free == {p for p in range(1, 901) if ("a", p) not in depth}


def test_linkers(spark):
    got = intervals.linkers(spark.createDataFrame([("a", 2386), ("a", 88)], "chr string, dyad long")).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(2298, 2313), (2459, 2474)]


def test_empty(spark):
    none = spark.createDataFrame([], SPAN)
    assert intervals.islands(none).count() == intervals.coverage(none).count() == 0


def test_trimmed_edges(spark):
    """The first and the last segment keep their outer edges, inner ones lose ``trim`` bases; no rows give none."""
    segments = [("c", 1, 10), ("c", 7, 16), ("c", 13, 20)]
    df = spark.createDataFrame([(c, p, a, b, a / 100) for c, a, b in segments for p in range(a, b + 1)], "chr string, pos long, start long, end long, p double")
    ends = spark.createDataFrame(segments, "chr string, start long, end long")
    got = {r["pos"]: r["p"] for r in intervals.trimmed(df, ends, ["p"], trim=2).collect()}
    assert got == {p: 0.01 if p < 9 else 0.07 if p < 15 else 0.13 for p in range(1, 21)}
    assert intervals.trimmed(df.limit(0), ends.limit(0), ["p"]).collect() == []
