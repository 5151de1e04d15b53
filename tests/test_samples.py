"""Draws with replacement, the dinucleotide model as text, and views of a region over samples."""

import random

import pytest
from pyspark.sql import functions as F
from strandwork import api
from strandwork.operators import diff, fit, hmm
from strandwork.sources import readers, sinks

LINKED = "chr string, dyadA long, occupancyA double, pdyadA double, dyadB long, occupancyB double, pdyadB double, dyadC long, occupancyC double, pdyadC double"


def test_draws_sum_to_n_whatever_the_partitions(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 2).alias("_h2"))
    one, two, other = ({r["k"]: r["draws"] for r in fit.drawn(x, "k", 2000, seed).collect()} for x, seed in ((df.repartition(9), 1), (df.coalesce(1), 1), (df, 2)))
    assert one == two != other and sum(one.values()) == sum(other.values()) == 2000
    assert len(one) > 470 and max(one.values()) < 16  # 4 draws a row on average: some 9 rows go without one
    assert fit.drawn(df.limit(0), "k", 10, 1).count() == 0


def test_random_segments(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 49), ("c", 50), ("d", 3000)], "chr string, size long")
    rows = fit.random_segments(sizes, 4000, 50, 10).collect()
    assert sorted(r["draw"] for r in rows) == list(range(4000))
    assert all(r["start"] >= 1 and r["end"] == r["start"] + 49 <= {"a": 1000, "c": 50, "d": 3000}[r["chr"]] for r in rows)
    share = sum(r["chr"] == "a" for r in rows) / 4000
    assert abs(share - 951 / 3903) < 0.03
    assert fit.random_segments(sizes.where("size < 50"), 5, 50, 10).count() == 0


def test_dinucleotide_text_and_back(spark, tmp_path):
    rng = random.Random(3)

    def shares():
        x = [rng.random() for _ in range(4)]
        return [v / sum(x) for v in x]

    blank = hmm.Model({}, [0.25] * 4, {"background": 0.9, "nucleosome": 0.1})
    model = hmm.Model({}, [0.25] * 4, {"background": 0.9, "nucleosome": 0.1}, shares(), [[shares() for _ in range(4)] for _ in range(127)])
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.dinucleotides(spark, model, one)
    read = readers.dinucleotide_model(spark, one, blank)
    assert read == model
    sinks.dinucleotides(spark, read, two)
    text = [r[0] for r in spark.read.text(one).collect()]
    assert text == [r[0] for r in spark.read.text(two).collect()]
    assert text[:2] == ["# nucleosome dinucleotide model", "# from to transition_prob"] and text[10] == "# 1 branched background state"
    assert text[15].startswith("10 14 ") and text[2046].startswith("517 521 ") and text[2051] == "# 10 normal background states" and text[-1] == "530 531 1.0"
    edges = model.edges()
    assert len(edges) == 2057
    for wrong in (edges[1:], [*edges, (9, 20, 0.1)], [(a, b, 0.5 if a == 3 else p) for a, b, p in edges]):
        with pytest.raises(ValueError):
            blank.with_edges(wrong)


def test_region_nucleosomes(spark):
    rows = [
        ("a", 100, 1.0, 0.5, 130, 1.0, 1.0, 115, 1.0, 0.1),  # later, same
        ("a", 300, 1.0, 0.5, None, None, None, 320, 1.0, 0.1),  # nothing to join to
        ("a", None, None, None, 500, 1.0, 0.2, 470, 1.0, 0.2),  # earlier
        ("b", 100, 1.0, 0.5, 100, 1.0, 0.5, 100, 1.0, 0.5),
    ]
    linked = spark.createDataFrame(rows, LINKED)

    def seen(start, end):
        regions = spark.createDataFrame([("a", start, end)], "chr string, r_start long, r_end long")
        return sorted((r["sample"], r["dyad"], r["start"], r["end"], round(r["strength"], 3), r["shift"], r["previous"]) for r in diff.region_nucleosomes(linked, 3, regions).collect())

    assert seen(1, 200) == [("A", 100, 75, 125, 0.45, "same", None), ("B", 130, 105, 155, 0.9, "later", 100), ("C", 115, 90, 140, 0.09, "same", 130)]
    assert seen(250, 600) == [("A", 300, 275, 325, 0.45, "same", None), ("B", 500, 475, 525, 0.18, "same", None), ("C", 320, 295, 345, 0.09, "same", None), ("C", 470, 445, 495, 0.18, "earlier", 500)]
    assert len(seen(127, 130)) == 3 and seen(128, 130) == [] and len(seen(1, 105)) == 3 and seen(1, 104) == []


def test_views_of_two_samples(spark):
    weights = {"background": 0.8, "nucleosome": 0.1, "A1": 0.1}
    model = hmm.Model({"A1": [[0.7, 0.1, 0.1, 0.1]] * 3}, [0.25] * 4, weights)
    segments = spark.createDataFrame([(1, "a", 1, 100)], "segment_id long, chr string, start long, end long")
    posterior = spark.createDataFrame([("a", 10, 0, 0.9, 1), ("a", 10, 1, 0.1, 1), ("a", 60, 0, 1.0, 1)], "chr string, pos long, state int, prob double, segment_id long")
    linked = spark.createDataFrame([("a", 50, 1.0, 0.5, 90, 1.0, 1.0)], LINKED.split(", dyadC")[0])
    sites = spark.createDataFrame([("a", "X", 10, 20, 0.05, 0.3), ("a", "Y", 40, 51, 0.2, None), ("a", "Z", 30, 40, 0.2, 0.3), ("a", "W", 30, 40, 0.01, 0.02), ("a", "V", 55, 66, 0.9, 0.9)], "chr string, tf string, start long, end long, scoreA double, scoreB double")
    found = api.compare_region([(posterior, segments, model), (posterior.where("pos = 60"), segments, model)], linked, sites, "a", 5, 55)
    assert {(r["sample"], r["pos"], r["dbf"]) for r in found["tracks"].collect()} == {("A", 10, "background"), ("A", 10, "A1")}
    assert sorted((r["sample"], r["shift"]) for r in found["nucleosomes"].collect()) == []  # 90 - 25 lies behind the region
    assert sorted((r["tf"], r["centre"], r["changed"]) for r in found["sites"].collect()) == [("X", 15, True), ("Y", 45, True), ("Z", 35, False)]
    wider = api.compare_region([(posterior, segments, model)] * 2, linked, sites, "a", 5, 65)
    assert sorted((r["sample"], r["shift"], r["previous"]) for r in wider["nucleosomes"].collect()) == [("A", "same", None), ("B", "later", 50)]
