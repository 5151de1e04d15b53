"""Counts by place against plain Python, and what their plans make of the input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from strandwork.operators import fit, signal

TEXTS = ["ACGTNACG", "acgtt", "A", "", None, "TTßéA漢C", "👍AC".encode("utf-16", "surrogatepass").decode("utf-16"), "GATTACA" * 9]


@pytest.mark.parametrize("at_once", [1 << 20, 10, 64])
def test_words_by_place(spark, monkeypatch, at_once):
    """Texts of a piece, of many pieces and of other letters, whatever is counted together."""
    monkeypatch.setattr(fit, "AT_ONCE", at_once)
    df = spark.createDataFrame([(x,) for x in TEXTS * 3], "seq string")
    upper = [r[0] for r in df.where("seq is not null").select(F.upper("seq")).collect()]
    for size, found in ((1, fit.position_composition(df)), (2, fit.dinucleotide_frequency(df))):
        want = Counter((i + 1, *x[i : i + size]) for x in upper for i in range(len(x) - size + 1) if set(x[i : i + size]) <= set("ACGT"))
        total = Counter()
        for k, n in want.items():
            total[k[0]] += n
        letters = ["base"] if size == 1 else ["cur", "nxt"]
        got = {(r["pos"], *(r[c] for c in letters)): (r["n"], r["share"]) for r in found.collect()}
        assert {k: n for k, (n, _) in got.items()} == want and all(share == n / total[k[0]] for k, (n, share) in got.items())


def test_letters_are_not_exploded(spark):
    """What is grouped are counts of many sequences, not a row for each letter."""
    df = spark.createDataFrame([("ACGT",)], "seq string")
    for found in (fit.position_composition(df), fit.dinucleotide_transition(df)):
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_site_counts_of_crowded_places(spark):
    """Many sites and midpoints on few bases: counts as by hand, and no pair of a site and a midpoint has a row."""
    r = random.Random(4)
    sites = [(i, r.choice("ab"), r.randint(1, 12) * 10) for i in range(600)] + [(600, "c", 5), (601, "a", None)]
    mids = [(r.choice("ab"), r.randint(1, 130)) for _ in range(700)]
    found = signal.site_count_histogram(spark.createDataFrame(sites, "site_id long, chr string, centre long"), spark.createDataFrame(mids, "chr string, pos long"), 3)
    at = Counter(mids)
    want = Counter((rel, at[c, p + rel] if p else 0) for _, c, p in sites for rel in range(-3, 4))
    assert {(x["rel"], x["value"]): x["n"] for x in found.collect()} == want
    assert "_bin" not in found._jdf.queryExecution().optimizedPlan().toString()
