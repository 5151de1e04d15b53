import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandwork.operators import diff, quantile

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("gather", [2, 40, 10_000])
def test_equal_to_sorting(spark, gather):
    """Even values, heavy ties on either side, one row, all equal, null groups; with stretches of few and of many values."""
    rng = random.Random(4)
    groups = {
        "even": [rng.gauss(0, 5) for _ in range(3000)],
        "low": [1.0] * 2990 + [2.0] * 10,
        "high": [1.0] * 10 + [2.0] * 2990,
        "few": [float(rng.randint(0, 9)) for _ in range(700)],
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [7.0] * 50,
        None: [float(i * i) for i in range(120)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    found = {r["_g"]: (r["n"], r["q"]) for r in quantile.quantiles(df, "x", ["g"], SHARES, gather).collect()}
    keys = {r["g"]: r["k"] for r in df.select("g", quantile.group_key(["g"]).alias("k")).distinct().collect()}
    assert set(found) == {keys[g] for g in groups}
    for g, xs in groups.items():
        n, q = found[keys[g]]
        assert n == len(xs) and np.allclose(q, np.quantile(xs, SHARES))


def test_spread_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    row = diff.spread(df, "x", []).first()
    assert (row["n"], row["q1"], row["median"], row["q3"]) == (3, 1.5, 2.0, 3.0)
    assert diff.spread(df.withColumn("g", F.lit(1)).limit(0), "x", ["g"]).count() == 0
    nulls = diff.spread(df.withColumn("g", F.col("x")).where("x is null"), "x", ["g"]).first()
    assert nulls["n"] == 0 and nulls["median"] is None
