"""Stretches beside genes against the rule by hand, and what is looked up for nucleosomes."""

import random

import pytest
from strandwork.operators import annotate, intervals

GENES = "chr string, orf string, strand int, plus1 long, minus1 long, tss long, tts long, orf_start long, orf_end long, row long"


def crowded(seed, n, width):
    """Genes on few bases, some with another's name, some without a name or a place."""
    r, rows = random.Random(seed), []
    for i in range(n):
        a, size, strand = r.randint(1, width), r.randint(5, 120), r.choice([1, -1])
        tss, tts = (a, a + size) if strand == 1 else (a + size, a)
        orf = None if i % 40 == 7 else f"Y{r.randrange(n) if r.random() < 0.2 else i}"
        rows.append((r.choice("ab"), orf, strand, tss + 30 * strand, tss - 150 * strand, tss, tts, tss + 3 * strand, tts - 3 * strand, i))
    return [*rows, ("c", "alone", 1, 50, None, 20, 90, 23, 87, n), (None, "nowhere", 1, 50, None, 20, 90, 23, 87, n + 1)]


def by_hand(rows, start, end, raises):
    out = set()
    for c, orf, strand, *_, row in rows:
        tss, tts = rows[row][5:7]
        s, e = start(strand, tss, tts), end(strand, tss, tts)
        others = [x[5:9] for x in rows if x[0] == c is not None and x[1] is not None and orf is not None and x[1] != orf]
        if raises(strand):
            s = max([s, *(max(x) for x in others if max(x) < e)])
        else:
            e = min([e, *(min(x) for x in others if min(x) > s)])
        out.add((row, s, e))
    return out


@pytest.mark.parametrize(("n", "width"), [(60, 9000), (400, 1500)])
def test_stretches_are_cut_by_the_nearest_other_gene(spark, n, width):
    rows = crowded(n, n, width)
    df = spark.createDataFrame(rows, GENES)
    wanted = {
        "promoter": (annotate.promoters(df), lambda k, a, b: max(1, a - 2000) if k == 1 else a + 1, lambda k, a, b: a - 1 if k == 1 else a + 2000, lambda k: k == 1),
        "downstream": (annotate.downstreams(df), lambda k, a, b: b + 1 if k == 1 else max(1, b - 500), lambda k, a, b: b + 500 if k == 1 else b - 1, lambda k: k == -1),
    }
    wanted["compat"] = (annotate.downstreams(df, strict_compat=True), *wanted["downstream"][1:3], lambda k: k == 1)
    for name, (found, *rule) in wanted.items():
        kind = "downstream" if name == "compat" else name
        got = [(r["row"], r[f"{kind}_start"], r[f"{kind}_end"]) for r in found.collect()]
        assert len(got) == len(rows) and set(got) == by_hand(rows, *rule)


def test_genes_within_a_stretch_have_no_rows(spark):
    """Crowded genes are looked up in order of place, not paired with the stretches that hold them."""
    df = spark.createDataFrame(crowded(1, 50, 500), GENES)
    for found in (annotate.promoters(df), annotate.downstreams(df)):
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_looked_up_for_rows_that_are_left(spark, monkeypatch):
    """Genes' stretches meet only nucleosomes without a +1 or -1 gene, and of marks on one base the first one only."""
    df = spark.createDataFrame([("a", f"Y{i}W", 1, 100 + i % 5, None, 900, 990, 903, 987, i) for i in range(200)], GENES)
    nucs = spark.createDataFrame([("x", "a", 90, 120), ("y", "a", 950, None), ("z", "a", None, 5000)], "name string, chr string, dyadA long, dyadB long")
    asked, marked, names_at, point_join = [], [], annotate.names_at, intervals.point_join

    def names(rows, *rest):
        asked.append({r["name"] for r in rows.collect()})
        return names_at(rows, *rest)

    def joined(points, marks, *rest, **more):
        marked.append(marks.count())
        return point_join(points, marks, *rest, **more)

    monkeypatch.setattr(annotate, "names_at", names)
    monkeypatch.setattr(intervals, "point_join", joined)
    found = {r["name"]: r for r in annotate.annotate(nucs, df, ["dyadA", "dyadB"]).collect()}
    assert asked == [{"y", "z"}] * 3 and marked[0] == 5
    assert found["x"]["plus1"] == "Y0W" and found["x"]["orf"] is None
    assert found["y"]["orf"] == ",".join(sorted(f"Y{i}W" for i in range(200))) and found["z"]["orf"] is None
