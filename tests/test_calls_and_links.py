import random

import pytest
from strandwork.operators import calls, link

CALLS = "chr string, dyad long, dyad_score double, min_occ_score double"


def dyads_by_hand(score, occ, first, last, reach):
    """The sequential rule: highest score first, its neighbourhood zeroed and claimed, accepted if all was free."""
    score, claimed, out = dict(score), set(), []
    while score and max(score.values()) > 0:
        best = max(score.values())
        at = min(p for p, s in score.items() if s == best)
        near = [p for p in range(at - reach, at + reach + 1) if first <= p <= last]
        free = sum(p not in claimed for p in near)
        claimed |= set(near)
        if free == 2 * reach + 1:
            values = [occ.get(p, 0.0) for p in near]
            out.append((at, best, round(sum(values) / len(values), 9), min(values)))
        for p in near:
            if p in score:
                score[p] = 0
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_dyads(spark, seed):
    r = random.Random(seed)
    rows = {p: (float(r.randint(0, 6)), r.random()) for p in r.sample(range(1, 700), 260)}
    df = spark.createDataFrame([("c", p, s, o, 1, 700) for p, (s, o) in rows.items()], "chr string, pos long, dyad_score double, occ_score double, first long, last long")
    got = sorted((x["dyad"], x["dyad_score"], round(x["avg_occ_score"], 9), x["min_occ_score"]) for x in calls.dyads(df, 9).collect())
    assert got == dyads_by_hand({p: s for p, (s, _) in rows.items()}, {p: o for p, (_, o) in rows.items()}, 1, 700, 9)


@pytest.mark.parametrize("kind", ["random", "even", "ramp"])
def test_dense_tracks_are_cut_anywhere(spark, kind):
    """A row at every base, in stretches of a few dozen: noise, equal scores (each waits for the one before), and a slope."""
    r = random.Random(5)
    score = {p: {"random": float(r.randint(1, 50)), "even": 1.0, "ramp": float(p)}[kind] for p in range(1, 301)}
    df = spark.createDataFrame([("c", p, s, s, 1, 300) for p, s in score.items()], "chr string, pos long, dyad_score double, occ_score double, first long, last long")
    got = sorted((x["dyad"], x["dyad_score"], round(x["avg_occ_score"], 9), x["min_occ_score"]) for x in calls.dyads(df, 7, width=60).collect())
    assert got == dyads_by_hand(score, score, 1, 300, 7)


def sites_by_hand(score, width, first, last):
    left, out = dict(score), []
    while left:
        at = min(left, key=lambda p: (-left[p], p))
        a, b = max(at - width, first), min(at + 2 * width, last + 1)
        out.append(((a + b) // 2, score[at]))
        left = {p: s for p, s in left.items() if not a <= p < b}
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_dense_sites_are_cut_anywhere(spark, seed):
    r = random.Random(seed)
    score = {p: float(r.randint(1, 9)) for p in range(1, 301)}
    df = spark.createDataFrame([("t", "c", p, 4, s, 1, 300) for p, s in score.items()], "tf string, chr string, pos long, width int, score double, first long, last long")
    assert sorted((x["start"], x["score"]) for x in calls.sites(df, width=50).collect()) == sites_by_hand(score, 4, 1, 300)


def test_no_rows_no_calls(spark):
    none = spark.createDataFrame([], "tf string, chr string, pos long, width int, score double, dyad_score double, occ_score double, first long, last long")
    assert calls.dyads(none).collect() == [] and calls.sites(none).collect() == []


def test_sites(spark):
    schema = "tf string, chr string, pos long, width int, score double, first long, last long"
    rows = [("t", "c", p, 4, s, 1, 100) for p, s in ((10, 0.5), (12, 0.9), (17, 0.8), (18, 0.7), (60, 0.3), (2, 0.2), (50, 1e-12))]
    got = sorted(tuple(x) for x in calls.sites(spark.createDataFrame(rows, schema)).collect())
    # 12 suppresses [8, 20); 60 and 2 stand alone, 2 at the island's edge.
    assert got == [("t", "c", 5, 9, 4, 0.2), ("t", "c", 14, 18, 4, 0.9), ("t", "c", 62, 66, 4, 0.3)]


def pair_by_hand(a, b, tolerance=73):
    a, b, out, i, j = sorted(a), sorted(b), [], 0, 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def frame(spark, dyads):
    return spark.createDataFrame([("c", d, 0.5, 0.5) for d in dyads], CALLS)


def test_pair_by_hand(spark):
    got = link.link([frame(spark, [100, 300, 1000]), frame(spark, [150, 400, 1005])]).collect()
    assert {(r["dyadA"], r["dyadB"], r["shift_AB"]) for r in got} == {(100, 150, 50), (300, None, None), (None, 400, None), (1000, 1005, 5)}


@pytest.mark.parametrize("seed", range(3))
def test_pairs_at_random(spark, seed):
    r = random.Random(seed)
    a, b = r.sample(range(1, 9000), 90), r.sample(range(1, 9000), 80)
    got = [(x["dyadA"], x["dyadB"]) for x in link.link([frame(spark, a), frame(spark, b)]).collect()]
    key = lambda p: (p[0] is None, p[0] or 0, p[1] or 0)
    assert sorted(got, key=key) == sorted(pair_by_hand(a, b), key=key)


def third_by_hand(pairs, c, tolerance=73):
    known = lambda p: [x for x in p if x is not None]
    rows = sorted(pairs, key=lambda p: (int(sum(known(p)) / len(known(p))), [(x is None, x or 0) for x in p]))
    c, out, i, j = sorted(c), [], 0, 0
    while i < len(rows) and j < len(c):
        row, low, high, last = rows[i], min(known(rows[i])), max(known(rows[i])), rows[i][1]
        if last is None:
            step = "both" if low - tolerance <= c[j] <= high + tolerance else "new" if low > c[j] else "old"
        else:
            step = "both" if abs(last - c[j]) <= tolerance else "old" if last < c[j] else "new"
        out.append((*row, c[j]) if step == "both" else (*row, None) if step == "old" else (None, None, c[j]))
        i += step != "new"
        j += step != "old"
    return out + [(*p, None) for p in rows[i:]] + [(None, None, x) for x in c[j:]]


@pytest.mark.parametrize("seed", range(2))
def test_three_samples(spark, seed):
    r = random.Random(seed)
    a, b, c = (r.sample(range(1, 6000), 60) for _ in range(3))
    linked = link.link([frame(spark, x) for x in (a, b, c)])
    got = [(x["dyadA"], x["dyadB"], x["dyadC"]) for x in linked.collect()]
    assert sorted(map(str, got)) == sorted(map(str, third_by_hand(pair_by_hand(a, b), c)))
    names = [x["name"] for x in link.named(linked, 3).collect()]
    assert sorted(names, key=lambda n: int(n[4:])) == [f"nuc_{i}" for i in range(len(got))]


@pytest.mark.parametrize(("step", "width", "tolerance"), [(9, 100, 73), (1, 40, 5), (30, 1 << 17, 73), (60, 997, 20)])
def test_a_run_is_linked_in_stretches(spark, step, width, tolerance):
    """Calls closer than the tolerance throughout, repeated dyads among them, cut into stretches from under the reach to one of all."""
    r = random.Random(step)
    samples = [sorted(r.choices(range(1000, 1000 + 300 * step), k=n)) for n in (260, 300, 280)]
    linked = link.link([frame(spark, x) for x in samples], width=width, tolerance=tolerance)
    got = [(x["dyadA"], x["dyadB"], x["dyadC"]) for x in linked.collect()]
    assert sorted(map(str, got)) == sorted(map(str, third_by_hand(pair_by_hand(*samples[:2], tolerance), samples[2], tolerance)))


def test_a_long_run_keeps_many_tasks_busy(spark):
    """A row for every 40 positions in either sample: no stretch holds more than its own."""
    a = spark.range(30000).selectExpr("'c' as chr", "id * 40 as dyad", "0.5 as dyad_score", "0.5 as min_occ_score")
    b = a.withColumn("dyad", a["dyad"] + 27 - a["dyad"] % 13)
    out = link.add_sample(link.add_sample(None, a, 0), b, 1, width=1 << 14)
    got = {(x["dyadA"], x["dyadB"]) for x in out.collect()}
    assert got == set(pair_by_hand([40 * i for i in range(30000)], [40 * i + 27 - 40 * i % 13 for i in range(30000)]))


def test_links_of_nothing(spark):
    none, one = frame(spark, [1]).limit(0), frame(spark, [500])
    assert link.link([none, none]).collect() == []
    assert [(x["dyadA"], x["dyadB"]) for x in link.link([none, one]).collect()] == [(None, 500)]
    assert [(x["dyadA"], x["dyadB"]) for x in link.link([one, none]).collect()] == [(500, None)]
    lost = spark.createDataFrame([(None, 500, 0.5, 0.5), ("c", None, 0.5, 0.5)], CALLS)
    assert [(x["chr"], x["dyadA"], x["dyadB"]) for x in link.link([lost, lost]).collect()] == [(None, 500, 500)]


def test_shift_class(spark):
    rows = [(5, -10), (30, 40), (30, -40), (30, None), (5, 40)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(link.shift_class(["a", "b"])).collect()]
    assert [x[0] for x in got] == list("12342")
