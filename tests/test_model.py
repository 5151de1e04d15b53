import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandwork import api
from strandwork.config import parse
from strandwork.functions import scalar
from strandwork.operators import cluster, diff, fit, hmm, occupancy


def model(**more):
    motifs = {"A1": [[0.7, 0.1, 0.1, 0.1], [0.1, 0.6, 0.2, 0.1], [0.25, 0.25, 0.25, 0.25]], "unknown": [[0.3, 0.2, 0.2, 0.3]] * 2}
    weights = {"background": 0.8, "nucleosome": 0.1, "A1": 0.06, "unknown": 0.04}
    rng = np.random.default_rng(1)
    trans = rng.dirichlet(np.ones(4), (127, 4)).tolist()
    counts = {"long": hmm.Counts((0.1, 1.5), (0.2, 1.0), (tuple(0.1 + 0.01 * i for i in range(147)), 2.0))}
    return hmm.Model(motifs, [0.3, 0.2, 0.2, 0.3], weights, [0.1, 0.2, 0.3, 0.4], trans, rng.dirichlet(np.ones(4), 19).tolist(), counts, **more)


@pytest.mark.parametrize("kind", ["normal", "gamma"])
def test_smooth_signals(spark, tmp_path, kind):
    """Densities of a smoothed signal emit by state what the column functions say, and survive a file."""
    pairs = [(0.5 + 0.01 * i, 1.0 + 0.002 * i) for i in range(149)]
    m = model()
    m = hmm.Model(**{f: getattr(m, f) for f in ("motifs", "background", "weights", "first", "transitions", "ends")}, counts={"long": hmm.Density(kind, pairs[0], pairs[1], tuple(pairs[2:]))}, use_sequence=False)
    m.save(spark, str(tmp_path / "m"))
    assert hmm.Model.load(spark, str(tmp_path / "m")) == m or hmm.Model.load(spark, str(tmp_path / "m")).counts == m.counts
    x = np.array([[0.3, 1.7, 2.2]])
    kernel = hmm.Kernel(m)
    got = kernel._emission(None, {"long": x[0]})
    pdf = scalar.normal_pdf if kind == "normal" else scalar.gamma_pdf
    rows = spark.createDataFrame([(i, j, float(v), *pairs[p + 2]) for i, v in enumerate(x[0]) for j, p in enumerate(kernel.position.tolist())], "i int, j int, x double, a double, b double")
    want = {(r["i"], r["j"]): r["y"] for r in rows.select("i", "j", pdf(F.col("x"), F.col("a"), F.col("b")).alias("y")).collect()}
    assert np.allclose(got, [[want[i, j] for j in range(m.n_states)] for i in range(3)])
    post, ll = kernel.posterior(None, {"long": x[0]})
    assert np.allclose(post.sum(axis=1), 1) and math.isfinite(ll)


def test_gamma_of_most_likelihood(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2.5, 1 / 0.8, 4000), 3) + 0.001
    rows = [("a", float(v), 1) for v in values] + [("b", 2.0, 5), ("a", 0.0, 7)]
    found = {r["g"]: r for r in fit.fit_gamma(spark.createDataFrame(rows, "g string, value double, n long"), ["g"]).collect()}
    ll = lambda a, b: float((a * math.log(b) + (a - 1) * np.log(values) - b * values - math.lgamma(a)).sum())
    a, b = found["a"]["shape"], found["a"]["rate"]
    assert all(ll(a, b) >= ll(a * x, b * y) for x in (0.99, 1, 1.01) for y in (0.99, 1, 1.01)) and abs(a - 2.5) < 0.2
    assert found["b"]["shape"] is None and found["b"]["rate"] is None


def test_intervals_of_means(spark):
    known = {1: 12.7062, 2: 4.30265, 3: 3.18245, 5: 2.57058, 10: 2.22814, 30: 2.04227, 1000: 1.96234}
    got = spark.createDataFrame([(n,) for n in known], "n long").select("n", scalar.t_quantile(F.col("n"), 0.975).alias("q")).collect()
    assert all(abs(r["q"] / known[r["n"]] - 1) < 2e-3 for r in got)
    row = diff.confidence(spark.createDataFrame([(1, float(x)) for x in (1, 2, 3)] + [(2, 5.0)], "k int, x double"), "x", ["k"]).orderBy("k").collect()
    assert row[0]["mean"] == 2 and abs(row[0]["high"] - 2 - 4.30265 / math.sqrt(3)) < 1e-4 and row[1]["low"] is None
    assert [scalar.sample_suffix(i) for i in (0, 25, 26, 27, 52)] == ["A", "Z", "AA", "AB", "BA"]


def test_clusters_of_separate_groups(spark):
    rows = [(i, float(i % 3) / 3 + i / 1e5, [None, 5.0, 0.9][i % 3], float(i % 2) * 50 + i / 1e4) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    found = {r["i"]: r["occ_cluster"] for r in cluster.cluster_occupancy(df, ["a", "b"], 3).collect()}
    groups = [{found[i] for i in range(60) if i % 3 == g} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and groups[0] == {1} and set().union(*groups) == {1, 2, 3}  # 0 for missing, clipped to 1
    found = {r["i"]: r["cluster"] for r in cluster.cluster_scaled(df, ["c"], 2).collect()}
    assert {found[i] == i % 2 for i in range(60)} == {True}


def test_clusters_do_not_depend_on_partitions(spark):
    """Repeated rows, fewer different rows than clusters, an empty table, and rows dealt anew."""
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows + [(i + 300, *r) for i, *r in rows], "i int, a double, b double, c double")
    one, two = ({r["i"]: r["occ_cluster"] for r in cluster.cluster_occupancy(x, ["a", "b", "c"], 5).collect()} for x in (df.repartition(7), df.coalesce(1)))
    assert one == two and set(one.values()) == {1, 2, 3, 4, 5} and all(one[i] == one[i + 300] for i in range(300))
    few = cluster.cluster_occupancy(spark.createDataFrame([(0.5,), (0.5,), (0.1,)], "a double"), ["a"], 3).collect()
    assert sorted((r["a"], r["occ_cluster"]) for r in few) == [(0.1, 1), (0.5, 2), (0.5, 2)]
    none = cluster.cluster_scaled(spark.createDataFrame([], "a double"), ["a"], 3)
    assert none.columns == ["a", "cluster"] and none.count() == 0


@pytest.mark.parametrize("assays", [[], ["MNase"], ["MNase", "ATAC"]])
def test_runs_from_config_files(spark, tmp_path, assays):
    """Sequence alone, one assay, two assays: from files to a model and a posterior; a second run finds all rounds done."""
    rng = random.Random(5)
    (tmp_path / "g.fa").write_text(">chrI\n" + "".join(rng.choices("ACGT", k=3000)) + "\n")
    (tmp_path / "m.meme").write_text("MOTIF A1\nletter-probability matrix: w= 2\n0.7 0.1 0.1 0.1\n0.1 0.7 0.1 0.1\n")
    (tmp_path / "d.bed").write_text("".join(f"chrI\t{p}\t{p + 1}\n" for p in range(200, 2800, 190)))
    (tmp_path / "s.bed").write_text("chrI\t500\t510\tA1\t0\t+\nchrI\t900\t910\tA1\t0\t-\n")
    (tmp_path / "c.tsv").write_text("chr\tstart\tend\nchrI\t1\t600\nchrI\t501\t1100\n")
    files = []
    for tech in assays or ["MNase"]:
        text = f"[main]\npwmFile = {tmp_path}/m.meme\nnucleosomeFile = {tmp_path}/d.bed\ntfFile = {tmp_path}/s.bed\nnucFile = {tmp_path}/g.fa\ntech = {tech}\n"
        if assays:
            rows = [("chrI", rng.randint(0, 2800), rng.choice([150, 40])) for _ in range(800)]
            spark.createDataFrame(rows, "chr string, ref_start int, tlen int").write.parquet(f"{tmp_path}/{tech}")
            text += f"bamFile = {tmp_path}/{tech}\n"
        (tmp_path / f"{tech}.ini").write_text(text)
        files.append(str(tmp_path / f"{tech}.ini"))
    out = str(tmp_path / "out")
    m, history = api.run_training(spark, files, f"{tmp_path}/c.tsv", out, rounds=1)
    assert set(m.counts) == {f"{c}_{t}" for t in assays for c in ("long", "short")} and len(history) == 2 and history[1] >= history[0] - 1e-6
    assert api.run_training(spark, files, f"{tmp_path}/c.tsv", out, rounds=1)[1] == history
    post = api.run_decoding(spark, out, f"{tmp_path}/c.tsv", f"{out}/all")
    total = post.groupBy("segment_id", "pos").agg(F.sum("prob").alias("p")).collect()
    assert len(total) == 1200 and all(abs(r["p"] - 1) < 0.05 for r in total)
    assert abs(spark.read.parquet(f"{out}/all/likelihoods").agg(F.sum("log_likelihood")).first()[0] - history[1]) < 1e-6 * abs(history[1])
    segs = spark.createDataFrame([("chrI", 1, 600), ("chrI", 501, 1100)], "chr string, start long, end long")
    track = {r["pos"]: r["prob"] for r in api.background_track(post, segs, m).collect()}
    by_hand = {}
    for r in post.where("state = 0").collect():
        by_hand.setdefault(r["pos"], []).append(r["prob"])
    assert all(abs(track.get(p, 0) - sum(x) / (2 if 501 <= p <= 600 else 1)) < 1e-9 for p, x in by_hand.items()) and set(track) == set(by_hand)


def dense(m):
    """The whole transition matrix over emitting states, and start chances, written out edge by edge."""
    n, s = m.n_states, m.nuc_start
    entry, ends, p = np.zeros(n), [0, s + 530], np.zeros((n, n))
    entry[0], entry[s] = m.weights["background"], m.weights["nucleosome"]
    for name, pair in m.starts().items():
        size = len(m.motifs[name])
        for a in pair:
            entry[a] = m.weights[name] / 2
            ends.append(a + size - 1)
            for i in range(a, a + size - 1):
                p[i, i + 1] = 1
    for i in range(8):
        p[s + i, s + i + 1] = 1
    for b in range(4):
        p[s + 8, s + 9 + b] = m.first[b]
        p[s + 9 + 4 * 127 + b, s + 521] = 1
    for k, a, b in itertools.product(range(127), range(4), range(4)):
        p[s + 9 + 4 * k + a, s + 9 + 4 * (k + 1) + b] = m.transitions[k][a][b]
    for i in range(s + 521, s + 530):
        p[i, i + 1] = 1
    for e in ends:
        p[e] += entry
    return entry, p


def test_posterior_is_that_of_the_dense_chain():
    m, r = model(), random.Random(3)
    kernel = hmm.Kernel(m)
    codes = np.array([r.randint(0, 3) for _ in range(260)])
    signals = {"long": np.array([r.randint(0, 3) for _ in range(260)])}
    entry, p = dense(m)
    assert np.allclose(p.sum(axis=1), 1)
    e = kernel._emission(codes, signals)
    alpha, scale = np.zeros_like(e), np.zeros(len(e))
    for t in range(len(e)):
        x = (entry if t == 0 else alpha[t - 1] @ p) * e[t]
        scale[t] = x.sum()
        alpha[t] = x / scale[t]
    beta = np.ones_like(e)
    for t in range(len(e) - 2, -1, -1):
        beta[t] = p @ (e[t + 1] * beta[t + 1]) / scale[t + 1]
    post, ll = kernel.posterior(codes, signals)
    assert np.allclose(post, alpha * beta, atol=1e-10)
    assert ll == pytest.approx(np.log(scale).sum())
    assert np.allclose(post.sum(axis=1), 1)


def test_emission():
    m = model()
    kernel = hmm.Kernel(m)
    e = kernel._emission(np.array([1, 4]), {"long": np.array([2, 0])})
    start = m.starts()["A1"][0]
    assert e[0, start + 1] == pytest.approx(0.6 * hmm._nb(2, 0.2, 1.0))
    assert e[0, m.starts()["A1"][1] + 1] == pytest.approx(m.motifs["A1"][1][2] * hmm._nb(2, 0.2, 1.0))  # reverse complement
    assert e[1, 0] == pytest.approx(hmm._nb(0, 0.1, 1.5))  # an unknown base tells nothing
    assert hmm.Kernel(m, strict_compat=True)._emission(np.array([4]), {"long": np.array([0])}).max() == 0


def segments(spark, n=3, size=220):
    r = random.Random(5)
    rows = [(i, "c", 1 + i * 150, i * 150 + size, [r.randint(0, 3) for _ in range(size)], [min(3, int(r.expovariate(3))) for _ in range(size)]) for i in range(n)]
    return spark.createDataFrame(rows, "segment_id long, chr string, start long, end long, codes array<tinyint>, long array<int>")


def test_training_never_lowers_the_likelihood(spark):
    found, history = hmm.train(segments(spark), model(), rounds=3, cap=1.0)
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(history)) and history[-1] > history[0]
    assert sum(found.weights.values()) == pytest.approx(1)


def test_segments_decoded_together_are_those_decoded_alone(spark):
    m, r = model(), np.random.default_rng(3)
    kernel = hmm.Kernel(m)
    codes, counts = r.integers(0, 5, (5, 230)), r.integers(0, 3, (5, 230))
    post, ll = kernel.posteriors(codes, {"long": counts})
    for i in range(5):
        one, l = kernel.posterior(codes[i], {"long": counts[i]})
        assert np.allclose(post[i], one) and ll[i] == pytest.approx(l)
    segs = segments(spark, 6)
    sums = {(x["segment_id"], x["pos"], x["dbf"]): x["prob"] for x in hmm.decode_factors(segs, m).collect()}
    states = spark.createDataFrame(m.factors(), "state int, dbf string")
    want = hmm.decode(segs, m).join(states, "state").groupBy("segment_id", "pos", "dbf").agg(F.sum("prob").alias("prob")).collect()
    assert {k: pytest.approx(v) for k, v in sums.items()} == {(x["segment_id"], x["pos"], x["dbf"]): x["prob"] for x in want}
    found = {x["segment_id"]: x["log_likelihood"] for x in hmm.log_likelihoods(segs, m).collect()}
    for x in segs.collect():
        assert found[x["segment_id"]] == pytest.approx(kernel.posterior(np.array(x["codes"]), {"long": np.array(x["long"])})[1])


def test_an_interrupted_training_goes_on(spark, tmp_path, monkeypatch):
    segs, m, path = segments(spark), model(), str(tmp_path / "em")
    want, history = hmm.train(segs, m, 3)
    hmm.train(segs, m, 1, path=path)
    asked, plain = [], hmm.expectations
    monkeypatch.setattr(hmm, "expectations", lambda s, x: asked.append(1) or plain(s, x))
    got, after = hmm.train(segs, m, 3, path=path)
    assert len(asked) == 3 and after == pytest.approx(history)
    assert got.weights == pytest.approx(want.weights)
    asked.clear()
    assert hmm.train(segs, m, 3, path=path)[1] == pytest.approx(history) and not asked


def test_what_differs_between_two_samples(spark):
    a = spark.createDataFrame([("c", p, "T", 0.1) for p in range(400)] + [("c", 100, "T", 0.3)], "chr string, pos long, tf string, prob double")
    b = spark.createDataFrame([("c", p, "T", 0.1 + 0.01 * (p % 3 == 0) + 0.8 * (p == 305)) for p in range(400)], "chr string, pos long, tf string, prob double")
    rows = {r["pos"]: r for r in diff.change(a, b).collect()}
    assert len(rows) == 400 and rows[100]["probA"] == pytest.approx(0.2) and rows[305]["diff"] == pytest.approx(0.8)
    nucs = spark.createDataFrame([("n1", "c", 80, 90), ("n2", "c", 200, 201), ("n3", "c", None, 5)], "name string, chr string, dyadA long, dyadB long")
    sites = spark.createDataFrame([("c", 300, 310, "T"), ("c", 10, 20, "T"), ("c", 300, 310, "U")], "chr string, start long, end long, tf string")
    found = diff.between_samples(a, b, nucs, sites).collect()
    assert [(r["start"], r["tf"], round(r["diff"], 3)) for r in found] == [(300, "T", 0.8)]


def test_decode_stitch_and_calls(spark, tmp_path):
    m, segs = model(), segments(spark)
    posterior = api.decode(segs, m, str(tmp_path / "p"))
    kernel = hmm.Kernel(m)
    rows = {r["segment_id"]: r for r in segs.collect()}
    post = {i: kernel.posterior(np.array(r["codes"]), {"long": np.array(r["long"])})[0] for i, r in rows.items()}
    got = {(r["segment_id"], r["pos"], r["state"]): r["prob"] for r in posterior.collect()}
    assert len(got) == sum((p >= 1e-4).sum() for p in post.values())
    assert all(p == pytest.approx(post[s][pos - rows[s]["start"], state]) for (s, pos, state), p in got.items())
    track = api.region(posterior, segs, m, "c", 140, 300).where("dbf = 'background'").collect()
    for r in track:
        over = [post[i][r["pos"] - x["start"], 0] for i, x in rows.items() if x["start"] <= r["pos"] <= x["end"]]
        assert r["prob"] == pytest.approx(sum(v for v in over if v >= 1e-4) / len(over))
    with pytest.raises(ValueError):
        api.region(posterior, segs, m, "c", 1, 10_000)
    assert set(api.call_nucleosomes(posterior, segs, m).columns) == {"chr", "dyad", "dyad_score", "avg_occ_score", "min_occ_score"}
    assert {r["tf"] for r in api.call_sites(posterior, segs, m).collect()} <= {"A1", "UNKNOWN"}


def test_model_round_trip(spark, tmp_path):
    m = model()
    m.save(spark, str(tmp_path / "m"))
    assert hmm.Model.load(spark, str(tmp_path / "m")) == m


def test_weights_must_be_sound():
    m = model()
    with pytest.raises(ValueError):
        hmm.Model(m.motifs, m.background, m.weights | {"A1": 0.5})


def test_unbound_root():
    conc, length = {"background": 1.0, "nucleosome": 35.0, "t": 0.001}, {"background": 1, "nucleosome": 147, "t": 9}
    prob = scalar.to_probabilities(conc, length)
    assert sum(prob.values()) == pytest.approx(1)
    back = scalar.to_concentrations(prob, length)
    assert back["t"] == pytest.approx(conc["t"]) and back["nucleosome"] == pytest.approx(35)


def test_nb_size_is_a_maximum():
    rng = np.random.default_rng(0)
    values, counts = np.unique(rng.negative_binomial(1.7, 1.7 / (1.7 + 4), 20_000), return_counts=True)
    mu, size = fit.nb_size(values.astype(float), counts.astype(float))
    ll = lambda r: sum(c * math.log(hmm._nb(int(v), mu, r)) for v, c in zip(values, counts, strict=True))
    assert 1.6 < size < 1.8 and ll(size) > max(ll(size * 0.98), ll(size * 1.02))
    assert fit.nb_size(np.array([3.0]), np.array([10.0])) == (0.002, 100.0)


def test_capped(spark):
    rows = [("background", 0.5), ("nucleosome", 0.1), ("a", 0.3), ("b", 0.05), ("unknown", 0.05)]
    got = {r["dbf"]: r["weight"] for r in occupancy.capped(spark.createDataFrame(rows, "dbf string, weight double"), 0.2).collect()}
    assert got["a"] == 0.2 and sum(got.values()) == pytest.approx(1) and got["b"] == pytest.approx(0.05 * 0.8 / 0.7)


def test_scalars(spark):
    row = spark.createDataFrame([("acGTNx", 1.96, 7.0, 'gene_id "G1"; gene_name "N 1";')], "s string, z double, x double, a string")
    got = row.select(
        scalar.base_codes(F.col("s")).alias("codes"),
        scalar.two_sided_p(F.col("z")).alias("p"),
        scalar.log_gamma(F.col("x")).alias("g"),
        scalar.gtf_attribute(F.col("a"), "gene_name").alias("name"),
        scalar.normal_pdf(F.col("x"), F.lit(7.0), F.lit(2.0)).alias("n"),
        scalar.gamma_pdf(F.col("x"), F.lit(2.0), F.lit(0.5)).alias("d"),
    ).first()
    assert got["codes"] == [0, 1, 2, 3, 4, 4] and got["name"] == "N 1"
    assert got["p"] == pytest.approx(0.05, abs=1e-3) and got["g"] == pytest.approx(math.lgamma(7))
    assert got["n"] == pytest.approx(1 / (2 * math.sqrt(2 * math.pi))) and got["d"] == pytest.approx(0.25 * 7 * math.exp(-3.5))


def test_config():
    c = parse("[main]\nfragRangeLong = (120, 180)\nfragRangeShort = (0, 90)\npwmFile = m.txt\ntech = ATAC\nother = 1\n")
    assert c.long == (120, 180) and c.short == (0, 90) and c.motifs == "m.txt" and c.offset == 4 and c.fasta is None


@pytest.mark.parametrize("bases", [1, 2, 3, 160, 301])
def test_stretches_are_the_whole(bases):
    """Forward values made again within stretches give what values kept for every base give, in any number of stretches."""
    m, rng = model(), np.random.default_rng(bases)
    kernel = hmm.Kernel(m)
    codes, counts = rng.integers(0, 5, (3, bases)), rng.integers(0, 4, (3, bases))
    e = np.stack([kernel._emission(codes[k], {"long": counts[k]}) for k in range(3)], axis=1)
    alpha, scale = [kernel._next(None, e[0])], []
    for t in range(1, bases):
        alpha.append(kernel._next(alpha[-1][0], e[t]))
    scale = [s for _, s in alpha]
    beta = [np.ones((3, kernel.n))]
    for t in range(bases - 2, -1, -1):
        beta.insert(0, kernel._backward_step(e[t + 1] * beta[0]) / scale[t + 1])
    want = np.stack([a * b for (a, _), b in zip(alpha, beta, strict=True)], axis=1)
    want /= want.sum(axis=2, keepdims=True)
    found = list(kernel.blocks(codes, {"long": counts}))
    assert [a for a, _, _ in found] == sorted((a for a, _, _ in found), reverse=True) and max(p.shape[1] for _, p, _ in found) <= math.isqrt(bases) + 1
    post, ll = kernel.posteriors(codes, {"long": counts})
    assert np.allclose(post, want, rtol=1e-12) and np.allclose(ll, np.log(scale).sum(axis=0)[:, 0], rtol=1e-12)


def test_memory_follows_states_and_the_root_of_the_bases():
    small = hmm.Kernel(model())
    wide = hmm.Kernel(hmm.Model({f"m{i}": [[0.25] * 4] * 12 for i in range(150)}, [0.25] * 4, {"background": 0.5, "nucleosome": 0.2} | {f"m{i}": 0.002 for i in range(150)}))
    assert small.together(5000) == hmm.TOGETHER and 1 < wide.together(100_000) < hmm.TOGETHER and wide.together(10**9) == 1
    assert wide.together(100_000) * 3 * 8 * wide.n * 317 <= hmm.MEMORY


def test_posterior_and_likelihood_come_from_one_pass(spark):
    m, rng = model(), np.random.default_rng(8)
    rows = [(i, "c", 1 + 100 * i, rng.integers(0, 4, 60).tolist(), rng.integers(0, 3, 60).tolist()) for i in (1, 2, 2)]
    df = spark.createDataFrame(rows, "segment_id long, chr string, start long, codes array<int>, long array<int>")
    found = hmm.decode_scored(df, m).collect()
    lls = sorted((r["segment_id"], r["log_likelihood"]) for r in found if r["state"] is None)
    kernel = hmm.Kernel(m)
    want = sorted((r[0], kernel.posterior(np.array(r[3]), {"long": np.array(r[4])})[1]) for r in rows)
    assert np.allclose(lls, want) and len(hmm.decode(df, m).collect()) == len(found) - 3
    assert np.allclose(sorted(tuple(r) for r in hmm.log_likelihoods(df, m).collect()), want)
