"""Near copies of the pipeline against whole shingle sets."""

import random

import numpy as np
import pytest
from strandwork.llm import simhash


def grams(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(seed, pool):
    """Texts and copies of them with some words changed, so that most similarities lie between 0.7 and 1."""
    r, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(pool)]
    header = " ".join(r.choice(words) for _ in range(40))
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 8, 60, 300, 900]))]
        text = f"{header} {' '.join(base)}" if r.random() < 0.4 else " ".join(base)
        rows.append(text)
        for _ in range(r.randint(0, 4)):
            w = text.split()
            for _ in range(round(len(w) * r.uniform(0.0, 0.035))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(1000, ""), (1001, None), (1002, " \n")]


def components(sets, low):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and jaccard(sets[a], sets[b]) >= low:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("seed", "block"), [(0, 1024), (1, 4), (2, 1024)])
def test_near_copies_against_similarity(spark, monkeypatch, seed, block):
    """Of the pairs of similarity 0.8 and more, 0.95 are found; whoever is linked is so by chains of such pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = planted(seed, 5000)
    sets = {d: grams(t) for d, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(sets) and all(c <= d for d, c in got.items()) and got[1000] == got[1001] == got[1002] == 1000
    pairs = [(jaccard(sets[a], sets[b]), got[a] == got[b]) for a in sets for b in sets if a < b]
    near = [same for j, same in pairs if j >= 0.8]
    assert len(near) > 20 and sum(near) >= 0.95 * len(near)
    exact = components(sets, 0.8)
    assert all(exact[d] == exact[c] for d, c in got.items())


def test_links_of_a_bucket_are_verified_before_they_are_thinned():
    """Whatever chains of near fingerprints join is joined, by one link less than there are members."""
    r = np.random.default_rng(4)
    for _ in range(30):
        base = r.integers(0, 2**63, (5, 8), dtype=np.uint64)
        fps = base[r.integers(0, 5, 40)]
        for _ in range(40):
            fps ^= (r.random((40, 8)) < 0.5).astype(np.uint64) << r.integers(0, 63, (40, 8), dtype=np.uint64)
        sure, limit = 30, 70
        far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=int)
        links = list(simhash._joined_in(fps, sure, limit))
        assert all(far[a, b] <= (sure if known else limit) for a, b, known in links)
        for most, some in ((sure, [x for x in links if x[2]]), (limit, links)):
            reach = (far <= most).astype(int)
            for _ in range(6):
                reach = (reach @ reach > 0).astype(int)
            n_groups = len({tuple(x) for x in reach.tolist()})
            assert len(some) == 40 - n_groups and all(reach[a, b] for a, b, _ in some)


def test_majorities_count_every_bit():
    r = np.random.default_rng(2)
    for n in (1, 2, 255, 256, 700):
        h = r.integers(0, 2**64, n, dtype=np.uint64)
        want = b"".join(simhash.majority(simhash.mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))).to_bytes(8, "little") for k in range(4))
        assert simhash.majorities(h, 4) == want


def test_stage_drops_planted_copies(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = planted(2, 5000)
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()}
    sets = {d: grams(t) for d, t in rows}
    exact = components(sets, 0.8)
    copies = {d for d in sets if exact[d] < d}
    assert {d for d in sets if exact[d] == d} <= kept and len(copies - kept) >= 0.95 * len(copies)


def test_rows_of_one_document_and_edges(spark, edge, nothing):
    a = " ".join(f"a{i}" for i in range(400))
    rows = [(5, a), (3, a + " end"), (5, a), (9, "other"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 9)}
    kept = simhash.keep_one_near(edge)
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert kept.columns == edge.columns and len(ids) == len(set(ids))
    assert 0 in ids and not {1, 2, 9} & set(ids) and kept.where("doc_id is null").count() == 2
    assert simhash.keep_one_near(nothing).count() == 0


def test_links_do_not_depend_on_the_order_of_rows(spark):
    """A bucket of many fingerprints within the radius gives the same links however its rows come."""
    r = random.Random(3)
    rows = [(7 + (sum(1 << b for b in r.sample(range(32, 62), 3))), i) for i in range(60)]
    rows = list({fp: (fp, i) for fp, i in rows}.values())
    found = []
    for seed, parts in ((1, 1), (2, 3), (3, 7)):
        random.Random(seed).shuffle(rows)
        nodes = spark.createDataFrame(rows, "fp long, node long").repartition(parts)
        found.append({tuple(x) for x in simhash.near_links(nodes, 10, all_within=False).collect()})
    assert found[0] and found[0] == found[1] == found[2]


def linked(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("group", [16 * 1024, 8])
def test_segments_are_looked_up_with_balls(spark, monkeypatch, group):
    """Links join just what meets in a ball of radius one of some segment and lies within the limit as a whole."""
    monkeypatch.setattr(simhash, "GROUP", group)
    sketch, r = simhash.Sketch(), np.random.default_rng(6)
    sure, limit = sketch.limits()
    bits = (r.random((60, 512)) < 0.5)[r.integers(0, 60, 240)]
    bits ^= r.random((240, 512)) < r.uniform(0, 0.16, 240)[:, None]
    bits[:40, :20] = bits[0, :20]  # a segment that texts share which differ elsewhere
    bits[0:40, 3] ^= r.random(40) < 0.5
    bits[200:] = bits[200] ^ (r.random((40, 512)) < 0.01)  # a large group of near copies
    fps = [x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")]
    far = (bits[:, None] != bits[None]).sum(axis=2)
    pieces = bits[:, :500].reshape(240, 25, 20)
    meet = np.array([(pieces[i] != pieces).sum(axis=2).min(axis=1) <= 1 for i in range(240)])
    assert np.array_equal(sketch.cut(fps).reshape(240, 25), pieces @ (1 << np.arange(20)))
    nodes = spark.createDataFrame([(i, fp, x) for i, (fp, x) in enumerate(zip(fps, sketch.cut(fps).reshape(240, 25).tolist(), strict=True))], "node long, fp binary, segments array<int>")
    got = simhash.wide_links(nodes, sketch).collect()
    assert all(far[x["a"], x["b"]] <= (sure if x["sure"] else limit) for x in got)
    asked = np.argwhere(np.triu(meet & (far <= limit), 1)).tolist()
    assert len(asked) > 900 and linked(240, [(x["a"], x["b"]) for x in got]) == linked(240, asked)


def test_balls_name_each_pair_once():
    r = np.random.default_rng(8)
    for n in (1, 2, 50, 400):
        code = np.sort(r.integers(0, 3 << simhash.WIDE_HALF, n))
        got = [(a, b) for x, y in simhash._pairs(*simhash._ball(code), at_once=7) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        same, one = code[:, None] == code, (code[:, None] >> 10 == code >> 10) & (np.bitwise_count(code[:, None] ^ code) == 1)
        assert len({frozenset(x) for x in got}) == len(got) == np.triu(same | one, 1).sum()
        assert all(same[a, b] or one[a, b] for a, b in got)


def test_pairs_at_the_similarity_asked_for(spark):
    """Of pairs with a similarity of just 0.8, 0.98 are found (shared bands of minima found fewer)."""
    r, rows = random.Random(11), []
    for i in range(1500):
        base = [f"v{r.randrange(10**6)}" for _ in range(184)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(x if k % 46 != 40 else "changed" for k, x in enumerate(base)))]
    assert all(jaccard(grams(rows[i][1]), grams(rows[i + 1][1])) == 0.8 for i in range(0, 3000, 2))
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["doc_id"]: x["component_id"] for x in found.collect()}
    assert all(c in (d, d - d % 2) for d, c in got.items())
    assert sum(got[i] == got[i + 1] for i in range(0, 3000, 2)) >= 0.98 * 1500


def written(spark):
    """Bytes that all tasks so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_that_are_no_copies_are_not_shuffled(spark, monkeypatch):
    """What the stage shuffles besides fingerprints does not follow the length of texts that all stay."""
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, sketch: spark.createDataFrame([(0, 1, False), (2, 3, True)], "a long, b long, sure boolean"))
    r, size = random.Random(5), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = [(i, " ".join(f"{r.getrandbits(64):x}" for _ in range(3000))) for i in range(400)]
    rows[1] = (1, rows[0][1] + " end")
    text = sum(len(t) for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    assert docs.count() == 400
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        kept = {x["doc_id"] for x in simhash.keep_one_near(docs).select("doc_id", "text").collect()}
        assert kept == set(range(400)) - {1, 3} and written(spark) - before < text / 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        docs.unpersist()


def test_ids_are_told_by_a_map(spark):
    """No id is missed, few others are taken for one, null is none, and docs are not shuffled."""
    ids = [*range(-500, 500), 2**63 - 1, -(2**63), *(k << 40 for k in range(1, 500))]
    asked = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    docs = asked.unionByName(spark.range(10_000, 110_000).toDF("doc_id")).unionByName(spark.sql("select cast(null as long) doc_id"))
    got = simhash.maybe_among(docs["doc_id"], docs, asked).collect()
    assert len(got) == len(ids) + 100_001 and sorted(x["doc_id"] for x in got if x["maybe"] and x["doc_id"] in set(ids)) == sorted(ids)
    assert [x["maybe"] for x in got if x["doc_id"] is None] == [False] and sum(x["maybe"] for x in got) < len(ids) + 50
    none = simhash.maybe_among(docs["doc_id"], docs, asked.limit(0)).where("maybe")
    assert none.count() == 0


def test_rows_of_a_repeated_doc_id_meet_wherever_they_lie(spark):
    """One row stays of a doc_id whose texts differ, if one of them is the first of its group; other rows stay as they are."""
    docs = spark.createDataFrame([(4, "p q r", 1), (4, "s t u", 2), (7, "s t u", 3), (8, "v w x", 4), (None, "v w x", 5), (9, "v w x", 6)], "doc_id long, text string, row int").repartition(4)
    got = sorted((x["doc_id"] or 0, x["row"]) for x in simhash.keep_one_near(docs).collect())
    assert [d for d, _ in got] == [0, 4, 8] and got[0] == (0, 5) and got[1][1] in (1, 2) and got[2] == (8, 4)


def test_exploded_keys_are_not_broadcast(spark):
    """The rows of all keys are many times the file that Spark sizes them by; neither side of their join goes to the driver."""
    r = random.Random(9)
    rows = [(r.getrandbits(63), i) for i in range(300)]
    rows += [(fp ^ 1 << r.randrange(62), 1000 + i) for fp, i in rows]
    nodes = simhash.materialize(spark.createDataFrame(rows, "fp long, node long"), "nodes")
    links = simhash.near_links(nodes)
    assert {tuple(sorted(x)) for x in links.collect()} == {(i, 1000 + i) for i in range(300)}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("group", [16 * 1024, 16])
def test_pairs_of_thinned_groups_are_all_asked_for(spark, monkeypatch, group):
    """Where the nearest link of two groups is no copy's, their other links are compared too: whoever is alike is joined."""
    sketch, r, n = simhash.Sketch(), np.random.default_rng(12), 300
    sure, limit = sketch.limits()
    bits = (r.random((6, 512)) < 0.5)[r.integers(0, 6, n)]
    bits ^= r.random((n, 512)) < r.choice([0.02, 0.08, 0.1], n)[:, None]
    fps = [x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")]
    far = (bits[:, None] != bits[None]).sum(axis=2)
    pieces = bits[:, :500].reshape(n, 25, 20)
    meet = np.array([(pieces[i] != pieces).sum(axis=2).min(axis=1) <= 1 for i in range(n)])
    alike = lambda a, b: (a * a + b * b) % 23 == 0
    rows = [(i, b"%d" % i, fp, x) for i, (fp, x) in enumerate(zip(fps, sketch.cut(fps).reshape(n, 25).tolist(), strict=True))]
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "sketches", lambda docs, sketch: spark.createDataFrame(rows, "doc_id long, same binary, fp binary, segments array<int>"))
    monkeypatch.setattr(simhash, "similar", lambda pairs, *_: pairs.where("(a * a + b * b) % 23 = 0"))
    docs = spark.createDataFrame([(i, "") for i in range(n)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_copies(docs, sketch).collect()}
    pairs = np.argwhere(np.triu(far <= limit, 1)).tolist()
    joins = [(a, b) for a, b in pairs if far[a, b] <= sure or alike(a, b)]
    asked = [(a, b) for a, b in joins if meet[a, b]]
    assert len(asked) > 100 and all(got[a] == got[b] for a, b in asked)
    whole = linked(n, joins)
    assert len(set(whole)) > 10 and all(whole[i] == whole[got[i]] for i in range(n))
