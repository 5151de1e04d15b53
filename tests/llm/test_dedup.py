"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from strandwork.llm import queries, simhash, substring
from strandwork.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates_query(spark, data, documents):
    fps = {int(d): fingerprint(t) for d, t in zip(documents["doc_id"], documents["text"], strict=True)}
    want = components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dup(spark, data).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


@pytest.mark.parametrize(("seed", "block"), [(0, 1024), (1, 8)])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, seed, block):
    """Clusters with flips in any bits, chains, and one large group around one key, in whole and in split buckets."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(seed)
    fps = set()
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            fps.add(x)
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
    hub = r.getrandbits(64)
    fps |= {hub ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for _ in range(120)}
    fps = {i: x for i, x in enumerate(sorted(fps))}
    rows = [(int(np.uint64(x).view(np.int64)), i) for i, x in fps.items()]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, node long"))
    pairs = [(x["a"], x["b"]) for x in links.collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)
    roots = {x["node"]: x["root"] for x in connected_components(links).collect()}
    assert {d: roots.get(d, d) for d in fps} == components(fps)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_duplicate_edges(spark, edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == 0 and by[2]["component_id"] == 0
    assert by[9]["component_id"] == 8 and by[None]["component_id"] is None
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 9 not in ids and kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(nothing).count() == simhash.keep_one(nothing).count() == 0


def removed(rows):
    first, out = {}, {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("seed", "size"), [(0, 2), (1, 5), (2, 40)])
def test_passages_of_small_vocabularies(spark, seed, size):
    """Runs, periods and passages that overlap in part."""
    r, words = random.Random(seed), [f"w{i}" for i in range(size)]
    pool = [[r.choice(words) for _ in range(r.randint(45, 130))] for _ in range(12)]
    rows = []
    for d in range(100):
        out = []
        for _ in range(r.randint(0, 4)):
            kind = r.random()
            if kind < 0.5:
                p = r.choice(pool)
                out += p[r.randint(0, 20) : len(p) - r.randint(0, 20)]
            elif kind < 0.7:
                out += [r.choice(words)] * r.randint(1, 80)
            elif kind < 0.8:
                out += words[:2] * r.randint(1, 50)
            else:
                out += [r.choice(words) for _ in range(r.randint(1, 90))]
        rows.append((d, " ".join(out)))
    got = substring.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in got} == removed(rows)


def test_passages_query(spark, data, documents):
    want = removed([(int(d), t) for d, t in zip(documents["doc_id"], documents["text"], strict=True)])
    for r in queries.op3_substring_dedup(spark, data).collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_passages_edges(spark, edge, nothing):
    rows = substring.remove(edge).collect()
    assert len(rows) == edge.count() and sum(r["n_removed"] for r in rows) == 0
    assert substring.remove(nothing).count() == 0
