"""Shards: laws of the contract, evenness, and the planner against plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from strandwork.llm import queries, shards


def check(rows, texts, n=40):
    """texts: list of (doc_id, text). -> loads by shard (bytes, rows), text -> its shards."""
    seen, slots, where, loads = defaultdict(int), defaultdict(list), defaultdict(set), np.zeros((n, 2))
    by_id = defaultdict(list)
    for d, t in texts:
        by_id[d].append(t)
    for r in rows:
        assert r["law"] == "bytes" and 0 <= r["shard"] < n and r["grown_shard"] is None
        match = next(t for t in by_id[r["doc_id"]] if zlib.crc32((t or "").encode()) == r["text_crc32"])
        assert r["size"] == len((match or "").encode()) + 16
        seen[r["doc_id"]] += 1
        slots[r["shard"]].append(r["slot"])
        where[match or ""].add(r["shard"])
        loads[r["shard"]] += r["size"], 1
    assert seen == {d: len(v) for d, v in by_id.items()}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return loads, where


def test_query(spark, data, documents):
    texts = list(zip(documents["doc_id"], documents["text"], strict=True))
    loads, where = check(queries.op13_vector_shards(spark, data).collect(), texts)
    largest = max(len((t or "").encode()) + 16 for _, t in texts)
    assert loads[:, 0].max() - loads[:, 0].min() <= max(largest, 0.1 * loads[:, 0].mean())
    copies = documents["text"].fillna("").value_counts()
    split = [t for t, v in where.items() if len(v) > 1]
    assert all(copies[t] > 1 and copies[t] * (len(t.encode()) + 16) >= 0.5 * loads[:, 0].mean() for t in split)


def test_even_with_a_hot_group_and_long_texts(spark):
    """A third of all rows are copies of one text, and texts differ in bytes for a token."""
    r = np.random.default_rng(0)
    texts = [(i, "the same old words " * 20) for i in range(1500)]
    texts += [(2000 + i, ("漢字" if i % 3 else "and so ") * int(r.integers(1, 160)) + str(i)) for i in range(2800)]
    texts += [(6000 + i, None if i % 2 else "") for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = shards.shard(df, 10).collect()
    loads, where = check(rows, texts, 10)
    assert (np.abs(loads / loads.mean(axis=0) - 1) < 0.05).all()
    tokens = np.bincount([x["shard"] for x in rows], [x["tokens"] for x in rows])
    assert (np.abs(tokens / tokens.mean() - 1) < 0.05).all()
    assert [t for t, v in where.items() if len(v) > 1] == ["the same old words " * 20]


def test_edges(spark, edge, nothing):
    got = shards.shard(edge, 3)
    assert got.count() == edge.count()
    by = defaultdict(list)
    for r in got.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.shard(nothing, 3).count() == 0


def test_items_go_where_the_dot_product_is_highest():
    r = np.random.default_rng(1)
    items = r.random((60, 3)) ** 3
    items *= 5 / items.sum(axis=0)
    left, want = np.ones((5, 3)), {}
    for i in sorted(range(60), key=lambda i: -items[i].max()):
        fits = [s for s in range(5) if all(left[s][j] - items[i][j] >= -1e-9 for j in range(3))]
        fits = fits or [s for s in range(5) if left[s][0] - items[i][0] >= -1e-9]
        if fits:
            s = max(fits, key=lambda s: sum(w * a * b for w, a, b in zip((1, 0.2, 0.2), items[i], left[s], strict=True)))
        else:
            s = max(range(5), key=lambda s: left[s][0] - items[i][0])
        want[i], left[s] = s, left[s] - items[i]
    assert shards.assign(items, 5).tolist() == [want[i] for i in range(60)]


def test_plan_is_the_same_for_any_partitioning(spark, documents):
    some = pd.DataFrame(documents[["doc_id", "text"]])
    found = [sorted((x["doc_id"], x["shard"]) for x in shards.shard(spark.createDataFrame(some).repartition(k), 7).collect()) for k in (1, 4)]
    assert found[0] == found[1]
