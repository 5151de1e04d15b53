"""Vector codes against plain Python, and what partial distances save."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from strandwork.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first)[:entries]]
    size = len(seeds[0]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in seeds] for p in range(parts)]

    def assign(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[assign(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for i, v, label in kept:
        best = [assign(cut(v, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label])
        by[label] += out[-1][2]
    return sorted((str(i), c, e, by[label], digest) for i, c, e, label in out)


def random_rows(seed, n=300, dims=16):
    r = random.Random(seed)
    pool = [[r.choice([-1.5, -0.25, 0.0, 0.125, 0.3, r.uniform(-1, 1)]) for _ in range(dims)] for _ in range(40)]
    rows = [(r.randrange(200), [x + r.choice([0, 0, r.gauss(0, 0.01)]) for x in r.choice(pool)], r.choice([None, 0, 1, 2])) for _ in range(n)]
    odd = [[*[0.0] * (dims - 1), x] for x in (None, math.nan, math.inf, -math.inf)]
    rows += [(500 + k, v, 1) for k, v in enumerate(odd)] + [(600, None, 1), (None, pool[0], None), rows[0], rows[0]]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain_python(spark, seed):
    rows = random_rows(seed)
    got = sorted((str(r[0]), *r[1:]) for r in codes.compress(table(spark, rows)).collect())
    assert got == brute(rows)


def test_fewer_vectors_than_entries_and_nothing(spark):
    rows = random_rows(3, n=5)[:5]
    assert sorted((str(r[0]), *r[1:]) for r in codes.compress(table(spark, rows)).collect()) == brute(rows)
    nothing = codes.compress(spark.createDataFrame([], SCHEMA))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(table(spark, [(1, None, 2), (2, [math.nan] * 8, None)])).count() == 0


def test_other_lengths_have_no_code(spark):
    got = {r["vec_id"]: r for r in codes.compress(table(spark, [(1, [0.5] * 8, 0), (2, [0.5] * 16, 0), (3, [], 0), (4, [0.25] * 8, 0)])).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2]["code"] is None and got[3]["error"] is None and got[4]["error"] == 0
    with pytest.raises(Exception, match="equal parts"):
        codes.compress(table(spark, [(1, [0.5] * 9, 0)])).count()


def test_nearest_is_exact_and_drops_entries():
    r = np.random.default_rng(5)
    book, x = r.integers(-900, 900, (16, 8)), r.integers(-900, 900, (4000, 8))
    x[:50] = book[r.integers(0, 16, 50)]
    book[7] = book[3]  # a tie goes to the lower index
    index, best, terms = codes.nearest(x, book)
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and 7 not in index
    assert terms < 0.75 * x.size * 16


def test_query_and_what_codes_stand_for(spark, data):
    import pandas as pd

    given = pd.read_parquet(f"{data}/embeddings.parquet")
    rows = [(int(i), [float(x) for x in v], None if pd.isna(label) else int(label)) for i, v, label in given[["vec_id", "embedding", "label"]].itertuples(index=False)]
    found = queries.op12_vector_codes(spark, data).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == brute(rows)
    whole = codes.integers(spark.read.parquet(f"{data}/embeddings.parquet"))
    books = codes.fit(whole)
    code = {r["vec_id"]: r for r in found}
    for r in whole.limit(20).collect():
        assert sum((a - b) ** 2 for a, b in zip(r["v"], books.vector(code[r["vec_id"]]["code"]), strict=True)) == code[r["vec_id"]]["error"]
