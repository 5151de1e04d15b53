"""The prefix trie against whole lists of turns in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from strandwork.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, d int, names string, k int"


def words(text):
    return len(text.encode().split())


def brute(convs):
    """conv_id -> list of (role, text) -> rows as the contract wants them."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = set()

    def below(k):
        todo = [k]
        while todo:
            at = todo.pop()
            yield at
            todo += kids[at]

    for k, who in members.items():
        tree = list(below(k))
        saved = sum((len(members[v]) - 1) * words(v[-1][1]) for v in tree if v)
        ends = ",".join(str(c) for c in who if len(convs[c]) == len(k))
        parent = members[k[:-1]][0] if k else None
        out.add((who[0], len(k), parent, len(who), len(kids[k]), sum(not kids[v] for v in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: h[c]] + convs[c][h[c] :] for c in convs}


def lists(rows):
    out = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=key):
        out[c].append((role or "", text or ""))
    return dict(out)


def random_rows(seed, n=120, longest=40):
    r, rows = random.Random(seed), []
    said = ["", None, "a b", "a  b", "one", "tab\tand\x0bmore  x", "é 漢字", "hello there you"]
    for c in range(n):
        base = [(r.choice(["user", "assistant", None, ""]), r.choice(said)) for _ in range(r.choice([1, 2, 3, 5, 8, longest]))] if c % 3 or not rows else base  # noqa: F821
        for t, (role, text) in enumerate(base[: r.randint(1, len(base))]):
            rows.append((c + 7, t if r.random() < 0.97 else None, role, text))
    rows += [rows[3], rows[3], (None, 0, "user", "nobody"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def found(df):
    rows = df.collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "piece"), [(0, 4096), (1, 3)])
def test_against_whole_lists(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, *[None] * 4) for r in rows], SCHEMA).repartition(3)
    assert found(trie.trie(df)) == brute(lists(rows))
    turns, convs = trie.with_shared_openings(trie.turns_of(df))
    assert found(trie.nodes(turns, convs)) == brute(rebuilt(lists(rows)))


def test_long_and_equal_conversations(spark):
    """One conversation of 700 turns, many that are equal, and a first turn that most share."""
    rows = [(5, t, "user", f"x{t % 7}") for t in range(700)]
    rows += [(c, t, "user", f"x{t}") for c in range(10, 300) for t in range(2)]
    df = spark.createDataFrame([(*r, *[None] * 4) for r in rows], SCHEMA)
    assert found(trie.trie(df)) == brute(lists(rows))


def test_query_and_nothing(spark, data):
    import pandas as pd

    table = pd.read_parquet(f"{data}/conversations.parquet")
    convs = lists(list(table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))
    assert found(queries.op11_prefix_trie(spark, data)) == brute(rebuilt(convs))
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turnless_conversations(spark):
    """Without its host a conversation may lose all turns; it is still a member of the root."""
    rows = [(c, 0, "user", f"t{c}") for c in range(21, 40)]
    turns, convs = trie.with_shared_openings(trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    lost = {c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4}
    got = found(trie.nodes(turns, convs))
    root = next(r for r in got if r[1] == 0)
    assert got == brute(rebuilt(lists(rows))) and lost and root[3] == 19
    assert root[7] == hashlib.sha256(",".join(map(str, sorted(lost))).encode()).hexdigest()


def test_names_are_dense(spark):
    rows = spark.createDataFrame([(i % 50, i % 3) for i in range(900)], "a long, b long").repartition(6)
    names = [r["name"] for r in trie.dense_names(rows, ["a", "b"], "t").collect()]
    assert sorted(names) == list(range(150))
