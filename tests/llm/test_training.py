"""Packing, chat formatting, training order, and the pipeline."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from strandwork.llm import chat, materialise, packing, queries, simhash
from strandwork.llm.tokens import default_paths, encoder, small_ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_paths()[0])


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_fast_ids_are_the_tokenizers(tokenizer, documents):
    encode = encoder(*default_paths())
    odd = ["<|endoftext|> x", "é　   \n\n x ", "don't I'LL 12345 ½ 漢字🎉", "", " ", "\x00\x1f", "a" * 3000]
    for text in [*documents["text"].dropna().head(80), *odd]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def packed_well(rows, texts, tokenizer, size=1024):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for d, text in texts.items():
        ids, at = ids_of(tokenizer, text), 0
        total += len(ids)
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(bins), -(-total // size)


def test_packing_query(spark, data, documents, tokenizer):
    texts = dict(zip(documents["doc_id"], documents["text"], strict=True))
    n, least = packed_well(queries.op4_best_fit_packing(spark, data).collect(), texts, tokenizer)
    assert n <= 1.02 * least + 1


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(docs=4, weights=(1, 1, 0)), packing.Capacity(cost=30, weights=(1, 0, 1), rule="dot")])
def test_plans_hold_every_capacity(capacity):
    r = random.Random(3)
    for _ in range(20):
        counts = {r.randint(1, 540): r.randint(1, 40) for _ in range(r.randint(1, 40))}
        bins, ranks = defaultdict(list), defaultdict(set)
        for length, first, n, each, start, offset in packing.plan_bins(counts, capacity):
            for i in range(n):
                bins[start + i // each].append((offset + i % each * length, length))
                ranks[length].add(first + i)
        assert {k: len(v) for k, v in ranks.items()} == counts and all(v == set(range(len(v))) for v in ranks.values())
        tokens, docs, cost = capacity.limits()
        for parts in bins.values():
            assert sum(x for _, x in parts) <= tokens and len(parts) <= docs and sum(capacity.cost_of(x) for _, x in parts) <= cost
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length


def test_all_three_capacities_choose(documents, tokenizer):
    """Limits of documents and cost bind where they are asked for; the default chooses other bins than tokens alone, and
    stays near the bound."""
    capacity, plain = packing.Capacity(docs=24, cost=65), packing.Capacity(docs=None, cost=10**9, weights=(1, 0, 0))

    def bins(counts, c):
        out = defaultdict(list)
        for length, _, n, each, start, _ in packing.plan_bins(counts, c):
            for i in range(n):
                out[start + i // each].append(length)
        return list(out.values())

    cost = lambda b: sum(map(capacity.cost_of, b))
    some, limits = {1000: 4, 12: 8, 1: 60}, capacity.limits()
    assert max(map(len, bins(some, capacity))) <= limits[1] < max(map(len, bins(some, plain)))
    assert max(map(cost, bins(some, capacity))) <= limits[2] < max(map(cost, bins(some, plain)))
    counts = defaultdict(int)
    for text in documents["text"]:
        n = len(ids_of(tokenizer, text))
        counts[(n - 1) % 1024 + 1] += 1
        counts[1024] += (n - 1) // 1024
    counts = {k: v for k, v in counts.items() if v}
    mine = bins(counts, packing.Capacity())
    assert sorted(map(sorted, mine)) != sorted(map(sorted, bins(counts, plain)))
    assert len(mine) <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 2


@pytest.mark.parametrize("counts", [{10: 100_000}, {1: 100_000}, {1024: 40_000, 3: 5000}, {k: 300 for k in range(1, 500)}, {900: 500, 100: 700, 24: 400, 2: 9000}])
def test_default_costs_no_sequences(counts):
    """Short, mixed and long histograms: documents and cost never take more sequences than tokens ask for."""
    n = max(start + ranks // each for _, _, ranks, each, start, _ in packing.plan_bins(counts, packing.Capacity()))
    assert n <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 1


def test_packing_edges(spark, edge, nothing, tokenizer):
    rows = packing.pack(edge).collect()
    size = sum(len(ids_of(tokenizer, r["text"])) for r in edge.select("text").collect())
    assert sum(r["length"] for r in rows) == size and packing.pack(nothing).count() == 0


CALLS = [
    (1, 0, "system", {"content": "hi", "tools": [{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}]}),
    (1, 1, "user", "q"),
    (1, 2, "assistant", {"content": "ok", "tool_calls": [
        {"id": "y", "name": "add", "arguments": {"b": 1, "a": "${x}"}},
        {"id": "x", "name": "add", "arguments": '{"a": 2.0}'},
        {"id": "c1", "name": "z", "arguments": {}, "depends_on": ["c2"]},
        {"id": "c2", "name": "z", "arguments": {}, "depends_on": ["c1"]},
    ]}),
    (1, 4, "tool", {"tool_call_id": "x", "content": "2"}),
    (1, 3, "tool", {"tool_call_id": "y", "content": {"v": 1}}),
    (1, 4, "tool", {"tool_call_id": "x", "content": "3"}),
    (1, 5, "assistant", "end"),
    (2, 0, "tool", {"tool_call_id": "q", "content": "early"}),
    (2, 1, "assistant", {"tool_calls": [{"id": "q", "name": "add", "arguments": {}}]}),
    (None, 0, "user", None),
    (None, None, "user", "a"),
    (None, None, "user", "a"),
    (3, 0, None, "{broken"),
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(c, t, r, json.dumps(x) if isinstance(x, dict) else x, 1, "x", 2) for c, t, r, x in CALLS]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int, id string, kind int")


def test_linked_calls(messages):
    rows = sorted(chat.link(messages).where("conv_id = 1").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(11))
    order = [(r["kind"], r["id"]) for r in rows]
    assert order.index(("call", "x")) < order.index(("result", "x")) < order.index(("call", "y")) < order.index(("result", "y"))
    said = {r["id"]: (r["linked"], r["valid"]) for r in rows if r["kind"] == "call"}
    assert said == {"x": (True, "ok"), "y": (True, "$.a: not of type integer"), "c1": (False, "cycle"), "c2": (False, "cycle")}
    assert next(r["json"] for r in rows if r["id"] == "x") == '{"arguments":{"a":2},"id":"x","name":"add","role":"assistant"}'
    assert sorted(r["linked"] for r in rows if r["kind"] == "result") == [False, True, True]


def test_late_calls_nulls_and_parts(messages):
    whole = {r["conv_id"]: r for r in chat.format_chats(messages).collect()}
    assert [json.loads(whole[2]["json"])[i]["role"] for i in (0, 1)] == ["assistant", "tool"]
    assert whole[None]["n_events"] == 3 and json.loads(whole[3]["json"]) == [{"content": "{broken", "role": None}]
    parts = sorted(chat.format_chats(messages, part_events=4).where("conv_id = 1").collect(), key=lambda r: r["part"])
    assert [r["n_events"] for r in parts] == [4, 4, 3] and sum((json.loads(r["json"]) for r in parts), []) == json.loads(whole[1]["json"])
    assert chat.format_chats(messages.limit(0)).count() == 0


def test_a_long_chain_of_calls(spark):
    calls = [{"id": str(i), "name": "f", "arguments": {}, "depends_on": [str(i - 1)] * (i > 0)} for i in range(12)]
    random.Random(0).shuffle(calls)
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls}))] + [(1, 1, "tool", json.dumps({"tool_call_id": str(i), "content": i})) for i in range(12)]
    tools = spark.createDataFrame([("f", '{"type": "object", "additionalProperties": false}')], "name string, schema string")
    found = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).orderBy("position").collect()
    assert [r["id"] for r in found] == [str(i // 2) for i in range(24)] and {r["valid"] for r in found if r["kind"] == "call"} == {"ok"}


def linked_by_hand(rows):
    """(position, kind, id, linked, valid) of each event of each conversation, one event after the other in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        events = [(t, *e) for c, t, r, x in rows if c == conv for e in chat.parse(r, x)]
        key = lambda e: (e[0], e[2], e[7])
        uses = {}
        for kind in (chat.CALL, chat.RESULT):
            for i in sorted((i for i, e in enumerate(events) if e[1] == kind and e[3] is not None), key=lambda i: key(events[i])):
                uses.setdefault((kind, events[i][3]), []).append(i)
        result = {c: r for (k, x), cs in uses.items() if k == chat.CALL for c, r in zip(cs, uses.get((chat.RESULT, x), []), strict=False)}
        needs = {}
        for i, e in enumerate(events):
            for x in e[6] or [] if e[1] == chat.CALL else []:
                there = uses.get((chat.CALL, x), [])
                if x == e[3]:
                    needs.setdefault(i, []).append(there[max(0, there.index(i) - 1)])
                elif there:
                    needs.setdefault(i, []).append(([j for j in there if events[j][0] <= e[0]] or there[:1])[-1])
        placed, more = {}, True
        while more:
            more = False
            for i, e in enumerate(events):
                if e[1] == chat.CALL and i not in placed and all(j in placed for j in needs.get(i, [])):
                    level = 1 + max((placed[j][0] for j in needs.get(i, [])), default=-1)
                    at = max([e[0], *(placed[j][2] for j in needs.get(i, []))])
                    placed[i], more = (level, at, max(at, events[result[i]][0]) if i in result else at), True
        order = []
        call_of = {r: c for c, r in result.items()}
        for i, e in enumerate(events):
            level, at, _ = placed.get(call_of.get(i, i), (0, e[0], None))
            order.append((max(e[0], at), 0 if e[1] == chat.MESSAGE else 2 * level + e[1], *key(e), i))
        for p, (*_, i) in enumerate(sorted(order)):
            e = events[i]
            called = e[1] == chat.CALL
            linked = None if e[1] == chat.MESSAGE else i in result or i in call_of
            out[conv, p] = (e[7], linked, ("no_schema" if i in placed else "cycle") if called else None)
    return out


@pytest.mark.parametrize("most", [100_000, 12])
def test_thousands_of_random_calls(spark, monkeypatch, most):
    """Ids used again, missing results, forward needs, cycles: against plain Python; also when components pass a task's bound."""
    rng = random.Random(most)
    rows = []
    for conv in range(40 if most > 12 else 4):
        ids = [f"c{i}" for i in range(rng.choice([4, 12, 60]))]
        for turn in range(rng.randint(2, 30)):
            calls = []
            for _ in range(rng.randint(0, 5)):
                near = [x for x in rng.sample(ids, min(len(ids), 3)) if rng.random() < 0.25]
                calls.append({"id": rng.choice(ids), "name": "f", "arguments": {"n": rng.random(), "of": [f"${{{x}}}" for x in near[:1]]}, "depends_on": near[1:]})
            rows.append((conv, turn, "assistant", json.dumps({"content": rng.choice(["a", "b"]), "tool_calls": calls})))
            rows += [(conv, turn + rng.randint(0, 2), "tool", json.dumps({"tool_call_id": c["id"], "content": rng.random()})) for c in calls if rng.random() < 0.8]
    monkeypatch.setattr(chat.order_calls, "__defaults__", (most,))
    found = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = linked_by_hand(rows)
    assert {(r["conv_id"], r["position"]): (r["json"], r["linked"], r["valid"]) for r in found} == want
    assert most == 12 or sum(x[1] is not None for x in want.values()) > 1500


def test_ids_used_in_every_turn(spark):
    rows = [(c, 2 * t + k, ["assistant", "tool"][k], json.dumps([{"tool_calls": [{"id": "call_0", "name": "f", "arguments": {}, "depends_on": ["call_0"] * (t > 0)}]}, {"tool_call_id": "call_0", "content": t}][k])) for c in (7, None) for t in range(50) for k in (0, 1)]
    found = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "position").collect()
    assert all(r["linked"] and r["valid"] in (None, "no_schema") for r in found) and [r["turn"] for r in found] == 2 * list(range(100))


def test_chat_query(spark, data):
    import pandas as pd

    table = pd.read_parquet(f"{data}/conversations.parquet").sort_values(["conv_id", "turn"])
    want = {c: [{"content": t, "role": r} for r, t in zip(g["role"], g["text"], strict=True)] for c, g in table.groupby("conv_id")}
    assert {r["conv_id"]: json.loads(r["json"]) for r in queries.op5_chat_formatting(spark, data).collect()} == want


def test_schemas():
    schema = {"type": "object", "properties": {"n": {"type": ["integer", "null"], "minimum": 1, "maximum": 3}, "s": {"enum": ["a", 1]}, "l": {"items": {"type": "string", "minLength": 2}, "maxItems": 2}}, "additionalProperties": False}
    good = [{}, {"n": 2}, {"n": None}, {"n": 3.0, "s": 1}, {"l": ["ab"]}]
    bad = [[], {"n": 0}, {"n": 4}, {"n": 1.5}, {"n": True}, {"s": "b"}, {"l": ["a"]}, {"l": ["ab"] * 3}, {"x": 1}]
    assert not any(chat.violation(x, schema) for x in good) and all(chat.violation(x, schema) for x in bad)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = materialise.Permutation(n, "k")
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.numbers(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != materialise.Permutation(n, "other").slots(np.arange(n))).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def stored(spark, path):
    """The sequences in the stream's order, without what fills the last one up."""
    rows = spark.read.parquet(f"{path}/stream").orderBy("file", "split", "k").collect()
    return np.concatenate([np.frombuffer(r["ids"], "<u2") for r in rows]) if rows else np.empty(0, "<u2")


def test_shards(spark, data, documents, tokenizer, tmp_path):
    docs, path = spark.read.parquet(f"{data}/documents.parquet"), f"file://{tmp_path}/order"
    layout = materialise.write(docs, path, tokens=256, per_shard=100, key="k")
    want = [x for t in documents["text"] for x in ids_of(tokenizer, t)]
    assert stored(spark, path).tolist() == want and layout.n == -(-len(want) // 256)
    want = np.array(want + [2] * (layout.n * 256 - len(want)), "<u2").reshape(-1, 256)
    slots = materialise.Permutation(layout.n, "k").slots(np.arange(layout.n))
    rows = {r["slot"]: r for r in materialise.read(spark, path).collect()}
    assert sorted(rows) == list(range(layout.n))
    for i, s in enumerate(slots.tolist()):
        assert bytes(rows[s]["ids"]) == want[i].tobytes() and (rows[s]["shard"], rows[s]["byte_offset"]) == layout.place(s)
    for f in (tmp_path / "order" / "shards").glob("shard=*/*.txt"):
        shard = int(f.parent.name[6:])
        assert f.stat().st_size == layout.length(shard)
        assert f.read_bytes()[: 2 * 256] == bytes(rows[shard * 100]["ids"])
    assert {r["slot"]: r["sequence"] for r in materialise.index(spark, path).collect()} == {s: i for i, s in enumerate(slots.tolist())}
    late = materialise.read(spark, path, 250)
    (tmp_path / "order" / "shards" / "shard=0").joinpath(next((tmp_path / "order" / "shards" / "shard=0").glob("*.txt")).name).write_bytes(b"lost")
    assert sorted(r["slot"] for r in late.collect()) == list(range(250, layout.n))
    assert sorted(r["slot"] for r in materialise.read(spark, path, 250).collect()) == list(range(250, layout.n))


def test_the_order_does_not_depend_on_splits(spark, documents, tmp_path):
    for i in range(3):
        (tmp_path / "d").mkdir(exist_ok=True)
        documents.iloc[i::3].to_parquet(f"{tmp_path}/d/part-{i}.parquet", row_group_size=7)
    found, files = [], spark.read.parquet(f"{tmp_path}/d")
    for k, size in enumerate(("64m", "20k", "8k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            materialise.write(files, f"file://{tmp_path}/{k}", tokens=64, per_shard=50)
            found.append(sorted(materialise.index(spark, f"file://{tmp_path}/{k}").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    splits = [spark.read.parquet(f"{tmp_path}/{k}/stream").select("file", "split").distinct().count() for k in range(3)]
    assert splits[0] < splits[1] < splits[2] and found[0] == found[1] == found[2]
    # Rows that don't come straight from files are ordered by doc_id, however they are dealt.
    other = []
    for k, n in enumerate((3, 5)):
        materialise.write(files.repartition(n, "text"), f"file://{tmp_path}/r{k}", tokens=64, per_shard=50)
        other.append(sorted(materialise.index(spark, f"file://{tmp_path}/r{k}").collect()))
    assert other[0] == other[1] and len(other[0]) == len(found[0])


def test_large_ids_raise():
    assert small_ids(np.array([0, 65535], np.uint32)).tolist() == [0, 65535]
    with pytest.raises(ValueError):
        small_ids(np.array([65536], np.uint32))


def test_an_interrupted_write_goes_on(spark, data, tmp_path):
    docs, path = spark.read.parquet(f"{data}/documents.parquet").limit(60), f"file://{tmp_path}/order"
    materialise.write(docs, path, tokens=64, per_shard=50, key="k")
    files = sorted((tmp_path / "order" / "shards").glob("shard=*/*.txt"))
    before = {f.parent.name: f.read_bytes() for f in files}
    files[0].unlink()
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    kept = files[1].stat().st_mtime_ns
    materialise.write(docs, path, tokens=64, per_shard=50, key="k")
    assert {f.parent.name: f.read_bytes() for f in (tmp_path / "order" / "shards").glob("shard=*/*.txt")} == before
    assert files[1].stat().st_mtime_ns == kept


def test_order_edges(spark, edge, nothing, tmp_path, tokenizer):
    layout = materialise.write(edge, f"file://{tmp_path}/e")
    total = sum(len(ids_of(tokenizer, r["text"])) for r in edge.select("text").collect())
    assert len(stored(spark, f"{tmp_path}/e")) == total
    assert materialise.read(spark, f"file://{tmp_path}/e").count() == layout.n
    assert materialise.write(nothing, f"file://{tmp_path}/n").n == 0 and materialise.read(spark, f"file://{tmp_path}/n").count() == 0


def test_pipeline(spark, data, documents, tokenizer):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), {}
    planted = (10**6, " ".join(documents["text"][0].split()[::-1]) + " token=abcdef123456", documents["lang"][0], "x", 1)
    docs = docs.unionByName(spark.createDataFrame([planted], docs.schema))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
            docs = spark.read.parquet(path)
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(seen[name]) == docs.count()
    assert len({simhash.fingerprint(t) for t in seen["near_dedup"].values()}) == len(seen["near_dedup"])
    assert set(seen["decontamination"]) < set(seen["near_dedup"]) and len(seen["language_id"]) > 0.9 * len(documents)
    before, after = seen["decontamination"], seen["secret_scan"]
    assert set(after) == set(before) and all(("[SECRET]" in after[d]) == (after[d] != before[d]) for d in after)
    assert after[10**6].endswith(" [SECRET]")
    packed_well(out.collect(), after, tokenizer)
    assert {r["doc_id"] for r in pipeline.run(spark, data).select("doc_id").distinct().collect()} == set(after) - {10**6}
