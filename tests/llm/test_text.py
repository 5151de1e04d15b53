"""Language ID, quality rules and benchmark passages."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard as zstd
from strandwork.llm import decontam, langid, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_accuracy_on_held_out_rows(spark, data, documents):
    rows = {r["doc_id"]: r for r in queries.op1_language_id(spark, data).collect()}
    assert len(rows) == len(documents)
    hits = []
    for d, lang, text in zip(documents["doc_id"], documents["lang"], documents["text"], strict=True):
        assert rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= rows[d]["score"] <= 1
        if rows[d]["held_out"] and lang and len((text or "").split()) >= 10:
            hits.append(rows[d]["lang_pred"] == lang)
    assert np.mean(hits) >= 0.95


def test_only_the_text_counts(spark, documents):
    some = documents.head(60)
    df = spark.createDataFrame(some[["doc_id", "text", "lang"]])
    model = langid.fit(df)
    one = {r["doc_id"]: r["lang_pred"] for r in langid.classify(df.select("doc_id", "text"), model).collect()}
    moved = df.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang")
    assert {r["doc_id"] - 1000: r["lang_pred"] for r in langid.classify(moved, model).collect()} == one


def test_sizes_margins_and_rejections_by_hand(spark, data, documents):
    """Each block compressed on its own by zstandard, called plainly; it gives the block back, so the size is that of all of it."""
    given = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model, some = langid.fit(given), documents.head(80)
    params = zstd.ZstdCompressionParameters(window_log=18, hash_log=15, chain_log=15, search_log=3, min_match=3, strategy=zstd.STRATEGY_BTOPT, write_content_size=False)
    rows = {r["doc_id"]: r for r in langid.classify(given.where(f"doc_id in ({', '.join(map(str, some['doc_id']))})"), model).collect()}
    for d, text in zip(some["doc_id"], some["text"], strict=True):
        row = rows[d]
        if not text or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"], row["rejected"]) == ("und", 0.0, True)
            continue
        raw, size = text.lower().encode(), {}
        for lang, known in model.items():
            words, size[lang] = zstd.ZstdCompressionDict(known, dict_type=zstd.DICT_TYPE_RAWCONTENT), 0
            for i in range(0, len(raw), 4096):
                packed = zstd.ZstdCompressor(dict_data=words, compression_params=params).compress(raw[i : i + 4096])
                assert zstd.ZstdDecompressor(dict_data=words).decompress(packed, max_output_size=4096) == raw[i : i + 4096]
                size[lang] += len(packed)
        best = min(size, key=lambda lang: (size[lang], lang))
        second = min(n for lang, n in size.items() if lang != best)
        assert row["lang_pred"] == best and row["score"] == pytest.approx((second - size[best]) / second)
        assert row["rejected"] == ((second - size[best]) / second < 0.001)


def test_languages_that_tie(spark):
    """Two languages of one dictionary: the first by name, no margin, rejected."""
    df = spark.createDataFrame([(1, "the same words again")], "doc_id long, text string")
    row = langid.classify(df, {"aa": b"the same words ", "bb": b"the same words "}).first()
    assert (row["lang_pred"], row["score"], row["rejected"]) == ("aa", 0.0, True)


def test_language_edges(spark, edge, nothing):
    model = langid.fit(edge)
    rows = langid.classify(edge, model)
    assert rows.count() == edge.count() and set(edge.columns) <= set(rows.columns)
    by = {r["doc_id"]: r for r in rows.collect()}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[10]["lang_pred"] == "und" and by[1]["rejected"]
    assert langid.fit(nothing) == {} and langid.classify(nothing, {}).count() == 0
    assert {r["lang_pred"] for r in langid.classify(edge, {}).collect()} == {"und"}


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_query(spark, data, documents):
    rows = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, data).collect()}
    for d, t in zip(documents["doc_id"], documents["text"], strict=True):
        n = counts(t)
        assert tuple(rows[d][c] for c in quality.COUNTS) == n
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert rows[d]["base_failed"] == failed and not (failed and rows[d]["kept"])


def test_rules_are_learned_in_order_and_pruned():
    rng = np.random.default_rng(0)
    x = {"words": rng.uniform(0, 100, 3000), "upper": rng.uniform(0, 1, 3000), "digits": rng.uniform(0, 1, 3000)}
    bad = (x["words"] < 20) | ((x["upper"] > 0.7) & (x["digits"] > 0.5))
    bad ^= rng.uniform(size=3000) < 0.02
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= rule.on(x)
    assert rules and (hit & bad).sum() >= 0.85 * bad.sum() and (hit & ~bad).sum() <= 0.06 * (~bad).sum()
    assert quality.learn(x, rng.uniform(size=3000) < 0.3) == []


def test_rules_as_expressions(spark):
    rules = [quality.Rule([("words", "<=", 5.0)]), quality.Rule([("digits", ">", 0.5), ("words", ">", 5.0)])]
    df = spark.createDataFrame([(3, 10, 0), (9, 10, 9), (9, 10, 1)], "n_words long, word_chars long, n_digits long")
    assert [r[0] for r in df.select(quality.decision(rules)).collect()] == [False, False, True]


def test_quality_edges(spark, edge, nothing):
    none = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    rows = quality.judge(edge, none).collect()
    assert len(rows) == edge.count()
    assert all(tuple(r[c] for c in quality.COUNTS) == (0, 0, 0, 0, 0) for r in rows if r["doc_id"] in (0, 1))
    assert quality.judge(nothing, none.limit(0)).count() == 0


def hits_by_hand(documents, items, overlap=0.8):
    """Items of whose 5-word shingles enough are in a text; the operator also has to retrieve them."""
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    split = {i: decontam.normal_words(t) for i, t in items}
    for d, t in documents:
        w = decontam.normal_words(t)
        for i, v in split.items():
            k = min(5, len(v))
            want = shingles(v, k)
            if want and len(want & shingles(w, k)) >= overlap * len(want):
                out.add((d, i))
    return out


def asked_and_said(text, item):
    """Half of the question's shingles and half of the answer's words are in the text."""
    question, answer = map(decontam.normal_words, decontam.question_and_answer(item))
    words, k = decontam.normal_words(text), min(5, len(question))
    shingles = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    asked = not k or 2 * len(shingles(question) & shingles(words)) >= len(shingles(question))
    return asked and 2 * len(set(answer) & set(words)) >= len(set(answer))


def test_benchmark_query(spark, data, documents):
    import pandas as pd

    items = pd.read_parquet(f"{data}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in queries.op6_benchmark_decontamination(spark, data).collect()}
    want = hits_by_hand(documents[["doc_id", "text"]].itertuples(index=False), list(items[["item_id", "text"]].itertuples(index=False)))
    assert found == want and found


def test_benchmark_shards_and_drop(spark, data, documents):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    small = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items, max_bytes=2000).collect()}
    assert whole == small
    kept = decontam.drop(docs, items)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(documents["doc_id"]) - {d for d, _ in whole}


@pytest.mark.parametrize("mode", ["upper", "punctuation", "inside"])
def test_benchmark_passages_in_disguise(spark, data, mode):
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first()
    text = {"upper": item["text"].upper(), "punctuation": re.sub(" ", " - ", item["text"]), "inside": "x y z " * 500 + item["text"] + " q r" * 700}[mode]
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame([item]))
    assert [(r["doc_id"], r["item_id"]) for r in found.collect()] == [(1, item["item_id"])]


@pytest.mark.parametrize("seed", range(6))
def test_pivots_find_every_unit(seed, threshold=0.5):
    import random

    import numpy as np

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40 * (seed + 1))]
    some = lambda n: rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n)
    items = [(i, " ".join(some(rng.randint(1, 150)))) for i in range(60)]
    index = decontam.Index(items, threshold)
    term_of = np.repeat(np.arange(len(index.terms)), np.diff(index.first))
    for _ in range(60):
        part = rng.choice(items)[1].split()
        asked = {index.terms[w] for w in rng.sample(part, len(part) * rng.randint(4, 10) // 10) + some(40) if w in index.terms}
        score = np.bincount(np.array(index.unit), np.array(index.share) * np.isin(term_of, list(asked)))
        units, scores = index.retrieve(np.array(sorted(asked), int))
        assert units == np.flatnonzero(score >= threshold - 1e-9).tolist() and np.allclose(scores, score[units])


def test_pivots_skip_postings():
    """A passage that shares rare words with one item alone reads few of the postings of its frequent words."""
    import numpy as np

    class Read(list):
        n = 0

        def __getitem__(self, i):
            Read.n += 1
            return super().__getitem__(i)

    items = [(i, f"the of and a to {' '.join(f'r{i}x{k}' for k in range(12))}") for i in range(4000)]
    index = decontam.Index(items, 0.5)
    index.share = Read(index.share)
    asked = decontam.normal_words(items[1234][1])
    units, _ = index.retrieve(np.array(sorted(index.terms[w] for w in asked)))
    assert units == [1234] and Read.n < 40


@pytest.mark.parametrize("share", [0.85, 0.9, 1.0])
def test_recall_of_scattered_and_edited_items(spark, data, share):
    """A piece of each item of that share of its words, some edited, within other text: found if the overlaps say so."""
    import random

    rng = random.Random(7)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    fill = [f"fill{i}" for i in range(300)]
    rows = []
    for i, text in items:
        words = text.split()
        cut = rng.randint(0, int(len(words) * (1 - share)))
        words = words[cut : cut + round(len(words) * share)]
        for k in rng.sample(range(len(words)), len(words) // 60):
            words[k] = "edited"
        rows.append((len(rows), " ".join(rng.choices(fill, k=rng.randint(0, 400)) + words + rng.choices(fill, k=rng.randint(0, 400))), *[None] * 3))
    want = {(d, i) for d, i in hits_by_hand([r[:2] for r in rows], items) if asked_and_said(rows[d][1], dict(items)[i])}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= want and len(found) >= 0.9 * len(want) and len(want) >= 0.5 * len(items)


def test_benchmark_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, None), (None, "x"), (3, ""), (4, "same words in both rows here"), (5, "same words in both rows here"), (6, "one")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(edge, items).collect()}
    assert {(8, 4), (8, 5), (9, 4), (9, 5), (3, 6)} <= found and all(d not in (0, 1, 2) for d, _ in found)
    assert decontam.find(edge, items).count() == edge.count() and decontam.drop(edge, items).columns == edge.columns
    assert decontam.contaminated(nothing, items).count() == 0 and decontam.contaminated(edge, items.limit(0)).count() == 0
