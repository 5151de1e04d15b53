"""Benchmark decontamination: an inverted index of test items, asked with every passage of every document."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, window_hashes

UNIT = 64  # words of an indexed unit, at most
PASSAGE = 2 * UNIT  # words of a passage; they begin every UNIT words, so a unit lies whole in one of them
BLOCK = 4  # units of a block
LIGHT = 0.3
SHINGLE = 5
K1, B = 1.2, 0.75
END = 1 << 62  # a cursor behind its last posting
_place = itemgetter(0)

#: A-Z become lower case and ASCII punctuation becomes white space, byte by byte.
NORMAL = bytes(ord(chr(i).lower()) if 65 <= i <= 90 else 32 if i < 128 and not chr(i).isalnum() else i for i in range(256))

HITS = "array<struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; if there is but one, its second half."""
    ends = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def _shingles(ids: np.ndarray) -> tuple[int, np.ndarray]:
    size = min(SHINGLE, len(ids))
    return size, np.unique(window_hashes(ids, size)) if size else np.empty(0, np.uint64)


class Index:
    """BM25 impacts of units of items, each as a share of what the unit scores for its own text, in blocks.

    A unit is retrieved for a passage if the shares of the terms they have in common reach ``threshold``. Of each unit's
    terms, the lightest ones, together ``LIGHT`` at most, are not essential. For all passages of a text at once, the
    essential terms' block maxima are added up; a passage in which no block comes to the threshold less ``LIGHT`` can't
    reach it. The others walk the postings by pivots, see ``retrieve``.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float) -> None:
        self.threshold = threshold
        ids = WordIds()
        self.items: list[tuple] = []
        units: list[tuple[int, Counter]] = []
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            question, answer = (ids.of(normal_words(x)) for x in question_and_answer(text))
            n_units = -(-len(words) // UNIT)
            size = -(-len(words) // n_units)
            units += [(len(self.items), Counter(words[i : i + size])) for i in range(0, len(words), size)]
            self.items.append((item, *_shingles(ids.of(words)), *_shingles(question), np.unique(answer)))
        df = Counter(t for _, c in units for t in c)
        average = sum(sum(c.values()) for _, c in units) / max(1, len(units))
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        self.item_of = np.array([i for i, _ in units], np.int64)
        rows: list[tuple[int, int, float, float]] = []  # term, unit, share, share if essential
        for u, (_, c) in enumerate(units):
            norm = K1 * (1 - B + B * sum(c.values()) / average)
            impact = {t: np.log1p((len(units) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            total, below = sum(impact.values()), 0.0
            for t, x in sorted(impact.items(), key=lambda p: (p[1], p[0])):
                below += x / total
                rows.append((self.terms[t], u, x / total, x / total if below > LIGHT else 0.0))
        rows.sort()
        term, unit, share, essential = (np.array([r[i] for r in rows], k) for i, k in enumerate((int, int, float, float)))
        self.unit, self.share = array("q", unit.tolist()), array("d", share.tolist())
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1)).tolist()
        blocks = unit // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])])) if len(rows) else np.empty(0, np.int64)
        most = np.maximum.reduceat(share, head) if len(rows) else share
        self.block_max = dict(zip(zip(term[head].tolist(), blocks[head].tolist(), strict=True), most.tolist(), strict=True))
        self.most = [max(self.share[a:b]) for a, b in zip(self.first, self.first[1:], strict=False)]
        self.n_blocks = -(-len(units) // BLOCK)
        most = np.maximum.reduceat(essential, head) if len(rows) else share
        heavy = np.flatnonzero(most > 0)
        self.heavy_block, self.heavy_max = blocks[head][heavy], most[heavy]
        self.heavy_from = np.searchsorted(term[head][heavy], np.arange(len(self.terms) + 2))  # the last: not a term

    def retrieve(self, terms: np.ndarray) -> tuple[list[int], list[float]]:
        """Numbers and scores of the units that reach the threshold for a passage with these distinct terms.

        Block-max WAND: cursors on the terms' postings stand in order of their units. The pivot is the first unit at which
        the greatest shares of the terms up to it reach the threshold; none before it can. If its block's maxima don't, all
        units up to the block's end or the next cursor are skipped, else lagging cursors move up to it or it is scored.
        """
        need = self.threshold - 1e-9
        walk = [[self.unit[a], a, b, self.most[t], t] for t in terms.tolist() if (a := self.first[t]) < (b := self.first[t + 1])]
        units: list[int] = []
        scores: list[float] = []

        def move(cursors: list[list], to: int) -> None:
            for c in cursors:
                if c[0] < to:
                    c[1] = bisect_left(self.unit, to, c[1], c[2])
                    c[0] = self.unit[c[1]] if c[1] < c[2] else END

        while walk:
            walk.sort(key=_place)
            while walk and walk[-1][0] == END:
                walk.pop()
            reach, n = 0.0, 0
            while n < len(walk) and reach < need:
                reach += walk[n][3]
                n += 1
            if reach < need:
                break
            pivot = walk[n - 1][0]
            while n < len(walk) and walk[n][0] == pivot:
                n += 1
            block = pivot // BLOCK
            if sum(self.block_max.get((c[4], block), 0.0) for c in walk[:n]) < need:
                move(walk[:n], min((block + 1) * BLOCK, walk[n][0] if n < len(walk) else END))
            elif walk[0][0] < pivot:
                move(walk[:n], pivot)
            else:
                score = sum(self.share[c[1]] for c in walk[:n])
                if score >= need:
                    units.append(pivot)
                    scores.append(score)
                move(walk[:n], pivot + 1)
        return units, scores

    def passages(self, term: np.ndarray) -> np.ndarray:
        """Numbers of the passages that may reach the threshold; passage k has the chunks k and k + 1 of UNIT words."""
        n_terms, n = len(self.terms), -(-len(term) // UNIT)
        key = np.unique(np.arange(len(term)) // UNIT * (n_terms + 1) + term)
        chunk, term = np.divmod(key, n_terms + 1)
        start, end = self.heavy_from[term], self.heavy_from[term + 1]
        entries = _ranges(start, end)
        cell = np.repeat(chunk, end - start) * self.n_blocks + self.heavy_block[entries]
        cells, at = np.unique(cell, return_inverse=True)
        bound = np.bincount(at, weights=self.heavy_max[entries], minlength=len(cells))
        # A block's bound in passage k: of chunk k, and of chunk k + 1 if that has one.
        after = np.searchsorted(cells, cells + self.n_blocks)
        there = after < len(cells)
        there[there] = cells[after[there]] == cells[there] + self.n_blocks
        first = bound.copy()
        first[there] += bound[after[there]]
        need = self.threshold - LIGHT - 1e-6
        mine = cells // self.n_blocks
        found = np.concatenate([mine[first >= need], mine[bound >= need] - 1])
        return np.unique(np.clip(found, 0, max(0, n - 2)))

    def hits(self, text: str | None, ids: WordIds, least: float) -> list[dict]:
        """The items whose words a text holds: retrieved by one of its passages and verified on the whole text."""
        words = normal_words(text)
        if not words or not self.terms:
            return []
        none = len(self.terms)
        term = np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))
        begin = UNIT * self.passages(term)
        best: dict[int, float] = {}
        for a in begin.tolist():
            known = np.unique(term[a : a + PASSAGE])
            for u, s in zip(*self.retrieve(known[known < none]), strict=True):
                item = int(self.item_of[u])
                best[item] = max(s, best.get(item, 0.0))
        if not best:
            return []
        mine = ids.of(words)
        by_size: dict[int, np.ndarray] = {}

        def share(size: int, part: np.ndarray) -> float:
            if size and size not in by_size:
                by_size[size] = np.unique(window_hashes(mine, size))
            return float(np.isin(part, by_size[size]).mean()) if size else 1.0

        out = []
        for item, score in best.items():
            name, n_whole, whole, n_question, question, answer = self.items[item]
            all_, asked = share(n_whole, whole), share(n_question, question)
            said = float(np.isin(answer, mine).mean()) if len(answer) else 1.0
            if all_ >= least and asked >= 0.5 and said >= 0.5:
                out.append({"item_id": name, "score": score, "overlap": all_, "question_overlap": asked, "answer_overlap": said})
        return sorted(out, key=lambda h: h["item_id"])


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of start[i] to end[i] - 1, one range after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _shards(items: DataFrame, max_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // max_bytes))


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, max_bytes: int = 16 << 20) -> DataFrame:
    """Adds benchmark_hits, an array of the items that a document's text holds, to docs (a column of that name goes).

    Passages of 128 words, one every 64, ask a BM25 index of the items (item_id, text) and retrieve every item of which
    a unit (64 words at most) reaches ``threshold`` of its score for its own text. An item is a hit if ``overlap`` of its
    5-word shingles are in the whole text, as well as half of its question's and half of its answer's words; case and
    ASCII punctuation don't count. The index goes to every task; items of over ``max_bytes`` are split into so many
    indexes of that size, each asked in a pass of its own. Null and empty texts and items give no hits; items with equal
    texts are all hit; repeated rows are each looked at; an item of fewer than 5 words counts as one shingle.
    """
    kept = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != "benchmark_hits"))
    at = kept.columns.index("text")
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    n = _shards(items, max_bytes)
    out = kept.withColumn("benchmark_hits", F.expr(f"cast(array() as {HITS})"))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ids = WordIds()
            for batch in batches:
                new = pa.array([index.value.hits(x.as_py(), ids, overlap) for x in batch.column(at)], batch.schema.types[-1])
                old = batch.column(batch.num_columns - 1)
                if old.null_count != len(old) and len(old.flatten()):
                    new = pa.array([a + b for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)], new.type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> (doc_id, item_id, score, overlap, question_overlap, answer_overlap) of each hit."""
    found = find(docs.select("doc_id", "text"), items, **options)
    return found.select("doc_id", F.explode("benchmark_hits").alias("hit")).select("doc_id", "hit.*")


def drop(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs whose texts hold no item, in docs' columns."""
    found = find(docs, items, **options)
    return found.where(F.size("benchmark_hits") == 0).select(*(f"`{c}`" for c in docs.columns))
