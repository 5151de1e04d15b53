"""Exact removal of repeated 50-word passages by recompression.

The symbols. A word has a 64-bit name made from its bytes. Rounds then shorten each text: round one first names runs of
2 to 4 equal words; each round names pairs of neighbours, the left one of a class of names and the right one of the
other, if they have 2 and then 4 words at most. Names are hashes of what they stand for, so equal word sequences get equal
names in every document, task and run: names are global without an exchange. Whether two neighbours join depends on
themselves alone, so an occurrence of a passage in two texts has the same symbols in both but for a rim: whether a place
is a border after a round depends on at most 4 (runs) or 2**r - 1 (pairs of round r) words to either side, 8 in all. In
a window of 50 words the middle 34 hold a whole symbol (none has over 4 words), and those that lie there whole are
decided by the window alone. A third round would give rarer names, but a middle of 20 words and so half as many groups
again.

The groups. Each window is assigned to the longest symbol that lies whole in its middle (ties: greatest name, then the
first), its anchor. Neighbouring windows with one anchor form a group; a document has about one for sixteen words. The
same window has the same anchor name everywhere. Anchors whose name only one document has go first. Other groups are
compared by (anchor name, hash of the words they cover):

- a document in a group that a smaller doc_id also has: all words of the group go;
- the smallest document of a group: only if its anchor occurs in another group, of another document, its windows are
  compared one by one, by (anchor name, hash of the window).

So whole copies and shared passages meet as groups, and single windows are shuffled only at the rims of repeats. Equality
rests on a name and a hash, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, by_size, list_column, materialize, mix

WINDOW = 50
ROUNDS = 2
MAX_RUN = 4
RIM = MAX_RUN + sum(2**r - 1 for r in range(1, ROUNDS + 1))
LONGEST = max(MAX_RUN, 2**ROUNDS)
MIDDLE = WINDOW - 2 * RIM
PLACE = 64
assert MIDDLE < PLACE  # no group has more windows
assert MIDDLE >= 2 * LONGEST - 1  # a border is among the first LONGEST places, and a whole symbol after it

BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def recompress(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of texts laid end to end, and True where a text starts -> names and lengths in words of their symbols."""
    if not len(ids):
        return ids, np.empty(0, np.int64)
    names, lengths = ids.copy(), np.ones(len(ids), np.int64)
    run_start = first | np.concatenate([[True], ids[1:] != ids[:-1]])
    at = np.flatnonzero(run_start)
    size = np.diff(np.append(at, len(ids)))
    short = (size >= 2) & (size <= MAX_RUN)
    names[at[short]] = mix(ids[at[short]] + size[short].astype(np.uint64) * BASE)
    lengths[at[short]] = size[short]
    keep = run_start | np.repeat(~short, size)
    names, lengths, first = names[keep], lengths[keep], first[keep]
    for r in range(1, ROUNDS + 1):
        left = (mix(names ^ np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)).astype(bool)
        joins = left[:-1] & ~left[1:] & ~first[1:] & (lengths[:-1] + lengths[1:] <= 2**r)
        at = np.flatnonzero(joins)
        names[at] = mix(names[at] * BASE + mix(names[at + 1]) + np.uint64(r))
        lengths[at] += lengths[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, lengths, first = names[keep], lengths[keep], first[keep]
    return names, lengths


class Sums:
    """Hashes of any stretch of a sequence of ids, from prefix sums modulo 2**64."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[0] = 1
        inverse = np.full(n + 1, BASE_INVERSE, np.uint64)
        inverse[0] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids) * np.cumprod(powers)[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def groups(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of windows of texts with ``sizes`` words, laid end to end in ``ids``:
    (text number, anchor name, hash of all words covered, first window, number of windows); windows count from the
    text's start."""
    starts = (np.cumsum(sizes) - sizes).astype(np.int64)
    first = np.zeros(len(ids), bool)
    first[starts[sizes > 0]] = True
    names, lengths = recompress(ids, first)
    begin = np.cumsum(lengths) - lengths
    # Longest first, then greatest name; zero where no symbol begins.
    prio = np.zeros(len(ids) + WINDOW, np.uint64)
    prio[begin] = (lengths.astype(np.uint64) << np.uint64(59)) | (names >> np.uint64(5)) | np.uint64(1)
    size_at = np.zeros(len(ids) + WINDOW, np.int8)
    size_at[begin] = lengths
    windows = np.maximum(sizes - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    at = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    best, where = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for o in range(RIM, WINDOW - RIM):
        p = prio[at + o]
        better = (p > best) & (size_at[at + o] + o <= WINDOW - RIM)
        best[better] = p[better]
        where[better] = at[better] + o
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    head = np.concatenate([[True], (where[1:] != where[:-1]) | (text[1:] != text[:-1])])
    g = np.flatnonzero(head)
    n = np.diff(np.append(g, len(at)))
    name = names[np.searchsorted(begin, where[g])]
    covers = Sums(ids).of(at[g], at[g] + n - 1 + WINDOW)
    return text[g], name, covers, at[g] - starts[text[g]], n


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def document_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and arrays name, covers and place (PLACE * first window + number of windows) of its groups;
    only texts of 50 words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_size(texts):
                words = [_words(t) for t in texts[a:b]]
                keep = [i for i, w in enumerate(words) if len(w) >= WINDOW]
                sizes = np.array([len(words[i]) for i in keep], np.int64)
                ids = np.concatenate([known.of(words[i]) for i in keep]) if keep else np.empty(0, np.uint64)
                text, name, covers, first, n = groups(ids, sizes)
                per = np.bincount(text, minlength=len(keep))
                docs_of = batch.column(0).take(pa.array([a + i for i in keep], pa.int64()))
                cols = [
                    docs_of,
                    list_column(per, _signed(name), pa.int64()),
                    list_column(per, _signed(covers), pa.int64()),
                    list_column(per, first * PLACE + n, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "name", "covers", "place"])

    schema = "doc_id long, name array<long>, covers array<long>, place array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, schema)


def _group_windows(joined: DataFrame) -> DataFrame:
    """(doc_id, packed text, g: array of (name, first, n)) -> doc_id, name and arrays first and hash of a group's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            out_doc, out_name, out_first, out_hash, per = [], [], [], [], []
            for doc, packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = _unpacked(packed.as_py())
                sums = Sums(known.of(words))
                for g in wanted:
                    if g["first"] + g["n"] + WINDOW - 1 > len(words):
                        continue  # another row has the same doc_id
                    at = np.arange(g["first"], g["first"] + g["n"], dtype=np.int64)
                    out_doc.append(doc)
                    out_name.append(g["name"])
                    out_first.append(at.astype(np.int32))
                    out_hash.append(_signed(sums.of(at, at + WINDOW)))
                    per.append(g["n"])
            if per:
                cols = [
                    pa.array(out_doc, pa.int64()),
                    pa.array(out_name, pa.int64()),
                    list_column(per, np.concatenate(out_first), pa.int32()),
                    list_column(per, np.concatenate(out_hash), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "name", "first", "hash"])

    return joined.mapInArrow(run, "doc_id long, name long, first array<int>, hash array<long>")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, packed): texts compressed for a shuffle, which takes them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstd.ZstdCompressor(level=6).compress
        for batch in batches:
            packed = [pack(x.as_buffer()) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, packed binary")


def _unpacked(packed: bytes | None) -> list[bytes]:
    return zstd.ZstdDecompressor().decompress(packed).split() if packed is not None else []


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, first, n): runs of n windows, from window ``first``, that also start in a smaller doc_id."""
    groups = materialize(document_groups(docs), "groups")
    zipped = F.explode(F.arrays_zip("name", "covers", "place")).alias("g")
    flat = groups.select("doc_id", zipped).select("doc_id", "g.*")
    several = flat.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("name")
    flat = materialize(flat.join(materialize(several, "names"), "name", "left_semi"), "candidates")
    least = materialize(flat.groupBy("name", "covers").agg(F.min("doc_id").alias("least")), "least")
    # Anchors in more than one group, of more than one document; windows of each group's smallest document only.
    shared = least.groupBy("name").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b").select("name", F.lit(True).alias("shared"))
    met = flat.join(least.join(shared, "name", "left"), ["name", "covers"]).where("least < doc_id or shared")
    first, n = F.floor(F.col("place") / PLACE).cast("int"), F.pmod("place", F.lit(PLACE)).cast("int")
    met = met.select("doc_id", "name", first.alias("first"), n.alias("n"), F.expr("least < doc_id").alias("whole"))
    met = materialize(met, "met")
    by_doc = met.where("not whole").groupBy("doc_id").agg(F.collect_list(F.struct("name", "first", "n")).alias("g"))
    windows = materialize(_group_windows(_packed_texts(docs).join(by_doc, "doc_id")), "windows")
    rows = windows.select("doc_id", "name", F.explode(F.arrays_zip("first", "hash")).alias("w")).select("doc_id", "name", "w.*")
    earliest = rows.groupBy("name", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    single = rows.join(earliest.select("name", "hash", "least"), ["name", "hash"]).where("least < doc_id")
    whole = met.where("whole").select("doc_id", "first", "n")
    return whole.unionByName(single.select("doc_id", "first", F.lit(1).alias("n")))


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256, kept), a row for each row of docs.

    A word goes if a window of 50 consecutive words covers it whose words also start in a document with a smaller
    doc_id. kept holds the others, joined by one space. A null text has no words; a text of fewer than 50 words and a
    row without doc_id lose nothing. Rows that share a doc_id are taken for copies of one document. No rows give no rows.
    """
    stretches = repeated_stretches(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("cut"))
    joined = _packed_texts(docs).join(stretches, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            cuts = batch.column(2)
            for i, packed in enumerate(batch.column(1)):
                words = _unpacked(packed.as_py())
                kept = words
                if (cut := cuts[i]).is_valid:
                    first = cut.values.field(0).to_numpy().astype(np.int64)
                    last = first + cut.values.field(1).to_numpy() + WINDOW - 1
                    change = np.zeros(max(len(words), int(last.max())) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, last, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(change)[: len(words)] == 0).tolist()]
                text = b" ".join(kept)
                for values, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()), strict=True):
                    values.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
