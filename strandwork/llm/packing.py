"""Best-fit packing of token sequences under several capacities."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, positions
from .tokens import encoder, paths, small_ids

END_ID = 2


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents' pieces, and attention cost.

    The cost of a piece is the number of ``tile`` x ``tile`` tiles that its own attention takes, so a sequence of many
    short pieces costs more than its tokens say. ``docs`` and ``cost`` of None are the most that ``tokens`` can need, so
    they never cost a sequence, but still count in the choice of a bin. ``weights`` weigh what is left of the three, as
    shares of their capacities, in that choice; ``rule`` is "residual" (smallest weighted Euclidean norm of what would be
    left) or "dot" (largest weighted dot product of the item with what is left).
    """

    tokens: int = 1024
    docs: int | None = None
    cost: int | None = None
    tile: int = 128
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)
    rule: str = "residual"

    def cost_of(self, length: int) -> int:
        return (-(-length // self.tile)) ** 2

    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.docs or self.tokens, self.cost or max(self.tokens, self.cost_of(self.tokens))


def pieces(docs: DataFrame, tokens: int = 1024, tokenizer: str | None = None, keep_ids: bool = False, ranks: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids]), a row for each piece of each document.

    A document is its ids and then id 2; a null or empty text is that id alone. Only a document of more than ``tokens``
    ids is cut: into pieces of ``tokens``, of which the first may be shorter. ``ids`` are little-endian unsigned 32-bit
    in the checksum and unsigned 16-bit in the column (larger ones raise).
    """
    path, ranks = paths(tokenizer, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                first = (len(ids) - 1) % tokens + 1
                at = 0
                for k, size in enumerate([first] + [tokens] * ((len(ids) - first) // tokens)):
                    part = ids[at : at + size]
                    row = (doc, k, at, size, zlib.crc32(part.tobytes()), small_ids(part).tobytes() if keep_ids else None)
                    for values, x in zip(out, row, strict=True):
                        values.append(x)
                    at += size
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)][: 6 if keep_ids else 5]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit decreasing over a histogram of lengths -> segments
    (length, first rank, ranks, items a bin, first bin, offset of the first item in the bin).

    Bins with the same contents so far are one class with a count, so the work follows the number of different lengths
    (at most ``capacity.tokens``), not of items. The items of each length fill the best class first: as many of them in
    each of its bins as fit, or fewer bins of it if the items run out.
    """
    limits = np.array(capacity.limits(), float)
    weights = np.array(capacity.weights)
    classes: dict[tuple[int, int, int], list] = defaultdict(list)  # what is left -> [[number of bins, parts], ...]
    done: list[tuple[int, tuple]] = []

    def put(left: tuple[int, int, int], n: int, parts: tuple) -> None:
        if min(left) <= 0:
            done.append((n, parts))
        else:
            classes[left].append((n, parts))

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, capacity.cost_of(length)])
        todo = counts[length]
        while todo:
            open_ = [left for left in classes if all(np.array(left) >= need)]
            if open_:
                lefts = np.array(open_, float)
                if capacity.rule == "dot":
                    best = int(np.argmax((weights * lefts / limits * (need / limits)).sum(axis=1)))
                else:
                    best = int(np.argmin((weights * ((lefts - need) / limits) ** 2).sum(axis=1)))
                left = open_[best]
                n, parts = classes[left].pop()
                if not classes[left]:
                    del classes[left]
            else:
                left, parts = tuple(int(x) for x in limits), ()
                n = todo
            each = int(min(np.array(left) // need))
            if todo < each:
                each, used = todo, 1
            else:
                used = min(n, todo // each)
            if n > used and open_:
                classes[left].append((n - used, parts))
            todo -= used * each
            put(tuple(int(x) for x in np.array(left) - each * need), used, (*parts, (length, each)))
    for left in list(classes):
        done += classes.pop(left)
    segments, ranks, first_bin = [], defaultdict(int), 0
    for n, parts in done:
        offset = 0
        for length, each in parts:
            segments.append((length, ranks[length], n * each, each, first_bin, offset))
            ranks[length] += n * each
            offset += length * each
        first_bin += n
    return segments


def place(items: DataFrame, capacity: Capacity, order: list[str]) -> tuple[DataFrame, int]:
    """Adds sequence_id and offset to items with a ``length`` (1 to capacity.tokens) -> (items, number of sequences).

    The driver sees the histogram of lengths (at most capacity.tokens rows), plans on it, and gives back as many
    segments as bins of different contents have parts. Every item then finds its place from its rank among those of its
    length; ranks are taken over ranges of (length, ``order``), so a length that most rows have is spread like any other.
    ``order`` names columns that identify an item; rows that agree in them are interchangeable.
    """
    spark = items.sparkSession
    totals = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    segments = plan_bins(totals, capacity)
    n_sequences = max((s[4] + s[2] // s[3] for s in segments), default=0)
    segment_df = spark.createDataFrame(
        [(s[0], s[1], s[1] + s[2], s[3], s[4], s[5]) for s in segments],
        "length long, _from long, _to long, _each long, _bin long, _at long",
    )
    in_segment = F.col("position") - F.col("_from")
    placed = (
        positions(items, ["length"], order, "ranks")
        .join(F.broadcast(segment_df), "length")
        .where("position >= _from and position < _to")
        .withColumn("sequence_id", F.col("_bin") + F.floor(in_segment / F.col("_each")))
        .withColumn("offset", F.col("_at") + F.pmod(in_segment, F.col("_each")) * F.col("length"))
    )
    return placed.select(*items.columns, "sequence_id", "offset"), n_sequences


def pack(docs: DataFrame, capacity: Capacity | None = None, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    Null and empty texts are the end id alone. Rows that repeat, null doc_ids included, are packed as often as they
    occur. Sequences are numbered from 0 without gaps; pieces lie in them from offset 0 without gaps. No rows give no
    rows.
    """
    capacity = capacity or Capacity()
    cut = materialize(pieces(docs, capacity.tokens, tokenizer, ranks=ranks), "pieces")
    placed, _ = place(cut, capacity, ["doc_id", "piece", "ids_crc32"])
    return placed
