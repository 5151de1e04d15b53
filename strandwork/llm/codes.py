"""Vector codes: integer product quantisation, with partial-distance search for the nearest entries.

A vector is cut into equal parts, and a part is told by the index of its nearest codebook entry. Everything is integer,
so codes and errors are exact and the same on every machine.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 4096


@dataclass(frozen=True)
class Codebooks:
    """books: part x entry x component, integers; dims: components of a whole vector."""

    dims: int
    books: list[list[list[int]]] = field(default_factory=list)

    def arrays(self) -> list[np.ndarray]:
        return [np.array(b, np.int64) for b in self.books]

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def vector(self, code: str) -> list[int]:
        """What a code stands for, in integers (``SCALE`` times the components)."""
        return [x for p, book in enumerate(self.books) for x in book[int(code[2 * p : 2 * p + 2], 16)]]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of x (int64) -> index of the nearest entry (ties to the lower), its squared distance, and terms that were added.

    Dimensions are taken in order of falling variance over the entries. A row begins with the whole distance to the entry
    that is nearest in the first of them; every other entry is added up dimension by dimension for all rows together,
    and a row drops the entry as soon as its sum so far exceeds (strictly, so that ties are decided by index) the
    row's best whole distance.
    """
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    cols, c = np.ascontiguousarray(x.T[order]), book[:, order]
    by_lead = np.argsort(c[:, 0], kind="stable")
    lead = c[by_lead, 0]
    right = np.clip(np.searchsorted(lead, cols[0]), 0, len(lead) - 1)
    left = np.maximum(right - 1, 0)
    index = by_lead[np.where(np.abs(cols[0] - lead[left]) <= np.abs(cols[0] - lead[right]), left, right)]
    best = sum((cols[j] - c[index, j]) ** 2 for j in range(len(cols)))
    terms = cols.size
    for k in range(len(c)):
        rows = np.flatnonzero(index != k)
        total = np.zeros(len(rows), np.int64)
        for j in range(len(cols)):
            total += (cols[j][rows] - c[k, j]) ** 2
            terms += len(rows)
            in_play = total <= best[rows]
            if not in_play.all():
                rows, total = rows[in_play], total[in_play]
            if not len(rows):
                break
        wins = (total < best[rows]) | (k < index[rows])
        rows, total = rows[wins], total[wins]
        best[rows], index[rows] = total, k
    return index, best, terms


def integers(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id long, label, v array<long>): components as floor(SCALE * x); vectors that are null or hold a null, NaN or
    infinite component are left out."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & sound)
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for integer codes")).cast("long")))
    return rows.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def _rows(batch: pa.RecordBatch, at: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column with ``dims`` components, and at which rows they are."""
    lists = batch.column(at)
    sizes = np.diff(np.asarray(lists.offsets))
    which = np.flatnonzero(sizes == dims)
    if len(which) < len(sizes):
        lists = lists.take(pa.array(which))
    x = np.asarray(lists.flatten(), np.int64).reshape(len(which), dims)
    if len(x) and dims * (2 * int(np.abs(x).max())) ** 2 >= 1 << 63:
        raise ValueError("vectors are too large for 64-bit distances")
    return x, which


def seeds(table: DataFrame, parts: int, entries: int) -> Codebooks:
    """The vectors of the ``entries`` smallest vec_ids, cut into parts; of rows that share a vec_id the smallest vector."""
    ids = [r[0] for r in table.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return Codebooks(0)
    found = table.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    dims = len(found[0]["v"])
    if dims % parts or not dims:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    kept, size = [r["v"] for r in found if len(r["v"]) == dims], dims // parts
    return Codebooks(dims, [[v[p * size : (p + 1) * size] for v in kept] for p in range(parts)])


def improved(table: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry to the floor of its parts' mean; unused ones stay.

    A task returns a sum and a count for each entry; the driver gets one row for each entry of each part.
    """
    dims, arrays = books.dims, books.arrays()
    size = dims // len(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in arrays]
        counts = [np.zeros(len(b), np.int64) for b in arrays]
        for batch in batches:
            x, _ = _rows(batch, 0, dims)
            for p, book in enumerate(arrays) if len(x) else ():
                part = x[:, p * size : (p + 1) * size]
                index, _, _ = nearest(part, book)
                np.add.at(sums[p], index, part)
                counts[p] += np.bincount(index, minlength=len(book))
        rows = [(p, e, counts[p][e], sums[p][e]) for p in range(len(arrays)) for e in np.flatnonzero(counts[p])]
        if rows:
            p, e, n, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array([x.tolist() for x in s], pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    found = table.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    each = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    new = [[list(e) for e in book] for book in books.books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows at most
        new[r["part"]][r["entry"]] = [math.floor(int(r[f"s{j}"]) // r["n"]) for j in range(size)]
    return Codebooks(dims, new)


def fit(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks of ``integers`` rows, from the vectors of the smallest ids, improved over all rows ``rounds`` times."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits")
    books = seeds(table, parts, entries)
    for _ in range(rounds if books.dims else 0):
        books = improved(table, books)
    return books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """Adds code (two hexadecimal digits for each part) and error (squared distance) to ``integers`` rows, v left out.
    A vector that has other than ``books.dims`` components has neither."""
    dims, arrays = books.dims, books.arrays()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            x, which = _rows(batch, 2, dims)
            code, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            if len(x):
                size, text = dims // len(arrays), np.zeros(len(x), "<U1")
                for p, book in enumerate(arrays):
                    index, far, _ = nearest(x[:, p * size : (p + 1) * size], book)
                    text = np.char.add(text, digits[index])
                    error[which] += far
                code[which] = text
            missing = np.array([c is None for c in code], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=missing)], ["vec_id", "label", "code", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, embedding, label, ...) -> (vec_id, code, error, label_error, codebooks_sha256), a row for each sound vector.

    Vectors that are null or hold a null, NaN or infinite component are left out; one of another length than that of
    the smallest vec_id has null code and error. Rows that share a vec_id are all coded; the codebooks begin with one
    of them. Rows without vec_id are coded but begin no codebook. label_error sums the errors of equal labels, null
    being one; no rows give no rows. Lengths that don't divide by ``parts`` raise, as do components whose distances
    would leave 64 bits.
    """
    table = materialize(integers(vectors), "integers")
    books = fit(table, parts, entries, rounds)
    found = materialize(encode(table, books), "codes")
    sums = materialize(found.groupBy(F.col("label").alias("_l")).agg(F.sum("error").cast("long").alias("label_error")), "labels")
    met = found.join(sums, F.col("label").eqNullSafe(F.col("_l")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
