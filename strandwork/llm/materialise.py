"""Training order: every sequence of token ids gets a global slot by a keyed permutation and is written at it.

Layout of ``path``: ``stream`` (Parquet: token ids of the documents by split of the input), ``manifest`` (one line of JSON)
and ``shards/shard=K/part-*.txt``, a file for each shard with the slots K * per_shard and on. A record is ``tokens`` ids as
little-endian unsigned 16-bit numbers and one end byte (newline), so slot s begins at byte (s % per_shard) * stride of
the file of shard s // per_shard, with stride = 2 * tokens + 1. Reading on from any slot needs no index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix
from .packing import END_ID
from .tokens import encoder, paths, small_ids

ROUNDS = 6
BLOCK = 256  # documents that are encoded before what is full goes out
SLICE = 2048  # rows of the stream that are cut anew at once
#: How the stream is stored: small row groups and no dictionaries, as a writer holds a row group of each column.
STREAM = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}

@dataclass(frozen=True)
class Layout:
    n: int
    tokens: int = 1024
    per_shard: int = 4096
    key: str = "0"

    @property
    def stride(self) -> int:
        return 2 * self.tokens + 1

    @property
    def shards(self) -> int:
        return -(-self.n // self.per_shard)

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte at which a slot begins."""
        return slot // self.per_shard, slot % self.per_shard * self.stride

    def length(self, shard: int) -> int:
        return min(self.per_shard, self.n - shard * self.per_shard) * self.stride


class Permutation:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network over the least even number of bits that holds n,
    walked on from results of n or more until they fall below (under four steps on average)."""

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}".encode())) for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list[np.uint64], swap: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if swap:
            left, right = right, left
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        if swap:
            left, right = right, left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, keys: list[np.uint64], swap: bool) -> np.ndarray:
        out = self._once(x.astype(np.uint64), keys, swap)
        while len(over := np.flatnonzero(out >= self.n)):
            out[over] = self._once(out[over], keys, swap)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


def in_file_order(docs: DataFrame, as_they_are: bool) -> DataFrame:
    """(text, file, split): the split of a file that a row comes from; (file, split) and the place in it order all rows.

    Rows that come straight from files have their places there (``as_they_are``). Others are sorted by doc_id (then by a
    hash of the text) and written first. Either way the order is a property of files, not of how a run splits them.
    """
    at = ("_metadata.file_path", "_metadata.file_block_start")
    if as_they_are and docs.inputFiles():
        try:
            return docs.select("text", F.col(at[0]).alias("file"), F.col(at[1]).alias("split"))
        except AnalysisException:
            pass
    keys = [F.col("doc_id"), F.xxhash64("text")]
    rows = materialize(docs.repartitionByRange(*keys).sortWithinPartitions(*keys).select("text"), "ordered")
    return rows.select("text", F.col(at[0]).alias("file"), F.col(at[1]).alias("split"))


def stream(docs: DataFrame, tokens: int = 1024, tokenizer: str | None = None, ranks: str | None = None, as_they_are: bool = True) -> DataFrame:
    """(doc_id, text) -> (file, split, k, ids binary, n int): the documents of each split end to end, each followed by id 2,
    in pieces of ``tokens`` ids (the last one of a split may be shorter). A null or empty text is id 2 alone."""
    path, ranks = paths(tokenizer, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        end = np.array([END_ID], "<u2")
        here: tuple | None = None
        held, done = np.empty(0, "<u2"), 0

        def rows(ids: np.ndarray) -> pa.RecordBatch:
            data = [ids[i : i + tokens].tobytes() for i in range(0, len(ids), tokens)]
            n = len(data)
            cols = [
                pa.array([here[0]] * n, pa.string()),
                pa.array(np.full(n, here[1], np.int64)),
                pa.array(np.arange(done, done + n)),
                pa.array(data, pa.binary()),
                pa.array([len(x) // 2 for x in data], pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["file", "split", "k", "ids", "n"])

        for batch in batches:
            files, splits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            a = 0
            while a < batch.num_rows:
                place, b = (files[a], splits[a]), a + 1
                while b < min(batch.num_rows, a + BLOCK) and (files[b], splits[b]) == place:
                    b += 1
                if place != here:
                    if len(held):
                        yield rows(held)
                    here, held, done = place, np.empty(0, "<u2"), 0
                parts = [held]
                for text in batch.column(0)[a:b]:
                    parts += [small_ids(encode(text.as_py() or "")), end]
                held, a = np.concatenate(parts), b
                if full := len(held) // tokens:
                    yield rows(held[: full * tokens])
                    held, done = held[full * tokens :].copy(), done + full
        if len(held):
            yield rows(held)

    return in_file_order(docs, as_they_are).mapInArrow(run, "file string, split long, k long, ids binary, n int")


def _manifest(spark: SparkSession, path: str) -> Layout | None:
    try:
        row = spark.read.schema("n long, tokens int, per_shard int, key string").json(f"{path}/manifest").first()
    except AnalysisException:
        return None
    return Layout(**row.asDict()) if row else None


def _shard_files(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(shard, length, content) of the files of the shards from ``first`` on; the others' aren't opened: shard is the
    folder's name, so the filter picks files before any is read."""
    rows = spark.read.format("binaryFile").load(f"{path}/shards")
    return rows.where(F.col("shard") >= first).select(F.col("shard").cast("long"), "length", "content")


def _whole_shards(spark: SparkSession, path: str, layout: Layout) -> np.ndarray:
    """Numbers of the shards that are written in full."""
    try:
        rows = _shard_files(spark, path).groupBy("shard").agg(F.sum("length").alias("n")).collect()
    except AnalysisException:  # no shard yet
        return np.empty(0, np.int64)
    return np.array([r["shard"] for r in rows if r["n"] == layout.length(r["shard"])], np.int64)


def write(docs: DataFrame, path: str, tokens: int = 1024, per_shard: int = 4096, key: str = "0", tokenizer: str | None = None, ranks: str | None = None) -> Layout:
    """Writes the sequences of docs (doc_id, text) at their slots under ``path``; does only what is missing there.

    Token ids are written first, split by split; sums by split give every token its place in one global stream, which is
    cut every ``tokens`` ids into sequences (the last one is filled up with id 2), wherever splits end. Then the
    manifest is written, then shards: the slot of a sequence tells the shard, one shuffle (of sequences and, at the ends of
    splits, parts of sequences, compressed in bundles) brings each shard to one task, which lays its records out and
    writes them. ``index`` is the same for any split size. A task holds one shard, ``per_shard`` times the stride; the
    driver a number for each split and for each finished shard. A second call with the same ``path`` keeps the stream
    (and the layout of the manifest, whatever its arguments) and writes shards that aren't there in full. Repeated rows
    are each written. No rows give a layout of 0 sequences and no shards. Ids of 65,536 and more raise.
    """
    spark = docs.sparkSession
    layout = _manifest(spark, path)
    found = spark.read.schema("file string, split long, k long, ids binary, n int")
    split = F.xxhash64("file", "split").alias("split")

    def sums_by_split() -> list:
        rows = found.parquet(f"{path}/stream").groupBy("file", "split").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max("k").alias("last"))
        return rows.orderBy("file", "split").select(split, "n", "rows", "last").collect()

    for as_they_are in (True, False) if layout is None else ():
        made = stream(docs, tokens, tokenizer, ranks, as_they_are)
        made.write.mode("overwrite").options(**STREAM).parquet(f"{path}/stream")
        if all(r["rows"] == r["last"] + 1 for r in sums_by_split()):
            break  # else docs are shuffled rows: those of a split lie in several places
    sums, found = sums_by_split(), found.parquet(f"{path}/stream")
    ids = np.array([r["split"] for r in sums], np.int64)
    if len(np.unique(ids)) < len(ids):
        raise ValueError("two splits have one hash")
    first = np.cumsum([0, *(r["n"] for r in sums)]).astype(np.int64)
    total = int(first[-1])
    if layout is None:
        layout = Layout(-(-total // tokens), tokens, per_shard, key)
        spark.createDataFrame([asdict(layout)], "n long, tokens int, per_shard int, key string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    if not layout.n:
        return layout
    order = np.argsort(ids)
    known = spark.sparkContext.broadcast((ids[order], first[:-1][order], _whole_shards(spark, path, layout)))
    size = layout.tokens

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm, pack = Permutation(layout.n, layout.key), zstd.ZstdCompressor(level=3).compress
        splits, begins, there = known.value
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            begin = begins[np.searchsorted(splits, batch.column(0).to_numpy())] + batch.column(1).to_numpy() * size
            n = batch.column(3).to_numpy().astype(np.int64)
            data = batch.column(2)
            ends = begin + n
            # Stretches of rows that follow each other in the stream are cut anew, at the sequences' borders.
            cuts = np.flatnonzero(begin[1:] != ends[:-1]) + 1
            out: list[tuple[int, int, bytes]] = []
            for rows in np.split(np.arange(len(n)), cuts):
                raw = b"".join(data[i].as_py() for i in rows.tolist())
                at, stop = int(begin[rows[0]]), int(ends[rows[-1]])
                borders = [at, *range((at // size + 1) * size, stop, size), stop]
                out += [(a, b - a, raw[2 * (a - at) : 2 * (b - at)]) for a, b in zip(borders, borders[1:], strict=False)]
            start = np.array([x[0] for x in out], np.int64)
            slot = perm.slots(start // size)
            shard = slot // layout.per_shard
            rows = np.flatnonzero(~np.isin(shard, there))
            rows = rows[np.argsort(shard[rows], kind="stable")]
            if not len(rows):
                continue
            parts = np.split(rows, np.flatnonzero(np.diff(shard[rows])) + 1)
            head = [np.stack([slot[x], start[x] % size, [out[i][1] for i in x.tolist()]], axis=1).astype("<i8") for x in parts]
            packed = [pack(h.tobytes() + b"".join(out[i][2] for i in x.tolist())) for h, x in zip(head, parts, strict=True)]
            cols = [pa.array([int(shard[x[0]]) for x in parts], pa.int64()), pa.array([len(x) for x in parts], pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "n", "data"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstd.ZstdDecompressor().decompress
        now, space, filled = -1, np.empty(0, "<u2"), np.empty(0, np.int64)

        def laid() -> Iterator[pa.RecordBatch]:
            if now < 0:
                return
            if (filled != size).any():
                raise ValueError(f"shard {now} lacks tokens")
            for a in range(0, len(space), 1024):
                value = pa.array([x.tobytes() for x in space[a : a + 1024]], pa.binary())
                at = np.arange(a, a + len(value), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), now, np.int64)), pa.array(at), value], ["shard", "at", "value"])

        for batch in batches:
            for shard, n, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                if shard.as_py() != now:
                    yield from laid()
                    now = shard.as_py()
                    count = layout.length(now) // layout.stride
                    space, filled = np.full((count, size), END_ID, "<u2"), np.zeros(count, np.int64)
                    last = int(Permutation(layout.n, layout.key).slots(np.array([layout.n - 1]))[0])
                    if last // layout.per_shard == now:
                        filled[last % layout.per_shard] = layout.n * size - total  # what is filled up
                raw = unpack(data.as_py())
                head = np.frombuffer(raw, "<i8", 3 * n.as_py()).reshape(-1, 3)
                values, at = np.frombuffer(raw, "<u2", offset=24 * n.as_py()), 0
                for slot, offset, length in head.tolist():
                    space[slot - now * layout.per_shard, offset : offset + length] = values[at : at + length]
                    filled[slot - now * layout.per_shard] += length
                    at += length
        yield from laid()

    bundles = found.select(split, "k", "ids", "n").mapInArrow(bundle, "shard long, n int, data binary")
    tasks = min(layout.shards, 100_000)
    target = F.expr(f"cast(shard * {tasks} div {layout.shards} as int)")
    rows = bundles.repartitionById(tasks, target).sortWithinPartitions("shard").mapInArrow(records, "shard long, at long, value binary")
    ordered = rows.sortWithinPartitions("shard", "at").select("shard", F.col("value").cast("string").alias("value"))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").text(f"{path}/shards")
    return layout


def _records(spark: SparkSession, path: str, layout: Layout, start: int, names: list[str], schema: str, more) -> DataFrame:
    """Slots from ``start`` on: slot, shard, byte_offset, and the columns that ``more`` makes of (slots, an array of records)."""
    first, _ = layout.place(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, layout.stride)
                if (data[:, -1] != 10).any() or data.size != layout.length(shard):
                    raise ValueError(f"shard {shard} is damaged")
                skip = max(0, start - shard * layout.per_shard)
                for a in range(skip, len(data), 1024):
                    part = data[a : a + 1024, :-1]
                    at = np.arange(a, a + len(part), dtype=np.int64)
                    slot = shard * layout.per_shard + at
                    cols = [pa.array(slot), pa.array(np.full(len(part), shard, np.int64)), pa.array(at * layout.stride), *more(slot, part)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return _shard_files(spark, path, first).select("shard", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Slots from ``start`` on: (slot, shard, byte_offset, ids binary). Files of the shards before the first one aren't
    opened."""
    layout, schema = _manifest(spark, path), "slot long, shard long, byte_offset long, ids binary"
    if layout is None or start >= layout.n:
        return spark.createDataFrame([], schema)
    ids = lambda slot, part: [pa.array([x.tobytes() for x in part], pa.binary())]
    return _records(spark, path, layout, start, ["slot", "shard", "byte_offset", "ids"], schema, ids)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(slot, shard, byte_offset, sequence, ids_crc32) of every record, read from the shards; sequence is the number in
    the stream's order that the slot stands for, crc32 that of the ids as little-endian unsigned 16-bit numbers."""
    layout, schema = _manifest(spark, path), "slot long, shard long, byte_offset long, sequence long, ids_crc32 long"
    if layout is None or not layout.n:
        return spark.createDataFrame([], schema)
    order = Permutation(layout.n, layout.key)

    def more(slot: np.ndarray, part: np.ndarray) -> list[pa.Array]:
        return [pa.array(order.numbers(slot)), pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in part], pa.int64())]

    return _records(spark, path, layout, 0, ["slot", "shard", "byte_offset", "sequence", "ids_crc32"], schema, more)
