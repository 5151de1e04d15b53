"""Shards that are even in bytes, tokens and rows at once: vector bin packing of groups of equal texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, positions
from .tokens import encoder, paths

BUNDLES = 1 << 14  # small groups meet by hash in so many items at most
PART = 64  # a group of over 1/PART of a shard in any dimension is placed by itself
SLICE = 16  # one that holds a whole shard or more is cut by rows, into SLICE items a shard
DIMENSIONS = ("bytes", "tokens", "rows")


def sized(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, overhead: int = 16) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, tokens, text_crc32, group binary): UTF-8 bytes plus ``overhead``, ids and the end id,
    the unsigned CRC-32, and 128 bits of hash by which equal texts are one group. A null text counts as an empty one."""
    path, ranks = paths(tokenizer, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                data = text.encode()
                for values, x in zip(out, (len(data) + overhead, len(encode(text)) + 1, zlib.crc32(data), xxhash.xxh3_128_digest(data)), strict=True):
                    values.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["doc_id", "size", "tokens", "text_crc32", "group"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, size long, tokens long, text_crc32 long, group binary")


def assign(items: np.ndarray, shards: int, weights: tuple[float, float, float] = (1.0, 0.2, 0.2)) -> np.ndarray:
    """Items (n x dimensions, in shares of a shard's fair part) -> the shard of each.

    Largest first. An item goes to the shard with the highest weighted dot product of the item and what is left of the
    shard's capacity, its fair part of each dimension, among those with room for it in every dimension; if none has, among
    those with room in the first dimension, whose evenness is the law; if none has that, to the one least over in it.
    """
    w = np.array(weights)
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        after = left - items[i]
        for room in (after.min(axis=1) >= -1e-9, after[:, 0] >= -1e-9):
            if room.any():
                out[i] = int(np.argmax(np.where(room, left @ (w * items[i]), -np.inf)))
                break
        else:
            out[i] = int(np.argmax(after[:, 0]))
        left[out[i]] = after[out[i]]
    return out


def plan(rows: DataFrame, shards: int, bundles: int = BUNDLES) -> tuple[DataFrame, DataFrame]:
    """``sized`` rows with a stable ``_row`` -> (rows with item, (item, shard)).

    Groups over 1/PART of a shard in a dimension are few (3 * PART * shards at most) and are items of their own; one of a
    whole shard or more is cut by its rows into items of about 1/SLICE shard, as no single shard could be even with it. All
    other groups meet by hash in ``bundles`` items, each group whole in one. The driver sees sums by item only.
    """
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("group").agg(*sums)
    groups = materialize(groups, "groups")
    total = groups.agg(*(F.sum(d).cast("double").alias(d) for d in DIMENSIONS)).first()
    spark = rows.sparkSession
    if not total["rows"]:
        return rows.withColumn("item", F.lit(None).cast("string")), spark.createDataFrame([], "item string, shard int")
    share = F.greatest(*(F.col(d) / F.lit(max(total[d], 1) / shards) for d in DIMENSIONS))
    large = groups.withColumn("share", share).where(F.col("share") > 1 / PART)
    large = large.select("group", F.when(F.col("share") >= 1, F.ceil(F.col("share") * SLICE)).otherwise(1).cast("long").alias("cuts"))
    large = spark.createDataFrame(large.collect(), "group binary, cuts long")  # 3 * PART * shards rows at most
    own = F.concat(F.lower(F.hex("group")), F.lit("-"), F.pmod(F.xxhash64("_row"), F.col("cuts")))
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string")
    marked = rows.join(F.broadcast(large), "group", "left").withColumn("item", F.when(F.col("cuts").isNull(), bundle).otherwise(own)).drop("cuts")
    found = marked.groupBy("item").agg(*sums).orderBy("item").collect()  # bundles + 3 * shards * (PART + SLICE) rows at most
    values = np.array([[r[d] / (max(total[d], 1) / shards) for d in DIMENSIONS] for r in found])
    where = assign(values, shards)
    return marked, spark.createDataFrame([(r["item"], int(s)) for r, s in zip(found, where, strict=True)], "item string, shard int")


def shard(docs: DataFrame, shards: int = 40, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens), a row for each row of docs.

    Law ``bytes``: shards are even in bytes, and in tokens and rows as far as that lets them be. Equal texts share a shard,
    unless they alone would fill one. ``slot`` numbers a shard's rows from 0 by doc_id, null first; rows that repeat are
    all placed. grown_shard is null, as this law deals anew for another number of shards. No rows give no rows.
    """
    rows = sized(docs, tokenizer, ranks).withColumn("_row", F.monotonically_increasing_id())
    rows, where = plan(materialize(rows, "sized"), shards)
    dealt = rows.join(F.broadcast(where), "item")
    dealt = dealt.select("shard", "doc_id", "text_crc32", "size", "tokens", "_row")
    placed = positions(dealt, ["shard"], ["doc_id", "text_crc32", "_row"], "shards")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
