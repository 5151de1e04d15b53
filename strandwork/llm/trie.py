"""Conversation prefix trie: which conversations begin with the same turns, found by prefix doubling.

Blocks of 2^k turns get dense numbers round by round: a block's number names the pair of numbers of its halves, so equal
numbers mean equal turns. A prefix of d turns is the blocks of d's binary digits, longest first; prefixes with the same
blocks are one node. Rounds follow the logarithm of the longest conversation, and no conversation, node or name is ever
gathered whole in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, positions

WORD = r"[^\x20\x09-\x0D]+"
PIECE = 4096  # turns of a conversation that are summed together, and ends of ranges that are exploded together
CHUNK = 1 << 20  # characters of joined ids that travel as one row


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, ...) -> (conv_id long, i long from 1, key binary, words long), a row for each turn.

    Turns are in order of ``turn``, null first; those that tie in it are ordered by the first 64 characters of role, then
    of text (null as empty), then by a hash. ``key`` is the SHA-256 of role and text, of which null counts as empty. Rows
    without conv_id are of no conversation and left out. Repeated rows are turns of their own.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(role, 1, 64).alias("role"),
        F.substring(text, 1, 64).alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = positions(rows, ["conv_id"], ["turn", "role", "text", "key"], "turns")
    return placed.select("conv_id", (F.col("position") + 1).alias("i"), "key", "words")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilds each conversation c -> (turns, conversations (conv_id)), as the contract of the query asks for.

    The first h turns of conversation c - c % every (all if it has fewer, none if there is no such conversation) come
    before c's own turns after its first h; h is the unsigned CRC-32 of c in decimal, modulo ``most``. Remainders of
    negative numbers are negative, as in SQL. A conversation may end up without turns.
    """
    turns = materialize(turns.withColumns({"host": _host("conv_id", every), "h": _h("conv_id", most)}), "ranked")
    convs = materialize(turns.select("conv_id", "host", "h").distinct(), "conversations")
    opening = turns.where((F.col("conv_id") == F.col("host")) & (F.col("i") < most))
    opening = materialize(opening.select("host", "i", "key", "words"), "openings")
    lent = convs.join(opening, "host").where("i <= h").select("conv_id", "i", "key", "words")
    there = materialize(opening.groupBy("host").agg(F.count("*").alias("there")), "lenders")
    own = turns.where("i > h").join(there, "host", "left")
    lent_n = F.least("h", F.coalesce("there", F.lit(0)))
    own = own.select("conv_id", (F.col("i") - F.col("h") + lent_n).alias("i"), "key", "words")
    return lent.unionByName(own), convs.select("conv_id")


def _host(c: str, every: int) -> Column:
    return F.col(c) - F.col(c) % every


def _h(c: str, most: int) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % most


def dense_names(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, name): a number from 0 without gaps for each distinct combination of ``keys``, in no particular order.

    Distinct combinations are written by any number of tasks; a row's number is its place in its task plus what the
    tasks before it wrote, of which there is one row for each task.
    """
    named = materialize(rows.select(*keys).distinct().withColumn("_at", F.monotonically_increasing_id()), label)
    named = named.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = named.groupBy("_part").agg(F.count("*").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return named.join(parts, "_part").select(*keys, (F.col("_before") + F.col("_at")).alias("name"))


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, i, key) -> (conv_id, k, j, name): every whole block of 2^k turns, the j-th of them (from 0), named by what
    it says. Names compare within one k. A round joins the pairs of half blocks to their names."""
    names = dense_names(turns, ["key"], "names-0")
    now = materialize(turns.join(names, "key").select("conv_id", (F.col("i") - 1).alias("j"), "name"), "blocks-0")
    found, k = [now.withColumn("k", F.lit(0))], 0
    longest = (now.agg(F.max("j")).first()[0] or 0) + 1
    while 2 << k <= longest:
        k += 1
        odd = F.col("j") % 2 == 1
        pairs = now.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right")
        )
        pairs = materialize(pairs.where("left is not null and right is not null"), f"pairs-{k}")
        names = dense_names(pairs, ["left", "right"], f"names-{k}")
        now = materialize(pairs.join(names, ["left", "right"]).select("conv_id", "j", "name"), f"blocks-{k}")
        found.append(now.withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, found)


def _each(first: Column, n: Column) -> tuple[Column, Column]:
    """Two generators, to be exploded after each other, of the numbers first to first + n - 1, never a long array."""
    outer = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / PIECE))
    return F.explode(outer).alias("_c"), F.explode(F.sequence(first + F.col("_c") * PIECE, first + F.least(n, (F.col("_c") + 1) * PIECE) - 1)).alias("d")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, d, names array, words): each conversation's prefixes of d turns, from 0, by the names of their blocks;
    ``words`` are those of the prefix's last turn.

    A block is in the decomposition of those prefixes that end in the block after it, and it comes at an even place.
    """
    n = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    outer, inner = _each((F.col("j") + 1) * F.col("_n"), F.col("_n"))
    even = blocks(turns).where("j % 2 = 0").withColumn("_n", n)
    parts = even.select("conv_id", "k", "j", "name", "_n", outer).select("conv_id", inner, "k", "name")
    parts = parts.withColumn("words", F.lit(None).cast("long"))
    ends = turns.select("conv_id", F.col("i").alias("d"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("name"), "words")
    parts = parts.unionByName(ends)
    block = F.when(F.col("k").isNotNull(), F.struct((-F.col("k")).alias("k"), "name"))
    found = parts.groupBy("conv_id", "d").agg(F.sort_array(F.collect_list(block)).alias("b"), F.max("words").alias("words"))
    found = found.where("words is not null").select("conv_id", "d", F.col("b.name").alias("names"), "words")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.array().cast("array<long>").alias("names"), F.lit(0).cast("long").alias("words"))
    return found.unionByName(root)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, d, conv_id) in order -> comma-joined ids of the same node, in rows of some CHUNK characters."""
    held: list[str] = []
    here: tuple | None = None
    first = size = 0

    def row() -> pa.RecordBatch:
        cols = [pa.array([x], pa.int64()) for x in (*here, first)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([",".join(held)])], ["node", "d", "first", "ids"])

    for batch in batches:
        for node, d, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and ((node, d) != here or size > CHUNK):
                yield row()
                held, size = [], 0
            if not held:
                here, first = (node, d), c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, d, first, ids) in order -> the SHA-256 of each node's ids; only its state is kept between rows."""
    here, state = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([here[0]]), pa.array([here[1]]), pa.array([state.hexdigest()])], ["node", "d", "ends"])

    for batch in batches:
        for node, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if here == (node, d):
                state.update(b",")
            else:
                if here is not None:
                    yield row()
                here, state = (node, d), hashlib.sha256()
            state.update(ids.encode())
    if here is not None:
        yield row()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, d, conv_id) -> (node, d, ends): SHA-256 of the node's conv_ids, ascending, comma-joined. Ids are sorted and
    joined by ranges of node and id, so a node of very many members costs one task only the hashing of joined pieces."""
    keys = ["node", "d", "conv_id"]
    pieces = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = pieces.mapInArrow(_joined, "node long, d long, first long, ids string")
    by_node = pieces.repartition("node", "d").sortWithinPartitions("node", "d", "first")
    return by_node.mapInArrow(_hashed, "node long, d long, ends string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, i from 1, key, words), (conv_id) -> a row for each node of the trie of all conversations' prefixes:

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, words of a node's last turn for each member but one) and ends_sha256 (of the conversations that
    end there). (conv_id, depth) identifies a node, and the node's turns are the first ones of conv_id. ``convs`` names
    every conversation once, also those without turns; no conversations give no rows, not even a root.

    Subtrees are never walked: a node below another is counted by its smallest member, which is a member of both, so
    sums over a subtree are sums over members of what each member's own nodes add from that depth on.
    """
    rows = materialize(prefixes(turns, convs), "prefixes")
    groups = rows.groupBy("d", "names").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    groups = materialize(groups, "groups")
    placed = rows.select("conv_id", "d", "names").join(groups, ["d", "names"]).drop("names")
    placed = materialize(placed.withColumn("adds", F.when(F.col("conv_id") == F.col("node"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)), "placed")
    # What stands above a node: the node one turn shorter of the same smallest member.
    above = placed.select(F.col("conv_id").alias("node"), (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    found = materialize(groups.select("node", "d", "n_convs").join(above, ["node", "d"], "left"), "nodes")
    children = found.where("d > 0").groupBy(F.col("parent").alias("node"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    found = found.join(children, ["node", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    found = materialize(found, "children")
    # What each conversation's own nodes add from each depth on: sums within pieces of its depths, then over pieces.
    leaf = found.where("n_children = 0").select(F.col("node").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    placed = placed.withColumn("_bin", F.floor(F.col("d") / PIECE))
    later = Window.partitionBy("conv_id").orderBy(F.col("_bin").desc())
    bins = placed.groupBy("conv_id", "_bin").agg(F.sum("adds").alias("_all"), F.max("d").alias("_last"))
    bins = bins.select(
        "conv_id", "_bin", F.coalesce(F.sum("_all").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_later"), F.max("_last").over(Window.partitionBy("conv_id")).alias("last")
    )
    bins = materialize(bins.join(leaf, "conv_id", "left"), "pieces")
    inside = Window.partitionBy("conv_id", "_bin").orderBy(F.col("d").desc())
    placed = placed.withColumn("_from", F.sum("adds").over(inside)).join(bins, ["conv_id", "_bin"])
    placed = placed.select("conv_id", "node", "d", "last", (F.col("_from") + F.col("_later")).alias("adds"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    placed = materialize(placed, "sums")
    below = placed.groupBy("node", "d").agg(F.sum("leaf").cast("long").alias("n_leaves"), F.sum("adds").cast("long").alias("saved_tokens"))
    found = found.join(below, ["node", "d"]).join(ends_digest(placed.where("d = last")), ["node", "d"], "left")
    return found.select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """``nodes`` of conversations (conv_id, turn, role, text) as they are."""
    turns = materialize(turns_of(conversations), "turns")
    return nodes(turns, turns.select("conv_id").distinct())
