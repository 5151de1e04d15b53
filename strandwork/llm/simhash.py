"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordIds, connected_components, list_column, materialize, mix, window_hashes

#: Rows of a bucket that are compared at once; a larger bucket is dealt out as pairs of blocks of this size.
BLOCK = 1024
HALF = 32
#: The same for tables of half segments, which hold any number of rows of different texts: only the keys of a ball meet there.
GROUP = 16 * 1024
#: Bits of half a segment of a wide fingerprint.
WIDE_HALF = 10
#: Rows of the map of ids that ``maybe_among`` broadcasts, and the bits of each (what ``bitmap_construct_agg`` makes).
MAPS, MAP_BITS = 1024, 32 * 1024


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; zero if it has no words.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``words`` words joined by one space
    (all words if there are fewer) and hashed by XXH64 with seed 42. A bit is 1 if it is set in over half of them.
    """
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    k = min(words, n)
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: n - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, n - k + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id long, fp long); fp holds the 64 bits as a signed number. A null text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _spanning(table: np.ndarray, probes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (in table + probes) of links that join what is linked between table and table or table and probe."""
    both, n = np.concatenate([table, probes]), len(table)
    near = np.bitwise_count(table[:, None] ^ both[None, :]) <= radius
    left, links = np.ones(len(both), bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            hit = near[at] & left if at < n else np.concatenate([near[:, at] & left[:n], np.zeros(len(probes), bool)])
            for x in np.flatnonzero(hit).tolist():
                links.append((at, x))
                todo.append(x)
            left &= ~hit
    return links


def _bucket_links(radius: int):
    """For rows (bucket, fp, node, probe) sorted by bucket: links (a, b) between nodes that join each bucket's groups."""

    def of(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bucket, fp, node, probe = rows
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
        two = starts[sizes == 2]
        hit = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & ~(probe[two] & probe[two + 1])
        yield node[two][hit], node[two + 1][hit]
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            is_probe = probe[i : i + n]
            order = np.concatenate([np.flatnonzero(~is_probe), np.flatnonzero(is_probe)]) + i
            n_table = int(n - is_probe.sum())
            if not n_table:
                continue
            for step in range(n_table, n, BLOCK):  # probes in pieces: memory stays bounded
                part = np.concatenate([order[:n_table], order[step : step + BLOCK]])
                links = _spanning(fp[part[:n_table]], fp[part[n_table:]], radius)
                if links:
                    a, b = np.array(links).T
                    yield node[part[a]], node[part[b]]
            if n_table == n and (links := _spanning(fp[order], fp[:0], radius)):
                a, b = np.array(links).T
                yield node[order[a]], node[order[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy().view(np.uint64),
                batch.column(2).to_numpy(),
                batch.column(3).to_numpy(zero_copy_only=False),
            ]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[cut:] for x in rows]
            for a, b in of([x[:cut] for x in rows]) if cut else ():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held is not None and len(held[0]):
            for a, b in of(held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _keys(fp: Column, segment: int) -> Column:
    """The segment's own key, and that key with each set bit cleared: of two keys that differ in one bit, just one has
    it set, so its ball of radius one meets the other's own key."""
    key = F.shiftrightunsigned(fp, HALF) if segment == 0 else fp.bitwiseAND(F.lit((1 << HALF) - 1))
    bits = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        lambda bit: key.bitwiseAND(bit) != 0,
    )
    cleared = F.transform(bits, lambda bit: F.struct((key - bit).alias("key"), F.lit(True).alias("probe")))
    own = F.array(F.struct(key.alias("key"), F.lit(False).alias("probe")))
    return F.transform(
        F.concat(own, cleared), lambda x: F.struct((x["key"] + F.lit(segment << HALF)).alias("key"), x["probe"].alias("probe"))
    )


def near_links(nodes: DataFrame, radius: int = 3, all_within: bool = True) -> DataFrame:
    """(fp long, node long) with distinct fp -> links (a, b) that connect whatever lies within ``radius`` (3 at most) bits.
    With ``all_within`` false, ``radius`` may be larger: links are those of it that differ in one bit at most of a segment.

    The fingerprint has two segments of 32 bits. Two that differ in 3 bits or fewer differ in at most one bit of one
    segment. So each looks up its own key and the keys of a ball of radius one, and whole distances are verified in the
    bucket. A bucket gives links that connect its members, never all its pairs; one of more than BLOCK rows is dealt
    out as pairs of blocks, each a group of its own.
    """
    if all_within and not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find distances of 3 or less")
    rows = nodes.select(
        "fp", "node", F.explode(F.concat(_keys(F.col("fp"), 0), _keys(F.col("fp"), 1))).alias("x")
    ).select(F.col("x.key").alias("key"), "fp", "node", F.col("x.probe").alias("probe"))
    sizes = (
        rows.groupBy("key")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own"))
        .where("n > 1 and own > 0")
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    rows = rows.join(sizes.hint("merge"), "key")  # by file sizes Spark takes either side for a small one, and would send all rows' keys to the driver
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct(F.least(mine, F.col("other")), F.greatest(mine, F.col("other")))
    bucket = F.xxhash64(F.col("key"), pair)
    rows = rows.select(bucket.alias("bucket"), "fp", "node", "probe")
    return (
        rows.repartition(F.col("bucket"))
        .sortWithinPartitions("bucket", "fp", "probe")  # the links of a bucket are the same in every run
        .mapInArrow(_bucket_links(radius), "a long, b long")
    )


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id long, fingerprint string, component_id long), a row for each row of docs.

    component_id is the smallest doc_id that links of ``radius`` bits or fewer reach, the own one included. A null or
    empty text has the fingerprint zero and is linked like any other. Repeated rows are all returned. A row without
    doc_id has a fingerprint but takes no part in linking, and its component_id is null. No rows give no rows.
    """
    fps = materialize(fingerprints(docs, words), "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    roots = connected_components(near_links(nodes, radius))
    placed = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(placed, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def majorities(hashes: np.ndarray, parts: int) -> bytes:
    """64 bits for each part, little-endian: those set in over half of the hashes, mixed anew for each part. Eight bits of
    a word are counted at once, one in each of its bytes, over at most 255 words."""
    keys = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shifts, lanes = np.arange(8, dtype=np.uint64)[:, None, None], np.uint64(0x0101010101010101)
    ones = np.zeros((8, parts, 8), np.int64)  # bit within a byte, part, byte
    for i in range(0, len(hashes), 255):
        words = mix(hashes[i : i + 255, None] ^ keys)
        ones += ((words >> shifts) & lanes).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(8, parts, 8)
    return np.packbits(2 * ones.transpose(1, 2, 0).reshape(-1) > len(hashes), bitorder="little").tobytes()


@dataclass(frozen=True)
class Sketch:
    """What near copies are told by: SimHash fingerprints of ``parts`` times 64 bits over sets of ``words``-word shingles, cut
    into ``segments`` of 20 bits, each of which is looked up with its ball of radius one. ``similarity`` is the one that is
    asked for. Distances of more than ``margin`` standard deviations above the mean at that similarity are no copies, those
    of ``sure`` below it are, and what lies between is decided on whole sets of shingles."""

    words: int = 5
    parts: int = 8
    segments: int = 25
    similarity: float = 0.8
    margin: float = 3.0
    sure: float = 2.5

    def __post_init__(self) -> None:
        if not 0 < self.segments * 2 * WIDE_HALF <= 64 * self.parts:
            raise ValueError("the segments must fit into the fingerprint")

    def differ(self) -> float:
        """The share of bits in which texts of the similarity asked for differ."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    def limits(self) -> tuple[int, int]:
        """The largest distance that is surely a copy's, and the largest that may be one's."""
        p, bits = self.differ(), 64 * self.parts
        spread = math.sqrt(bits * p * (1 - p))
        return max(0, int(bits * p - self.sure * spread)), int(bits * p + self.margin * spread)

    def chance(self) -> float:
        """The share of pairs of the similarity asked for that differ in one bit at most of some segment."""
        p, n = self.differ(), 2 * WIDE_HALF
        return 1 - (1 - (1 - p) ** n - n * p * (1 - p) ** (n - 1)) ** self.segments

    def cut(self, fps: list[bytes]) -> np.ndarray:
        """Fingerprints -> the segments of each, as numbers, one row after the other."""
        n = self.segments * 2 * WIDE_HALF
        bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")[:, :n]
        return bits.reshape(-1, 2 * WIDE_HALF).astype(np.int32) @ (1 << np.arange(2 * WIDE_HALF, dtype=np.int32))


def shingle_set(text: str | None, words: int, ids: WordIds) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles: A-Z are lower-cased, a text of fewer than ``words`` words is one shingle,
    and texts without words have the same set of one."""
    found = ids.of((text or "").encode().lower().split())
    return np.unique(window_hashes(found, min(words, len(found)))) if len(found) else np.zeros(1, np.uint64)


def sketches(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(doc_id, text) -> (doc_id long, same binary, fp binary, segments array): ``same`` is 128 bits of hash of the ``shingle_set``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            same, fps = [], []
            for x in batch.column(1):
                hashes = shingle_set(x.as_py(), sketch.words, ids)
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fps.append(majorities(hashes, sketch.parts))
            values = sketch.cut(fps) if fps else np.empty(0, np.int32)
            cols = [batch.column(0), pa.array(same, pa.binary()), pa.array(fps, pa.binary()), list_column([sketch.segments] * len(fps), values, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "same", "fp", "segments"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, same binary, fp binary, segments array<int>")


def _far(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ fp).sum(axis=1, dtype=np.int64)


def _joined_in(fps: np.ndarray, sure: int, limit: int) -> Iterator[tuple[int, int, bool]]:
    """Fingerprints (n x parts) -> links that join all of them as far as distances of ``limit`` or fewer do.

    First whatever chains of sure distances join; then these groups grow together, always by the smallest distance that
    is left, and such links are not sure.
    """
    group, n = np.full(len(fps), -1), 0
    for root in range(len(fps)):
        if group[root] >= 0:
            continue
        group[root], todo = n, [root]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(group < 0)
            hit = rest[_far(fps[rest], fps[at]) <= sure]
            group[hit] = n
            todo += hit.tolist()
            yield from ((at, x, True) for x in hit.tolist())
        n += 1
    others = np.arange(len(fps)) if n > 1 else np.empty(0, int)
    while len(others):
        new = others[group[others] == group[others[0]]]
        others = np.setdiff1d(others, new)
        best, by = np.full(len(others), np.iinfo(np.int64).max), np.zeros(len(others), int)
        while len(others):
            if len(new) <= len(others):
                for x in new.tolist():
                    far = _far(fps[others], fps[x])
                    near = far < best
                    best[near], by[near] = far[near], x
            else:
                for k, x in enumerate(others.tolist()):
                    far = _far(fps[new], fps[x])
                    if far.min() < best[k]:
                        best[k], by[k] = far.min(), new[far.argmin()]
            k = int(best.argmin())
            if best[k] > limit:
                break
            yield int(by[k]), int(others[k]), False
            joins = group[others] == group[others[k]]
            new, others, best, by = others[joins], others[~joins], best[~joins], by[~joins]


def _ball(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes -> row, first, n: the n rows from ``first`` on have the row's code or the code with one bit of its last
    WIDE_HALF cleared. Of two codes that differ in one bit, just one has it set, so each pair of rows comes once."""
    at = np.arange(len(code))
    row, first, end = [at], [at + 1], [np.searchsorted(code, code, "right")]
    for bit in range(WIDE_HALF):
        has = np.flatnonzero(code >> bit & 1)
        key = code[has] - (1 << bit)
        row.append(has)
        first.append(np.searchsorted(code, key, "left"))
        end.append(np.searchsorted(code, key, "right"))
    row, first, end = map(np.concatenate, (row, first, end))
    met = end > first
    return row[met], first[met], (end - first)[met]


def _pairs(row: np.ndarray, first: np.ndarray, n: np.ndarray, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows that ``_ball`` tells of, some at a time."""
    ends = np.cumsum(n)
    for start in range(0, int(ends[-1]) if len(ends) else 0, at_once):
        pair = np.arange(start, min(start + at_once, int(ends[-1])))
        k = np.searchsorted(ends, pair, "right")
        yield row[k], first[k] + pair - (ends[k] - n[k])


def _by_bucket(of, parts: int):
    """Calls ``of`` for rows (code, node, fp, ...) sorted by code, as arrays, with all rows of a bucket at once. The last
    WIDE_HALF bits of a code are the key within the bucket that the others name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last bucket, by batch
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, parts)
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), fps, *(c.to_numpy() for c in batch.columns[3:])]
            name = rows[0] >> WIDE_HALF
            if held and name[-1] == held[0][0][0] >> WIDE_HALF:
                held.append(rows)
                continue
            rows = [np.concatenate(x) for x in zip(*held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0] >> WIDE_HALF, name[-1]))
            held = [[x[cut:] for x in rows]]
            if cut:
                yield from of(*(x[:cut] for x in rows))
        if held:
            yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _unsettled(n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The members (of 0 to n - 1) of those trees of links (a, b) that have a link which is not ``known``."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    asked = {find(x) for x in a[~known].tolist()}
    return np.array([x for x in range(n) if find(x) in asked], int)


def _wide_links(parts: int, sure: int, limit: int, most: int = 256):
    """For rows (code, node, fp) sorted by code: links (a, b, sure) between nodes of a bucket that meet in a ball, by whole
    distances. A bucket where more than ``most`` rows meet a row, or with more links than rows, gives links that join its
    members, and a row (a, a, false) for each member that may have further links which are not sure, see ``left_links``."""

    def of(code: np.ndarray, node: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        name = code >> WIDE_HALF
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(code)]]))
        bucket = np.repeat(np.arange(len(starts)), sizes)
        row, first, n = _ball(code)
        full = np.bincount(bucket[row], n, len(starts)) > most * sizes
        some = ~full[bucket[row]]
        x, y, far = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)]
        for a, b in _pairs(row[some], first[some], n[some]):
            found = _far(fps[a], fps[b])
            near = found <= limit
            x.append(a[near])
            y.append(b[near])
            far.append(found[near])
        x, y, far = map(np.concatenate, (x, y, far))
        full |= np.bincount(bucket[x], minlength=len(starts)) > sizes
        some = ~full[bucket[x]]
        out = [(node[x[some]], node[y[some]], far[some] <= sure)]
        for k in np.flatnonzero(full).tolist():
            i = starts[k]
            if links := list(_joined_in(fps[i : i + sizes[k]], sure, limit)):
                a, b, known = map(np.array, zip(*links, strict=True))
                out.append((node[a + i], node[b + i], known))
                if not known.all():
                    open_ = node[_unsettled(sizes[k], a, b, known) + i]
                    out.append((open_, open_, np.zeros(len(open_), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "sure"])

    return _by_bucket(of, parts)


def _left_links(parts: int, limit: int):
    """For rows (code, node, fp, root) sorted by code: all pairs (a, b) of nodes that meet in a ball and have different roots."""

    def of(code: np.ndarray, node: np.ndarray, fps: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _pairs(*_ball(code)):
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            near = _far(fps[a], fps[b]) <= limit
            yield pa.RecordBatch.from_arrays([pa.array(node[a[near]]), pa.array(node[b[near]])], ["a", "b"])

    return _by_bucket(of, parts)


def _halves(segments: Column) -> Column:
    """A row for each half of each segment: ``key``, which half of which segment and its bits, and ``rest``, the other half's bits."""
    low = (1 << WIDE_HALF) - 1

    def two(x: Column, i: Column) -> Column:
        high, rest = F.shiftright(x, WIDE_HALF), x.bitwiseAND(low)
        named = [((2 * i + half) * (low + 1) + bits, other) for half, bits, other in ((0, high, rest), (1, rest, high))]
        return F.array(*(F.struct(key.cast("long").alias("key"), other.cast("long").alias("rest")) for key, other in named))

    return F.flatten(F.transform(segments, two))


def _dealt(nodes: DataFrame) -> DataFrame:
    """(node, fp, segments, ...) -> (code, node, fp, ...), a row for each half of each segment, sorted by code within a task.

    A segment is looked up with its ball of radius one. Segments that differ in one bit at most agree in one half, so a
    node is dealt to a table for each half of each segment, and meets there the keys of the ball in the other half. A table
    of more than GROUP rows is dealt out as pairs of blocks.
    """
    names = ["node", "fp", *(c for c in nodes.columns if c not in ("node", "fp", "segments"))]
    rows = nodes.select(*names, F.explode(_halves(F.col("segments"))).alias("x")).select(*names, "x.key", "x.rest")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "key")  # 2 * segments * 2^WIDE_HALF rows at most
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.shiftleft("key", 32) + F.shiftleft(F.least(mine, F.col("other")).cast("long"), 16) + F.greatest(mine, F.col("other"))
    rows = rows.select((F.shiftleft(name, WIDE_HALF) + F.col("rest")).alias("code"), *names)
    return rows.repartition(F.shiftright("code", WIDE_HALF)).sortWithinPartitions("code", "node")


def wide_links(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """(node long, fp binary, segments array) -> links (a, b, sure) of nodes by multi-index hashing.

    Whole distances are verified within the bucket, all of them, before links are thinned to those that join its members by
    the smallest distances. A row (a, a, false) tells that a is in a group that was thinned and has links that are not sure.
    """
    return _dealt(nodes.select("node", "fp", "segments")).mapInArrow(_wide_links(sketch.parts, *sketch.limits()), "a long, b long, sure boolean")


def left_links(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """(node long, fp binary, segments array, root long) -> all pairs (a, b) that meet in a ball, may be near by their whole
    distance and have different roots: what thinned groups are still to be asked for when a link that joined them was none."""
    rows = _dealt(nodes.select("node", "fp", "segments", "root")).mapInArrow(_left_links(sketch.parts, sketch.limits()[1]), "a long, b long")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def maybe_among(doc_id: Column, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``maybe`` to docs: true wherever ``doc_id`` is one of the rows (doc_id) of ids, false for nearly all others and for null.

    Ids are told by a bit each of a map of 2^25 bits (4 MB) in MAPS rows, which is broadcast whatever the number of ids. So
    docs stay where they are, and what an exact join must shuffle is only what may be among ids.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"))
    bits = ids.select(F.pmod(key, F.lit(MAPS)).alias("_map"), F.pmod(F.shiftright(key, 32), F.lit(MAP_BITS)).alias("_bit"))
    bits = bits.repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))  # ids are shuffled, not maps
    key = F.xxhash64(doc_id.cast("long"))
    bit = F.pmod(F.shiftright(key, 32), F.lit(MAP_BITS))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = docs.withColumn("_map", F.pmod(key, F.lit(MAPS))).join(F.broadcast(bits), "_map", "left")
    hit = F.call_function("shiftright", byte, bit.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return met.withColumn("maybe", doc_id.isNotNull() & F.coalesce(hit, F.lit(False))).drop("_map", "_bits")


def similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of doc_ids -> those pairs whose sets of shingles have a Jaccard similarity of ``similarity`` or more, exactly.
    Only the documents of pairs are read again; the texts of others are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_set(text.as_py(), words, ids).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), list_column([len(hashes)], hashes, pa.int64())], ["doc_id", "s"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = maybe_among(F.col("doc_id"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), asked).where("maybe")
    some = some.select("doc_id", "text").join(asked, "doc_id", "left_semi")
    sets = materialize(some.mapInArrow(run, "doc_id long, s array<long>"), "sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    met = met.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_copies(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id long, component_id long), a row for each row with a doc_id.

    component_id is the smallest doc_id that links reach, the own one included. Texts are linked that have the same set of
    shingles, or meet in the ball of a segment (``wide_links``) and have fingerprints whose distance is surely that of copies,
    or may be and their sets are similar enough. Groups that ``wide_links`` thinned are first asked for the links that would
    join them; whatever these leave apart is then compared pair by pair (``left_links``). The driver gets nothing but counts.
    """
    sketch = sketch or Sketch()
    docs = docs.where("doc_id is not null")

    def alike(pairs: DataFrame) -> DataFrame:
        return similar(pairs, docs, sketch.words, sketch.similarity)

    found = materialize(sketches(docs, sketch), "sketches")
    nodes = found.groupBy("same").agg(F.min("doc_id").alias("node"), F.any_value("fp").alias("fp"), F.any_value("segments").alias("segments"))
    nodes = materialize(nodes, "nodes")
    links = wide_links(nodes, sketch)
    links = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_or("sure").alias("sure"))
    links = materialize(links, "links")
    sure = links.where("sure").select("a", "b")
    roots = connected_components(sure.unionByName(alike(links.where("not sure and a <> b").select("a", "b"))))
    some = nodes.join(links.where("a = b").select(F.col("a").alias("node")).hint("merge"), "node", "left_semi")
    more = left_links(some.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), sketch)
    more = materialize(more, "more")
    if not more.isEmpty() and not (more := materialize(alike(more), "more")).isEmpty():
        roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    placed = nodes.select("same", "node").join(roots, "node", "left")
    return found.select("doc_id", "same").join(placed.select("same", F.coalesce("root", "node").alias("component_id")), "same").select("doc_id", "component_id")


def keep_one_near(docs: DataFrame, sketch: Sketch | None = None) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, in docs' columns.

    Rows that share a doc_id are copies of one document, of which one row stays. Rows without doc_id all stay.
    """
    return _first_of(docs, near_copies(docs.select("doc_id", "text"), sketch))


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, in docs' columns.

    Rows that share a doc_id are copies of one document, of which one row stays. Rows without doc_id all stay.
    """
    return _first_of(docs, near_duplicates(docs.select("doc_id", "text"), words, radius))


def _first_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows that are dropped. A document that is alone with its doc_id and the first of its group stays where
    it is; only the rows that may be others are shuffled."""
    first = F.bool_or(F.col("doc_id") == F.col("component_id"))
    told = found.where("doc_id is not null").groupBy("doc_id").agg(first.alias("first"), (F.count("*") > 1).alias("repeated"))
    told = materialize(told, "told")
    names = [f"`{c}`" for c in docs.columns]
    met = maybe_among(F.col("doc_id"), docs.select(F.struct(*names).alias("row"), "doc_id"), told.where("repeated or not first"))
    kept = met.where("maybe").join(told.where("first"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return met.where("not maybe").select("row.*").unionByName(kept.select("row.*"))
