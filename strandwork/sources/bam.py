"""BAM files as a Spark data source: blocks are read by many tasks, regions through the index, samples side by side.

A BAM file is a chain of small gzip members (BGZF blocks). A place in it is a virtual offset: the byte at which a block
begins, shifted by 16 bits, plus a place in the block's content. A ``.bai`` index beside the file names virtual offsets at which
records of a region begin. Paths are opened with ``pyarrow.fs`` in the tasks; ``readers.bam`` has another way for stores
that only Spark opens.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "chr string, ref_start int, tlen int, sample string"
# Fixed values of the format.
MAGIC, INDEX_MAGIC = b"BAM\x01", b"BAI\x01"
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 0xFF00
LAST = 1 << 29  # positions that an index can name
WINDOW = 14  # bits of a position within a window of the linear index
BINS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))  # bits of a position within a bin, and the first bin, by level

SPLIT_BYTES = 32 << 20


def open_file(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def block_length(head: bytes) -> int | None:
    """Bytes of the block that begins with ``head`` (18 bytes or more), or None if no block does."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """Content of a BGZF file from a virtual offset on, block by block."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.inflated = file, file.size(), 0

    def at(self, offset: int) -> tuple[bytes, int]:
        """The content of the block that begins at byte ``offset``, and the byte after it."""
        head = self.file.read_at(min(1 << 16, self.size - offset), offset)
        length = block_length(head)
        if length is None:
            raise ValueError("not a BGZF block")
        self.inflated += 1
        return zlib.decompress(head[:length], 31), offset + length

    def border(self, offset: int) -> int:
        """The first byte at or after ``offset`` where a block begins; three blocks in a row (or the file's end) prove it."""
        while offset < self.size:
            data = self.file.read_at(min((1 << 16) + 64, self.size - offset), offset)
            at = data.find(BLOCK_MAGIC)
            while 0 <= at < 1 << 16:
                place = offset + at
                for _ in range(3):
                    if place >= self.size:
                        break
                    length = block_length(self.file.read_at(min(64, self.size - place), place))
                    if length is None:
                        place = None
                        break
                    place += length
                if place is not None:
                    return offset + at
                at = data.find(BLOCK_MAGIC, at + 1)
            offset += 1 << 16
        return self.size


@dataclass(frozen=True)
class Header:
    names: tuple[str, ...]
    first: int  # virtual offset of the first record


def header(file: pa.NativeFile) -> Header:
    blocks, data, offset, bounds = Blocks(file), b"", 0, []

    def need(n: int) -> None:
        nonlocal data, offset
        while len(data) < n:
            if offset >= blocks.size:
                raise ValueError("the header of the BAM file is cut off")
            content, following = blocks.at(offset)
            bounds.append((len(data), offset))
            data, offset = data + content, following

    need(8)
    if data[:4] != MAGIC:
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + size)
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    if at == len(data):
        return Header(tuple(names), offset << 16)
    start, block = max(b for b in bounds if b[0] <= at)
    return Header(tuple(names), block << 16 | at - start)


def _chain(data: bytes, at: int, n_refs: int, sure: int = 8) -> bool:
    """Whether records could begin at ``at``: all up to the end of data, one at least, look like records, or ``sure`` do."""
    for i in range(sure):
        if at + 36 > len(data):
            return i > 0
        size, ref, pos, name, _, _, cigars, _, length, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
        if not (-1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name > 0 and length >= 0):
            return False
        if size < 32 + name + 4 * cigars + (length + 1) // 2 + length:
            return False
        if at + 36 + name <= len(data) and (data[at + 35 + name] or not all(33 <= c <= 126 for c in data[at + 36 : at + 35 + name])):
            return False
        at += 4 + size
    return True


def first_record(blocks: Blocks, border: int, n_refs: int) -> int:
    """The virtual offset of the first record that begins in a block at or after byte ``border``."""
    offset = border
    while offset < blocks.size:
        content, following = blocks.at(offset)
        data, ahead = content, following
        while ahead < blocks.size and len(data) < len(content) + (1 << 18):
            more, ahead = blocks.at(ahead)
            data += more
        for at in range(len(content)):
            if _chain(data, at, n_refs):
                return offset << 16 | at
        offset = following
    return blocks.size << 16


def bins(start: int, end: int) -> list[int]:
    """Bins of the index that may hold records that overlap [start, end), 0-based."""
    return [0, *(first + k for bits, first in BINS for k in range(start >> bits, (max(end, start + 1) - 1 >> bits) + 1))]


def own_bin(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    return next((first + (start >> bits) for bits, first in reversed(BINS) if start >> bits == max(end, start + 1) - 1 >> bits), 0)


class Index:
    """A .bai file: of each reference, chunks of virtual offsets by bin, and the least offset by window of 16,384 bases."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != INDEX_MAGIC:
            raise ValueError("not a BAM index")
        self.refs, at = [], 8
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            found, n_bins, at = {}, struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n_bins):
                number, n = struct.unpack_from("<Ii", data, at)
                pairs = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
                at += 8 + 16 * n
                if number < BINS[-1][1] + (1 << 15):  # a larger one holds only counts
                    found[number] = list(zip(pairs[::2], pairs[1::2], strict=True))
            n = struct.unpack_from("<i", data, at)[0]
            self.refs.append((found, struct.unpack_from(f"<{n}Q", data, at + 4)))
            at += 4 + 8 * n

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Stretches of virtual offsets, in order and apart, with every record of ``ref`` that begins in [start, end)."""
        found, windows = self.refs[ref]
        least = windows[min(start >> WINDOW, len(windows) - 1)] if windows else 0
        out: list[list[int]] = []
        for a, b in sorted(c for k in bins(start, end) for c in found.get(k, ()) if c[1] > least):
            a = max(a, least)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(x) for x in out]

    def starts(self) -> list[int]:
        """Virtual offsets at which a record is known to begin."""
        return sorted({x for found, windows in self.refs for x in (*(c[0] for chunks in found.values() for c in chunks), *windows) if x})


@dataclass
class Part(InputPartition):
    path: str
    sample: str
    names: tuple[str, ...]
    start: int  # virtual offsets, or bytes whose first record is to be found
    end: int
    exact: bool
    refs: tuple[int, ...] | None
    low: int
    high: int


def records(blocks: Blocks, start: int, end: int) -> Iterator[np.ndarray]:
    """(n x 3) arrays of reference, position and template length of the records that begin in [start, end)."""
    offset, skip, rest = start >> 16, start & 0xFFFF, b""
    while (offset < end >> 16 or offset == end >> 16 and end & 0xFFFF or rest) and offset < blocks.size:
        content, following = blocks.at(offset)
        # Bytes of this block at which a record may begin: all, or those before the end.
        own = len(content) if offset < end >> 16 else (end & 0xFFFF if offset == end >> 16 else 0)
        data, before = rest + content[skip:], len(rest) - skip
        at, found = 0, []
        while at + 4 <= len(data) and (at - before < own or at < len(rest)):
            size = struct.unpack_from("<i", data, at)[0]
            if at + 4 + size > len(data):
                break
            found.append(at)
            at += 4 + size
        # A record that began before the end is finished with the blocks after it.
        rest = data[at:] if at < len(data) and (at - before < own or at < len(rest)) else b""
        if found:
            fields = np.frombuffer(data, np.uint8)[np.array(found)[:, None] + np.array([*range(4, 12), *range(32, 36)])]
            yield np.ascontiguousarray(fields).view("<i4")
        offset, skip = following, 0


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        names = json.loads(options["samples"]) if "samples" in options else [p.rsplit("/", 1)[-1].removesuffix(".bam") for p in self.paths]
        if len(names) != len(self.paths):
            raise ValueError("each BAM file needs a sample's name")
        self.samples, self.split = names, int(options.get("split_bytes", SPLIT_BYTES))
        self.chrs: set[str] | None = None
        self.low, self.high = 0, LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes chromosomes, positions and samples; Spark tests every row again."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in ("chr", "sample") and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if column == "chr":
                    self.chrs = values if self.chrs is None else self.chrs & values
                else:
                    keep = [(p, s) for p, s in zip(self.paths, self.samples, strict=True) if s in values]
                    self.paths, self.samples = [p for p, _ in keep], [s for _, s in keep]
            elif column == "ref_start" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if column == "ref_start" and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f

    def _index(self, path: str) -> Index | None:
        for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
            try:
                with open_file(name) as file:
                    return Index(file.read())
            except FileNotFoundError:
                pass
        return None

    def partitions(self) -> list[Part]:
        out = []
        for path, sample in zip(self.paths, self.samples, strict=True):
            with open_file(path) as file:
                head, size = header(file), file.size()
            refs = None if self.chrs is None else tuple(i for i, n in enumerate(head.names) if n in self.chrs)
            common = (refs, self.low, self.high)
            narrow = refs is not None or self.low > 0 or self.high < LAST
            if refs == () or self.low >= self.high:
                continue
            index = self._index(path)
            if index is None:
                step = [head.first, *(x << 16 for x in range(((head.first >> 16) // self.split + 1) * self.split, size, self.split)), size << 16]
                out += [Part(path, sample, head.names, a, b, i == 0, *common) for i, (a, b) in enumerate(zip(step, step[1:], strict=False))]
                continue
            wanted = [(head.first, size << 16)]
            if narrow:
                wanted = [c for r in (range(len(head.names)) if refs is None else refs) if r < len(index.refs) for c in index.chunks(r, self.low, self.high)]
            known = index.starts()
            for a, b in wanted:  # cut where records are known to begin
                while (b >> 16) - (a >> 16) > self.split:
                    k = bisect_left(known, (a >> 16) + self.split << 16)
                    if k == len(known) or known[k] >= b:
                        break
                    out.append(Part(path, sample, head.names, a, known[k], True, *common))
                    a = known[k]
                out.append(Part(path, sample, head.names, a, b, True, *common))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = pa.array([*part.names, None], pa.string())
        with open_file(part.path) as file:
            blocks = Blocks(file)
            start, end = part.start, part.end
            if not part.exact:
                start = first_record(blocks, blocks.border(start >> 16), len(part.names))
            if not part.exact or end & 0xFFFF == 0 and end >> 16 < blocks.size:
                end = max(start, blocks.border(end >> 16) << 16) if end >> 16 < blocks.size else end
            for found in records(blocks, start, end):
                keep = (found[:, 0] >= 0) & (found[:, 1] >= part.low) & (found[:, 1] < part.high)
                if part.refs is not None:
                    keep &= np.isin(found[:, 0], part.refs)
                found = found[keep]
                if len(found):
                    cols = [names.take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array([part.sample] * len(found), pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["chr", "ref_start", "tlen", "sample"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class BamWriter(DataSourceWriter):
    """Writes each task's rows, which come sorted by place, as a BAM file with its index into a folder."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.sizes = options["path"].rstrip("/"), [tuple(x) for x in json.loads(options["sizes"])]

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)

    def write(self, rows: Iterator) -> Written:
        number = {name: i for i, (name, _) in enumerate(self.sizes)}
        data, last, index = bytearray(), (0, 0), [({}, []) for _ in self.sizes]
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in self.sizes)
        data += MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.sizes))
        for name, size in self.sizes:
            data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
        fs, folder = self._fs()
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"

        def flush(file: pa.NativeFile, last: bool) -> None:
            nonlocal data, written
            while len(data) >= BLOCK_BYTES or last and data:
                block = bytes(data[:BLOCK_BYTES])
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                body = packer.compress(block) + packer.flush()
                head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
                file.write(head + body + struct.pack("<II", zlib.crc32(block), len(block)))
                written += len(body) + 26
                data = data[BLOCK_BYTES:]

        written, n = 0, 0
        with fs.open_output_stream(f"{folder}/.{name}") as file:
            flush(file, True)
            for row in rows:
                ref, pos, tlen = number[row[0]], row[1], row[2]
                if (ref, pos) < last:
                    raise ValueError("rows have to come in order of chr and ref_start")
                last = (ref, pos)
                begins = written << 16 | len(data)
                flag = 0x1 | 0x2 | (0x10 if tlen < 0 else 0x20)
                body = struct.pack("<iiBBHHHiiii", ref, pos, 2, 255, own_bin(pos, pos + 1), 0, flag, 0, ref, max(0, pos + (tlen if tlen < 0 else 0)), tlen) + b"*\0"
                data += struct.pack("<i", len(body)) + body
                n += 1
                if len(data) >= BLOCK_BYTES:
                    flush(file, False)
                self._note(*index[ref], pos, begins, written << 16 | len(data))
            flush(file, True)
            file.write(END_BLOCK)
        with fs.open_output_stream(f"{folder}/.{name}.bai") as file:
            file.write(self._packed(index))
        if not n:
            fs.delete_file(f"{folder}/.{name}")
            fs.delete_file(f"{folder}/.{name}.bai")
        return Written([name] if n else [])

    def _note(self, chunks: dict[int, list[list[int]]], windows: list[int], pos: int, begin: int, end: int) -> None:
        own = chunks.setdefault(own_bin(pos, pos + 1), [])
        if own and own[-1][1] == begin:
            own[-1][1] = end
        else:
            own.append([begin, end])
        windows += [begin] * ((pos >> WINDOW) + 1 - len(windows))

    def _packed(self, index: list[tuple[dict, list]]) -> bytes:
        out = bytearray(INDEX_MAGIC + struct.pack("<i", len(index)))
        for chunks, windows in index:
            out += struct.pack("<i", len(chunks))
            for k, own in chunks.items():
                out += struct.pack("<Ii", k, len(own)) + b"".join(struct.pack("<QQ", *c) for c in own)
            out += struct.pack(f"<i{len(windows)}Q", len(windows), *windows)
        return bytes(out)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of tasks that ended take their names; what other attempts left stays hidden and is deleted."""
        fs, folder = self._fs()
        for name in (n for m in messages if m for n in m.files):
            for x in (name, f"{name}.bai"):
                fs.move(f"{folder}/.{x}", f"{folder}/{x}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = self._fs()
        for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if os.path.basename(x.path).startswith(".part-"):
                fs.delete_file(x.path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandwork_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))
