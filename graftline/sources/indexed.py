"""Indexed BAM as a Spark data source: region reads that touch only their chunks, and a writer that makes the index.

A table is a folder of BAM files, each a range of (contig, place) with its index
beside it, and a manifest of these ranges.  Tasks write blocks, records and index
of their own file; the driver's commit only renames files and writes the manifest.  A region
read looks up the manifest, then the indexes of the files that it leaves, and makes
partitions of the chunks these name: nothing else of a file is read.

Files are opened through Arrow's file systems, by path or URI.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .bam import _BASES, _BLOCK, _OPS, _Stream, header, sam_line
from .files import parse_sam

FORMAT = "indexed_bam"
SCHEMA = "contig string, ref_start int, ref_end int, value string"
#: Bytes of a block before compression, bytes of chunks that a partition reads, and a gap that is read through rather than jumped.
BLOCK_BYTES = 65280
PARTITION_BYTES = 32 << 20
GAP_BYTES = 1 << 16
#: Fixed values of the format: the block that ends a file, the depth of the bins and the bases of the smallest bin.
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_LEVELS, _SMALLEST = 5, 14
_REFERENCE_OPS = frozenset("MDN=X")


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds a range: bins of eight levels' widths, each level numbered after the one above."""
    last = max(end, start + 1) - 1
    for level in range(_LEVELS, -1, -1):
        shift = _SMALLEST + 3 * (_LEVELS - level)
        if start >> shift == last >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> Iterator[int]:
    """All bins that may hold what overlaps a range."""
    last = max(end, start + 1) - 1
    for level in range(_LEVELS + 1):
        shift, first = _SMALLEST + 3 * (_LEVELS - level), ((1 << 3 * level) - 1) // 7
        yield from range(first + (start >> shift), first + (last >> shift) + 1)


class Index:
    """Chunks by contig and bin, and the first place of each window of the smallest width."""

    def __init__(self, contigs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(contigs)]
        self.first: list[list[int]] = [[] for _ in range(contigs)]

    def add(self, contig: int, start: int, end: int, begin: int, stop: int) -> None:
        """A record and the virtual places where it begins and stops; records come in order."""
        chunks = self.bins[contig].setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        windows, last = self.first[contig], (max(end, start + 1) - 1) >> _SMALLEST
        while len(windows) <= last:
            windows.append(begin if len(windows) >= start >> _SMALLEST else 0)

    def chunks(self, contig: int, start: int, end: int) -> list[tuple[int, int]]:
        """What has to be read for a range, in order and joined where it meets."""
        windows = self.first[contig]
        if not self.bins[contig]:
            return []
        least = next((v for v in windows[start >> _SMALLEST :] if v), None) if start >> _SMALLEST < len(windows) else None
        if least is None and start >> _SMALLEST >= len(windows):
            return []
        found = sorted((a, b) for k in bins_over(start, end) for a, b in self.bins[contig].get(k, []) if b > (least or 0))
        return joined(found, 0)

    def dump(self) -> bytes:
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.first, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for k, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows))
        return b"".join(out)

    @staticmethod
    def load(data: bytes) -> Index:
        if data[:4] != b"BAI\1":
            raise ValueError("not a BAM index")
        at = 8
        out = Index(struct.unpack_from("<i", data, 4)[0])
        used, k = np.flatnonzero(np.frombuffer(data, np.uint8)), -1
        while (k := k + 1) < len(out.bins):
            if data[at : at + 8] == bytes(8):
                # Most contigs of a file may be empty: all up to the next one that isn't.
                j = int(np.searchsorted(used, at))
                empty = min(((int(used[j]) if j < len(used) else len(data)) - at) // 8, len(out.bins) - k)
                at, k = at + 8 * empty, k + empty - 1
                continue
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                number, chunks = struct.unpack_from("<Ii", data, at)
                at += 8
                if number <= ((1 << 3 * (_LEVELS + 1)) - 1) // 7:  # beyond is a summary some writers add
                    out.bins[k][number] = [list(struct.unpack_from("<QQ", data, at + 16 * c)) for c in range(chunks)]
                at += 16 * chunks
            (n,) = struct.unpack_from("<i", data, at)
            out.first[k] = list(struct.unpack_from(f"<{n}Q", data, at + 4))
            at += 4 + 8 * n
        return out


def joined(chunks: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Sorted chunks of virtual places, joined where their blocks are within a gap."""
    out: list[tuple[int, int]] = []
    for a, b in chunks:
        if out and (a <= out[-1][1] or (a >> 16) - (out[-1][1] >> 16) < gap):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Blocks:
    """A block-compressed file being written."""

    def __init__(self, file):
        self.file, self.at, self.held = file, 0, bytearray()

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        for k in range(0, len(data), BLOCK_BYTES):
            part = data[k : k + BLOCK_BYTES]
            if len(self.held) + len(part) > BLOCK_BYTES:
                self.flush()
            self.held += part

    def flush(self) -> None:
        if self.held:
            squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = squeeze.compress(bytes(self.held)) + squeeze.flush()
            block = _BLOCK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(self.held), len(self.held))
            self.file.write(block)
            self.at += len(block)
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.file.write(_END)
        self.file.close()


_CODES = np.full(256, 15, np.uint8)
for _k, _c in enumerate(_BASES):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _k


def encode(row: dict, number: dict[str, int]) -> tuple[bytes, int, int, int]:
    """(record with its size, contig number, start, end) of an alignment; what is null stays out."""
    contig = number[row["contig"]] if row["contig"] is not None else -1
    start = row["ref_start"] if row["ref_start"] is not None else -1
    cigar, seq, quals = row["cigar"] or [], row["seq"] or "", row["quals"]
    if len(cigar) > 0xFFFF:
        raise ValueError("a CIGAR of over 65,535 operations")
    end = start + sum(c["len"] for c in cigar if c["op"] in _REFERENCE_OPS)
    flag = row["flag"] or 0
    for bit, name in ((0x10, "is_reverse"), (0x4, "is_unmapped"), (0x8, "mate_is_unmapped")):
        flag = flag & ~bit | (bit if row[name] else 0)
    name = (row["read_name"] or "*").encode() + b"\0"
    codes = _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    codes = np.append(codes, 0) if len(codes) % 2 else codes
    tags = b""
    for tag, kind, column in (("MD", "Z", "md"), ("NM", "i", "nm"), ("AS", "i", "as_score"), ("MT", "Z", "mate_seq"), ("MQ", "Z", "mate_quals")):
        value = row[column]
        if value is not None:
            tags += tag.encode() + kind.encode() + (struct.pack("<i", value) if kind == "i" else value.encode() + b"\0")
    body = b"".join(
        [
            struct.pack("<iiBBHHHiiii", contig, start, len(name), min(row["mapq"] or 0, 255), bin_of(max(start, 0), end), len(cigar), flag, len(seq), -1, -1, 0),
            name,
            struct.pack(f"<{len(cigar)}I", *(c["len"] << 4 | _OPS.index(c["op"]) for c in cigar)),
            (codes[::2] << 4 | codes[1::2]).astype(np.uint8).tobytes(),
            bytes(quals) if quals and len(quals) == len(seq) else b"\xff" * len(seq),
            tags,
        ]
    )
    return struct.pack("<i", len(body)) + body, contig, start, end


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each) of a string array without nulls."""
    _, ends, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values), np.int64)
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _lists(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(elements, length of each) of a list array, nulls empty."""
    return values.flatten(), np.nan_to_num(values.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes that begin at these places, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``bin_of`` of many ranges."""
    last, out = np.maximum(end, start + 1) - 1, np.zeros(len(start), np.int64)
    for level in range(_LEVELS + 1):
        shift = _SMALLEST + 3 * (_LEVELS - level)
        out = np.where(start >> shift == last >> shift, ((1 << 3 * level) - 1) // 7 + (start >> shift), out)
    return out


def encode_batch(batch: pa.RecordBatch, number: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """(records with their sizes, start, end) of alignments on contigs of these numbers; the bytes of ``encode`` for all rows at once.

    None for what only a look at each row can decide: other letters than ASCII, empty names, qualities that are null or no bytes.
    """
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    n = batch.num_rows
    whole = lambda c, none: pc.fill_null(column(c), none).to_numpy(zero_copy_only=False).astype(np.int64)
    start, mapq, flag = whole("ref_start", -1), np.minimum(whole("mapq", 0), 255), whole("flag", 0)
    for bit, c in ((0x10, "is_reverse"), (0x4, "is_unmapped"), (0x8, "mate_is_unmapped")):
        flag = flag & ~bit | np.where(pc.fill_null(column(c), False).to_numpy(zero_copy_only=False), bit, 0)
    ops, n_ops = _lists(column("cigar"))
    kind = pc.index_in(ops.field("op"), value_set=pa.array(list(_OPS)))
    seq, n_seq = _flat(pc.fill_null(column("seq"), ""))
    quals, n_quals = _lists(column("quals"))
    if kind.null_count or ops.field("len").null_count or ops.null_count or quals.null_count or (seq > 127).any() or (n_ops > 0xFFFF).any() or (flag < 0).any() or (flag > 0xFFFF).any() or (mapq < 0).any():
        return None
    kind, size, quals = kind.to_numpy(zero_copy_only=False).astype(np.int64), ops.field("len").to_numpy(zero_copy_only=False).astype(np.int64), quals.to_numpy(zero_copy_only=False)
    if len(quals) and (quals.min() < 0 or quals.max() > 255):
        return None
    span = np.where(np.isin(kind, [_OPS.index(o) for o in _REFERENCE_OPS]), size, 0)
    total = np.concatenate([[0], np.cumsum(span)])
    first = np.concatenate([[0], np.cumsum(n_ops)])
    end = start + total[first[1:]] - total[first[:-1]]
    name, n_name = _flat(pc.fill_null(column("read_name"), "*"))
    if not n_name.all():
        return None
    half = (n_seq + 1) // 2
    tags = []
    for tag, letter, c in (("MD", "Z", "md"), ("NM", "i", "nm"), ("AS", "i", "as_score"), ("MT", "Z", "mate_seq"), ("MQ", "Z", "mate_quals")):
        there = pc.is_valid(column(c)).to_numpy(zero_copy_only=False)
        text, sizes = _flat(pc.fill_null(column(c), "")) if letter == "Z" else (whole(c, 0).astype("<i4").view(np.uint8).reshape(n, 4)[there].ravel(), np.where(there, 4, 0))
        tags.append((np.frombuffer((tag + letter).encode(), np.uint8), there, text, sizes, np.where(there, 3 + sizes + (letter == "Z"), 0)))
    lengths = 36 + n_name + 1 + 4 * n_ops + half + n_seq + sum(x[4] for x in tags)
    ends = np.cumsum(lengths)
    begin = ends - lengths
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    fixed = np.zeros(n, np.dtype([(k, t) for k, t in zip("abcdefghijkl", ("<i4", "<i4", "<i4", "u1", "u1", "<u2", "<u2", "<u2", "<i4", "<i4", "<i4", "<i4"), strict=True)]))
    for k, x in zip("abcdefghijkl", (lengths - 4, number, start, n_name + 1, mapq, _bins(np.maximum(start, 0), end), n_ops, flag, n_seq, -1, -1, 0), strict=True):
        fixed[k] = x
    out[begin[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    at = begin + 36
    out[_within(at, n_name)] = name
    at = at + n_name + 1
    out[_within(at, 4 * n_ops)] = (size << 4 | kind).astype("<u4").view(np.uint8)
    at = at + 4 * n_ops
    padded = np.zeros(int(2 * half.sum()), np.uint8)
    padded[_within(2 * (np.cumsum(half) - half), n_seq)] = _CODES[seq]
    out[_within(at, half)] = padded[::2] << 4 | padded[1::2]
    at = at + half
    has = (n_quals == n_seq) & (n_seq > 0)
    out[_within(at[~has], n_seq[~has])] = 255
    out[_within(at[has], n_seq[has])] = quals[np.repeat(has, n_quals)].astype(np.uint8)
    at = at + n_seq
    for lead, there, text, sizes, whole_size in tags:
        out[at[there][:, None] + np.arange(3)] = lead
        out[_within(at + 3, sizes)] = text
        at = at + whole_size
    records = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out)])
    return records.cast(pa.binary()), start, end


def _encoded(contigs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Alignments, whose columns _number and _start tell their places, as (_number, _start, _end, read_name, flag, record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            number = column("_number").to_numpy()
            made = encode_batch(batch, np.where(number == contigs, -1, number))
            if made is None:
                rows = [encode(row, {row["contig"]: row["_number"]}) for row in batch.to_pylist()]
                made = pa.array([r[0] for r in rows], pa.binary()), None, np.array([r[3] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([column("_number"), column("_start"), pa.array(made[2].astype(np.int32)), column("read_name"), column("flag"), made[0]], names=["_number", "_start", "_end", "read_name", "flag", "record"])

    return run


@dataclass
class Written(WriterCommitMessage):
    """A task's file under its temporary name, its records, and (contig number, place) of the first and last."""

    name: str | None
    rows: int = 0
    first: tuple[int, int] | None = None
    last: tuple[int, int] | None = None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.contigs = json.loads(options["contigs"])

    @property
    def staged(self) -> str:
        return f"_temporary/{self.run}"

    def _records(self, batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
        """(record with its size, contig number, start, end) of alignments, or of rows whose records were made before."""
        number = {c: k for k, (c, _) in enumerate(self.contigs)} if "record" not in batch.schema.names else {}
        if number or "record" not in batch.schema.names:
            yield from (encode(row, number) for row in batch.to_pylist())
        else:
            n = len(self.contigs)
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("record", "_number", "_start", "_end")]
            yield from ((r, -1 if k == n else k, a, b) for r, k, a, b in zip(*columns, strict=True))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, top = _fs(self.path)
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in self.contigs)
        out, index, done = None, Index(len(self.contigs)), Written(None)
        for batch in batches:
            for record, contig, start, end in self._records(batch):
                if out is None:
                    # An attempt's own name: a lost attempt leaves a file that no commit names.
                    done.name = uuid.uuid4().hex
                    fs.create_dir(f"{top}/{self.staged}", recursive=True)
                    out = _Blocks(fs.open_output_stream(f"{top}/{self.staged}/{done.name}.bam"))
                    raw = text.encode()
                    out.write(b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(self.contigs)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in self.contigs))
                    out.flush()
                place = (contig if contig >= 0 else len(self.contigs), start)
                if done.last is not None and place < done.last:
                    raise ValueError("alignments must come in order of contig and place")
                if len(out.held) + len(record) > BLOCK_BYTES:
                    out.flush()
                begin = out.tell()
                out.write(record)
                if contig >= 0 and start >= 0:
                    index.add(contig, start, end, begin, out.tell())
                done.first, done.last, done.rows = done.first or place, place, done.rows + 1
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{top}/{self.staged}/{done.name}.bam.bai") as file:
                file.write(index.dump())
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        made = sorted((m for m in messages if m is not None and m.name), key=lambda m: (m.first, m.last))
        old = [] if self.overwrite else _manifest(fs, top)["files"]
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(top)):
                if info.is_file:
                    fs.delete_file(info.path)
        for m in made:
            for end in (".bam", ".bam.bai"):
                fs.move(f"{top}/{self.staged}/{m.name}{end}", f"{top}/part-{m.name}{end}")
        files = old + [{"name": f"part-{m.name}.bam", "rows": m.rows, "first": m.first, "last": m.last} for m in made]
        with fs.open_output_stream(f"{top}/_manifest.json") as file:
            file.write(json.dumps({"contigs": self.contigs, "files": files}).encode())
        self._clear(fs, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_fs(self.path))

    def _clear(self, fs: pafs.FileSystem, top: str) -> None:
        if fs.get_file_info(f"{top}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/{self.staged}")
            if not fs.get_file_info(pafs.FileSelector(f"{top}/_temporary")):  # no other run is writing
                fs.delete_dir(f"{top}/_temporary")


def _manifest(fs: pafs.FileSystem, top: str) -> dict:
    """The manifest of a folder; files that others wrote are known by name only."""
    if fs.get_file_info(f"{top}/_manifest.json").is_file:
        with fs.open_input_file(f"{top}/_manifest.json") as file:
            return json.loads(file.read())
    if fs.get_file_info(top).type == pafs.FileType.NotFound:
        return {"contigs": [], "files": []}
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(top)) if i.base_name.endswith(".bam")]
    return {"contigs": None, "files": [{"name": n, "first": None, "last": None} for n in sorted(names)]}


class Source:
    """Random reads of one file; ``read_bytes`` counts what was read."""

    def __init__(self, path: str):
        fs, top = _fs(path)
        self.file, self.read_bytes = fs.open_input_file(top), 0

    def read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.read_bytes += len(data)
        return data

    def blocks(self, at: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
        """(place, bytes) of the blocks from a place on, up to the one that begins at ``end``, included."""
        self.file.seek(at)
        while (end is None or at <= end) and len(lead := self.read(18)) == 18:
            if lead[:4] != _BLOCK[:4] or lead[12:14] != _BLOCK[12:14]:
                raise ValueError("not a block of a BAM file")
            size = struct.unpack_from("<H", lead, 16)[0] + 1
            yield at, zlib.decompress(self.read(size - 18)[:-8], -15)
            at += size


class Part(InputPartition):
    """Chunks of a file, none for all of it; the contigs' names, which may be many, are read from its header."""

    def __init__(self, path: str, chunks: list[tuple[int, int]], regions: dict[int, list[tuple[int, int]]]):
        super().__init__(None)
        self.path, self.chunks, self.regions = path, chunks, regions


def records(source: Source, chunk: tuple[int, int]) -> Iterator[bytes]:
    """The records, without their sizes, of a chunk of virtual places; its blocks and no others are read."""
    (first, skip), (last, stop) = (divmod(v, 1 << 16) for v in chunk)
    held, at = bytearray(), skip
    for place, data in source.blocks(first, last):
        if place == last:
            data = data[:stop] if stop else b""
        held += data
        while at + 4 <= len(held):
            size = struct.unpack_from("<i", held, at)[0]
            if at + 4 + size > len(held):
                break
            yield bytes(held[at + 4 : at + 4 + size])
            at += 4 + size
        del held[:at]
        at = 0
    if held:
        raise ValueError("a chunk ends within a record")


class _Reader(DataSourceReader):
    """Regions come from the option ``regions`` ([[contig, start, end], ...]); without any, files are read whole."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.regions = [tuple(r) for r in json.loads(options["regions"])] if "regions" in options else None
        self.names: set[str] | None = None
        self.low, self.high = 0, 1 << 29
        self.read_bytes = 0

    def _wanted(self, contigs: list[str]) -> dict[int, list[tuple[int, int]]] | None:
        if self.regions is None and self.names is None:
            return None
        number = {c: k for k, c in enumerate(contigs)}
        out: dict[int, list[tuple[int, int]]] = {}
        for c, a, b in self.regions if self.regions is not None else [(c, 0, 1 << 29) for c in self.names]:
            a, b = max(a, self.low), min(b, self.high)
            if c in number and a < b and (self.names is None or c in self.names):
                out.setdefault(number[c], []).append((a, b))
        return out

    def partitions(self) -> list[Part]:
        fs, top = _fs(self.path)
        single = fs.get_file_info(top).is_file
        known = {"contigs": None, "files": [{"name": None, "first": None, "last": None}]} if single else _manifest(fs, top)
        out, listed, ordered = [], None, []
        if known["contigs"] is not None:
            listed = self._wanted([c for c, _ in known["contigs"]])
            ordered = sorted(listed or ())
        for entry in known["files"]:
            path = self.path if single else f"{self.path.rstrip('/')}/{entry['name']}"
            source = Source(path)
            if known["contigs"] is None:
                wanted = self._wanted([c for c, _ in header(_Stream(b for _, b in source.blocks(0)).take)[1]])
            elif (wanted := listed) is not None:
                wanted = {c: listed[c] for c in ordered[bisect_left(ordered, entry["first"][0]) : bisect_right(ordered, entry["last"][0])]}
                # A read of the range's first contig may reach over its end, so only the first place excludes, and the last contig.
                if not any((c, b) > tuple(entry["first"]) for c, spans in wanted.items() for _, b in spans):
                    continue
            if wanted is None:
                out.append(Part(path, [], {}))
            elif wanted:
                index_fs, index_path = _fs(f"{path}.bai")
                with index_fs.open_input_file(index_path) as file:
                    index = Index.load(file.read())
                    self.read_bytes += file.tell()
                chunks = joined(sorted(x for c, spans in wanted.items() for a, b in spans for x in index.chunks(c, a, b)), GAP_BYTES)
                held: list[tuple[int, int]] = []
                for x in chunks:
                    if held and (x[1] >> 16) - (held[0][0] >> 16) > PARTITION_BYTES:
                        out.append(Part(path, held, wanted))
                        held = []
                    held.append(x)
                if held:
                    out.append(Part(path, held, wanted))
            self.read_bytes += source.read_bytes
        return out

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # what Spark makes of no partitions
            return
        source = Source(partition.path)
        stream = _Stream(b for _, b in source.blocks(0))
        names = [c for c, _ in header(stream.take)[1]]
        if not partition.chunks:

            def whole() -> Iterator[bytes]:
                while head := stream.take(4):
                    yield stream.take(struct.unpack("<i", head)[0])

            found = whole()
        else:
            found = (r for c in partition.chunks for r in records(source, c))
        for record in found:
            contig, start, n_name, n_cigar = struct.unpack_from("<iiB3xH", record)
            ops = struct.unpack_from(f"<{n_cigar}I", record, 32 + n_name)
            end = start + sum(c >> 4 for c in ops if _OPS[c & 15] in _REFERENCE_OPS)
            if partition.chunks and not any(start < b and end > a for a, b in partition.regions.get(contig, ())):
                continue
            yield (names[contig] if contig >= 0 else None, start, end, sam_line(record, names))
        self.read_bytes += source.read_bytes


class _PushedReader(_Reader):
    """Regions come from filters on contig, ref_start and ref_end too."""

    def pushFilters(self, filters):  # noqa: N802 (the name of Spark's interface)
        """Contigs and bounds narrow what is read; Spark still applies each filter to the rows."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "contig" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            elif column == "ref_start" and isinstance(f, LessThan):
                self.high = min(self.high, f.value)
            elif column == "ref_start" and isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value + 1)
            elif column == "ref_end" and isinstance(f, GreaterThan):
                self.low = max(self.low, f.value)
            elif column == "ref_end" and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value - 1)
            yield f


class IndexedBam(DataSource):
    """Rows of SCHEMA, ``value`` the record as SAM text.

    With the option ``pushdown``, and ``spark.sql.python.filterPushdown.enabled`` in the
    session (Spark refuses one without the other), filters choose what is read.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return (_PushedReader if self.options.get("pushdown") == "true" else _Reader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def write_bam(alignments: DataFrame, path: str, contigs: DataFrame, files: int | None = None) -> None:
    """A folder of BAM files with indexes, in order of contig and place; ``contigs``: (contig, length), with ``number`` or in order of name.

    Adaptive execution chooses the number of files by their size, unless ``files`` does.

    Alignments without a contig come last; one with a contig that is not listed is an error.  An empty table
    gives a manifest without files.
    """
    if "number" not in contigs.columns:
        contigs = contigs.select("contig", "length", F.col("contig").alias("number"))
    listed = [(r["contig"], r["length"]) for r in contigs.orderBy("number").collect()]
    order = alignments.sparkSession.createDataFrame(pa.table({"_contig": pa.array([c for c, _ in listed], pa.string()), "_number": pa.array(np.arange(len(listed), dtype=np.int32))}))
    # The names' numbers are as many as a file's header holds.
    rows = alignments.join(F.broadcast(order), F.col("contig") == F.col("_contig"), "left").drop("_contig")
    unknown = F.raise_error(F.concat(F.lit("no such contig: "), F.col("contig")))
    rows = rows.withColumn("_number", F.when(F.col("contig").isNull(), len(listed)).when(F.col("_number").isNull(), unknown.cast("int")).otherwise(F.col("_number"))).withColumn("_start", F.coalesce("ref_start", F.lit(-1)))
    # A record is a third of its row, so it is made before rows are sorted.
    made = rows.drop("sample", "ref_end").mapInArrow(_encoded(len(listed)), "_number int, _start int, _end int, read_name string, flag int, record binary")
    sorted_ = made.repartitionByRange(*([files] if files else []), "_number", "_start").sortWithinPartitions("_number", "_start", "read_name", "flag").select("_number", "_start", "_end", "record")
    alignments.sparkSession.dataSource.register(IndexedBam)
    sorted_.write.format(FORMAT).mode("overwrite").option("contigs", json.dumps(listed)).save(path)


def read_indexed(spark: SparkSession, path: str, sample: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Alignments of a BAM file with its index beside it, or of a folder of such, that overlap one of ``regions`` (contig, start, end).

    Each is given once.  For the many sites of a cohort one scan and an interval join
    are less work; this is for a few regions of large files.  Without regions all is read.
    """
    spark.dataSource.register(IndexedBam)
    rows = spark.read.format(FORMAT).option("path", path)
    if regions is not None:
        rows = rows.option("regions", json.dumps(regions))
    return parse_sam(rows.load().select("value"), sample)
