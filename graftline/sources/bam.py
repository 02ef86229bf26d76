"""BAM as a DataFrame: a reader of block-compressed alignment files in plain Python.

A file's blocks all begin with the same 16 bytes.  Spark's text source, with these as
its line separator, splits a file of any size at them and gives the rest of each block
as it is; so one large file has as many readers as splits.  Each reader finds the first
record in its split, and the few bytes before it go, with the unfinished end of the
split before, to a second small stage, which checks that they are whole records.
Files whose blocks begin otherwise come through ``binaryFile``, one file a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stash import stash
from ..operators.unions import apart
from .files import parse_sam

#: Fixed values of the format: base codes, CIGAR operations, and sizes of tag types.
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def inflate(data: bytes) -> Iterator[bytes]:
    """The blocks of a block-compressed file."""
    at = 0
    while at < len(data):
        block = zlib.decompressobj(31)
        out = block.decompress(data[at:])
        at = len(data) - len(block.unused_data)
        if out:
            yield out


def _tags(raw: bytes) -> list[str]:
    at, out = 0, []
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(0, at)
            out.append(f"{name}:{kind}:{raw[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_FORMATS[sub]}", raw, at + 5)
            out.append(f"{name}:B:{sub}," + ",".join(map(str, values)))
            at += 5 + n * _SIZES[sub]
        elif kind == "A":
            out.append(f"{name}:A:{chr(raw[at])}")
            at += 1
        else:
            value = struct.unpack_from("<" + _FORMATS[kind], raw, at)[0]
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{value}")
            at += _SIZES[kind]
    return out


class _Stream:
    """Bytes from blocks, inflated as they are needed."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            more = next(self.blocks, None)
            if more is None:
                return b""
            self.held.extend(more)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def header(take) -> tuple[list[str], list[tuple[str, int]]]:
    """(header lines, (name, length) of the contigs) at the beginning of a file."""
    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = take(struct.unpack("<i", take(4))[0]).rstrip(b"\0").decode().splitlines()
    found = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        name = take(struct.unpack("<i", take(4))[0]).rstrip(b"\0").decode()
        found.append((name, struct.unpack("<i", take(4))[0]))
    return text, found


def sam_line(rec: bytes, names: list[str]) -> str:
    """A record, without its size, as a line of SAM text."""
    name_of = lambda k: names[k] if k >= 0 else "*"
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", rec)
    at = 32
    name = rec[at : at + n_name - 1].decode()
    at += n_name
    cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", rec, at)) or "*"
    at += 4 * n_cigar
    packed = rec[at : at + (n_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or "*"
    at += len(packed)
    quals = rec[at : at + n_seq]
    at += n_seq
    text = "*" if not n_seq or quals[0] == 255 else "".join(chr(q + 33) for q in quals)
    return "\t".join([name, str(flag), name_of(ref), str(pos + 1), str(mapq), cigar, "=" if mate == ref and ref >= 0 else name_of(mate), str(mate_pos + 1), str(size), seq, text, *_tags(rec[at:])])


def sam_lines(data: bytes) -> Iterator[str]:
    """The records of a BAM file as SAM text, header lines first; blocks are inflated as they are needed."""
    take = _Stream(inflate(data)).take
    text, found = header(take)
    yield from text
    names = [n for n, _ in found]
    while head := take(4):
        yield sam_line(take(struct.unpack("<i", head)[0]), names)


#: What every block of the usual writers begins with, before its own size.
_BLOCK = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"


def _plausible(data: bytes | bytearray, at: int, lengths: list[int]) -> int:
    """Where the record that may begin at a place ends, or -1 if none can."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not 0 < n_name or n_seq < 0 or size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq or size > 1 << 28:
        return -1
    for k, p in ((ref, pos), (mate, mate_pos)):
        if not -1 <= k < len(lengths) or p < -1 or (k >= 0 and p >= lengths[k]):
            return -1
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return -1
    return at + 4 + size


def first_record(data: bytes | bytearray, lengths: list[int], chain: int = 5) -> int:
    """The first place from which records follow each other, so many or to the end of the data; -1 if there is none."""
    for at in range(len(data) - 35):
        p, n = at, 0
        while n < chain and 0 <= p and p + 36 <= len(data):
            p, n = _plausible(data, p, lengths), n + 1
        if p >= 0 and n:
            return at
    return -1


def _in_splits(spark: SparkSession, path: str, names: list[str], lengths: list[int], start: int) -> DataFrame:
    """(value): the records of one file as SAM text, read split by split; ``start`` is where the first record begins."""
    blocks = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _BLOCK.decode("latin-1")).text(path)
    blocks = blocks.select(F.col("value").cast("binary").alias("block"), F.input_file_block_start().alias("split"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, ready = None, bytearray(), False

        def fragment(split: int, kind: str, data: bytes) -> pd.DataFrame:
            return pd.DataFrame({"value": [None], "split": [split], "kind": [kind], "data": [data]})

        def records(force: bool) -> Iterator[pd.DataFrame]:
            nonlocal ready
            if not ready:
                if now == 0:
                    if len(held) < start:
                        return
                    del held[:start]
                    ready = True
                else:
                    if len(held) < 1 << 18 and not force:  # enough to see records follow each other
                        return
                    at = first_record(held, lengths)
                    if at < 0 and not force:
                        return
                    at = len(held) if at < 0 else at
                    yield fragment(now, "head", bytes(held[:at]))
                    del held[:at]
                    ready = True
            out, at = [], 0
            while at + 4 <= len(held):
                end = at + 4 + struct.unpack_from("<i", held, at)[0]
                if end > len(held):
                    break
                out.append(sam_line(bytes(held[at + 4 : end]), names))
                at = end
            del held[:at]
            if out:
                yield pd.DataFrame({"value": out, "split": now, "kind": "record", "data": None})

        def close() -> Iterator[pd.DataFrame]:
            yield from records(True)
            yield fragment(now, "tail", bytes(held))

        for batch in batches:
            for block, split in zip(batch["block"], batch["split"], strict=True):
                if split != now:
                    if now is not None:
                        yield from close()
                    now, held, ready = split, bytearray(), False
                if block:  # what stands before a file's first block is empty
                    held.extend(zlib.decompress(block[2:-8], -15))
            if now is not None and len(held) >= 1 << 20:
                yield from records(False)
        if now is not None:
            yield from close()

    made = stash(blocks.mapInPandas(run, "value string, split long, kind string, data binary"), "bam")

    def stitch(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        # Of a split: what stands before its first record, then what its last record lacks.
        order = parts.assign(n=parts["kind"].eq("tail")).sort_values(["split", "n"])
        data, out, at = b"".join(order["data"]), [], 0
        while at + 4 <= len(data):
            size = struct.unpack_from("<i", data, at)[0]
            if size < 32 or at + 4 + size > len(data):
                raise ValueError("records of a BAM file's splits don't fit together")
            out.append(sam_line(data[at + 4 : at + 4 + size], names))
            at += 4 + size
        if at != len(data):
            raise ValueError("a BAM file ends within a record")
        return pd.DataFrame({"value": out}, dtype=object)

    # A few hundred bytes for each split of the file.
    edges = made.filter("kind <> 'record'").select("split", "kind", "data").withColumn("file", F.lit(0)).groupBy("file").applyInPandas(stitch, "value string")
    return made.filter("kind = 'record'").select("value").unionByName(apart(edges))


def _head(spark: SparkSession, path: str) -> tuple[list[tuple[str, int]], int] | None:
    """(contigs, where the first record begins) of one file, read by the driver; None for a folder, or for other blocks."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(found) or not fs.getFileStatus(found).isFile():
        return None
    stream = fs.open(found)
    try:

        def blocks() -> Iterator[bytes]:
            while lead := bytes(stream.readNBytes(18)):
                if lead[:16] != _BLOCK:
                    raise _OtherBlocks
                yield zlib.decompress(bytes(stream.readNBytes(struct.unpack_from("<H", lead, 16)[0] + 1 - 18))[:-8], -15)

        own = _Stream(blocks())
        read = 0

        def take(n: int) -> bytes:
            nonlocal read
            read += n
            return own.take(n)

        try:
            return header(take)[1], read
        except _OtherBlocks:
            return None
    finally:
        stream.close()


class _OtherBlocks(Exception):
    pass


def read_bam(spark: SparkSession, path: str, sample: str | None = None, rows: int = 4096) -> DataFrame:
    """Alignments of one or many BAM files; without ``sample``, each file's path is its sample.

    One file is read in splits; a folder or pattern of files, or files of other blocks, by file.
    """
    if sample is not None and (found := _head(spark, path)):
        contigs_, start = found
        return parse_sam(_in_splits(spark, path, [n for n, _ in contigs_], [n for _, n in contigs_], start), sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                held: list[str] = []
                for line in sam_lines(data):
                    held.append(line)
                    if len(held) >= rows:
                        yield pd.DataFrame({"value": held, "path": name})
                        held = []
                if held:
                    yield pd.DataFrame({"value": held, "path": name})

    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "value string, path string")
    return parse_sam(lines, F.col("path") if sample is None else sample)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, number) of a BAM file's header, numbered in its order; of several files' the first by name."""
    if found := _head(spark, path):
        return spark.createDataFrame([(c, n, k) for k, (c, n) in enumerate(found[0])], "contig string, length int, number long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, c, n, k) for k, (c, n) in enumerate(header(_Stream(inflate(data)).take)[1])], columns=["path", "contig", "length", "number"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, contig string, length int, number long")
    return found.groupBy("contig").agg(F.min(F.struct("path", "number", "length")).alias("m")).select("contig", "m.length", "m.number")
