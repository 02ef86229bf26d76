"""Canonical length-limited Huffman coding of token ids.

Code lengths come from global counts by package-merge, so no code is longer than
``LIMIT`` bits; the code table is stored as lengths alone.  A block holds the ids
of whole documents, with the documents' ids and lengths beside it:

    4 bytes  "GHC3"
    u32 LE   ids between checkpoints
    u32 LE   bytes of a bit offset, 4 or 8
    u32 LE   checkpoints, then as many little-endian bit offsets into the stream
    bytes    code words, most significant bit first; every document starts at a 32-bit word

Blocks are independent.  Every document, and every so many ids within it, has a
checkpoint, and decoding runs over many checkpoints of a block at once, one table
look-up for each id.  Coding and decoding work on bounded runs of ids, however long
a document is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stash import discard, new_path, stash
from . import text as tx
from .tokens import END_ID, binary, encoded, encoder

LIMIT = 16
#: Ids that are coded at once.
RUN_IDS = 1 << 17
#: Parts of a file set at most; past it parts grow, so that a row for each fits into the driver.
MOST_PARTS = 100_000
MAGIC = b"GHC3"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for symbols that don't occur."""
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        out[symbols] = 1
        return out
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels: list[np.ndarray] = []  # whether each item of a level, in order of weight, is a leaf
    packages = np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)
        weights = weights[rank]
        pairs = len(weights) // 2
        packages = weights[0 : 2 * pairs : 2] + weights[1 : 2 * pairs : 2]
    take = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        bits[:used] += 1
        take = 2 * (take - used)
    out[order] = bits
    return out


@dataclass(frozen=True)
class Code:
    """Code words of the lengths, canonical: by length, then by symbol."""

    lengths: np.ndarray

    def words(self) -> np.ndarray:
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        out = np.zeros(len(self.lengths), np.uint32)
        code, last = 0, 0
        for s in order:
            n = int(self.lengths[s])
            code <<= n - last
            out[s] = code
            code, last = code + 1, n
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each ``LIMIT``-bit window."""
        words = self.words()
        symbol, length = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
        for s in np.flatnonzero(self.lengths):
            n = int(self.lengths[s])
            a = int(words[s]) << (LIMIT - n)
            symbol[a : a + (1 << (LIMIT - n))] = s
            length[a : a + (1 << (LIMIT - n))] = n
        return symbol, length


def _encode_runs(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, lengths: np.ndarray, step: int) -> tuple[np.ndarray, bytes]:
    """(bit offsets of the checkpoints, stream) of runs of ids, each of which starts at a 32-bit word."""
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bits = lengths[ids].astype(np.int64)
    if not bits.all():
        raise ValueError("an id without a code")
    total = np.concatenate([[0], np.cumsum(bits)])
    base = np.concatenate([[0], np.cumsum((total[first[1:]] - total[first[:-1]] + 31) // 32)])
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = total[:-1] - total[first[run]] + 32 * base[run]
    stream = np.zeros(base[-1] + 1, np.uint64)
    if len(ids):
        placed = words[ids].astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.diff(word, prepend=-1))
        stream[word[new]] += np.add.reduceat(placed >> np.uint64(32), new)
        low = placed & np.uint64(0xFFFFFFFF)
        over = np.flatnonzero(low)
        stream[word[over] + 1] += low[over]
    return at[(np.arange(len(ids)) - first[run]) % step == 0], stream[: base[-1]].astype(">u4").tobytes()


def encode_block(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, lengths: np.ndarray, step: int) -> bytes:
    """One block of documents, whose ids stand one after the other; a long one is coded in runs of ``RUN_IDS``."""
    run = max(1, RUN_IDS // step) * step
    runs = np.array([min(run, n - a) for n in np.asarray(sizes).tolist() for a in range(0, n, run)], np.int64)
    first = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    marks, streams, base, a = [], [], 0, 0
    while a < len(runs):
        b = max(a + 1, int(np.searchsorted(first, first[a] + run, "right")) - 1)
        own, stream = _encode_runs(ids[first[a] : first[b]], runs[a:b], words, lengths, step)
        marks.append(own + base)
        streams.append(stream)
        base, a = base + 8 * len(stream), b
    offsets = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    width = 4 if base < 1 << 32 else 8
    return MAGIC + struct.pack("<III", step, width, len(offsets)) + offsets.astype(f"<u{width}").tobytes() + b"".join(streams)


def decode_block(block: bytes, sizes: np.ndarray, symbol: np.ndarray, length: np.ndarray, lanes_at_once: int = 8192) -> np.ndarray:
    """The ids of one block's documents, one after the other, so many checkpoints in step."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    step, width, lanes = struct.unpack_from("<III", block, 4)
    marks = np.frombuffer(block, f"<u{width}", lanes, 16).astype(np.int64)
    data = np.frombuffer(block, np.uint8, -1, 16 + width * lanes)
    sizes = np.asarray(sizes, np.int64)
    per = -(-sizes // step)
    doc = np.repeat(np.arange(len(sizes)), per)
    start = (np.arange(lanes) - np.concatenate([[0], np.cumsum(per)])[doc]) * step
    counts = np.minimum(step, sizes[doc] - start)
    places = start + np.concatenate([[0], np.cumsum(sizes)])[doc]
    out = np.zeros(int(sizes.sum()), np.uint32)
    for a in range(0, lanes, lanes_at_once):
        b = min(lanes, a + lanes_at_once)
        lo, hi = int(marks[a]) >> 3, len(data) if b == lanes else (int(marks[b]) >> 3) + 1
        part = np.concatenate([data[lo:hi], np.zeros(3, np.uint8)]).astype(np.uint32)
        window = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        order = np.argsort(-counts[a:b], kind="stable")
        at, to, count = marks[a:b][order] - 8 * lo, places[a:b][order], counts[a:b][order]
        live = len(count) - np.searchsorted(count[::-1], np.arange(step), "right")
        for k, n in enumerate(live.tolist()):
            if not n:
                break
            at, to = at[:n], to[:n]
            v = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
            out[to + k] = symbol[v]
            at = at + length[v]
    return out


def _unpack(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _packed_counts(total: np.ndarray) -> bytes:
    seen = np.flatnonzero(total)
    return seen.astype("<i8").tobytes() + total[seen].astype("<i8").tobytes()


def sum_counts(partial: DataFrame, vocab_size: int) -> np.ndarray:
    """Global counts from the tasks' packed counts; at most ``vocab_size`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                symbol, n = _unpack(x, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(symbol.astype(np.int32)), pa.array(n)], names=["symbol", "n"])

    rows = partial.mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocab_size, np.int64)
    counts[rows["symbol"].to_numpy()] = rows["n"].to_numpy()
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = 1 << 17, step: int = 128, part_ids: int = 1 << 24) -> None:
    """Write all documents' ids as blocks under ``path``/blocks in ascending id order, and the code under ``path``/code.

    A part is a file and holds a range of documents, of about ``part_ids`` token ids;
    files, and blocks within them, are in order of document id.  A block closes with
    the document that brings it to ``block_ids``.  Null and empty texts are one end
    id; null document ids come first; rows that share an id are ordered by their
    length, then by a hash of their ids, and may lie in several parts.  An empty table gives no blocks.
    """
    spark = docs.sparkSession
    vocab = encoder(tokenizer).vocab_size
    short = vocab <= 1 << 16
    kind = "<u2" if short else "<u4"

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's counts are a row of their own, so they are committed with its ids and read without them.
        total, names = np.zeros(vocab, np.int64), ["doc_id", "n", "ids", "counts"]
        for batch, ids, at in encoded(batches, tokenizer, end_id, short=short):
            total += np.bincount(ids, minlength=vocab)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), binary(ids, at), pa.nulls(len(at) - 1, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([_packed_counts(total)], pa.binary())], names=names)

    source = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = stash(source.mapInArrow(tokenise, "doc_id long, n long, ids binary, counts binary"), "ids")
    counts = sum_counts(both.select("counts").filter("counts is not null"), vocab)
    lengths = code_lengths(counts)
    words = Code(lengths).words()
    total = int(counts.sum())
    parts = max(1, min(MOST_PARTS, -(-total // part_ids)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, size = TaskContext.get().partitionId(), 0, 0, 0
        doc: list[int | None] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal number, before, size
            sizes = np.array([len(x) for x in held], np.int64)
            payload = encode_block(np.concatenate(held), sizes, words, lengths, step)
            columns = [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([doc], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            number, before, size = number + 1, before + size, 0
            doc.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "block", "ids_before", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc.append(d)
                held.append(_unpack(x, kind))
                size += len(held[-1])
                if size >= block_ids:
                    yield close()
        if doc:
            yield close()

    # Ranges of the whole order, not of ids alone: an id that many rows share is split too.
    order = ["doc_id", "n", "h"]
    ids = both.filter("counts is null").select("doc_id", "n", F.xxhash64("ids").alias("h"), "ids")
    dealt = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(both)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")


BLOCKS = "part long, block long, ids_before long, doc_ids array<long>, lengths array<long>, payload binary"


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document decoded from its block; start counts the ids of all documents before it.

    With ``digest``, ids_crc32 (of the decoded ids) stands in place of ids.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row for each part, of which there are at most MOST_PARTS.
    ends = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for r in ends:
        base[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, length = Code(lengths).tables()
        for batch in batches:
            for k, (part, before) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                doc, n = batch.column(2)[k].values, batch.column(3)[k].values.to_numpy()
                ids = decode_block(memoryview(batch.column(4)[k].as_buffer()), n, symbol, length).astype("<u4", copy=False)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                last = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()) if digest else binary(ids, at)
                yield pa.RecordBatch.from_arrays([doc, pa.array(at[:-1] + (base[part] + before)), pa.array(n), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    last = "ids_crc32 long" if digest else "ids binary"
    return blocks.select("part", "ids_before", "doc_ids", "lengths", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def round_trip(docs: DataFrame, tokenizer: str, digest: bool = False, **options: str | int) -> DataFrame:
    """Write ``docs`` to a new place in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "huffman")
    write_ids(docs, path, tokenizer, **options)
    return read_ids(docs.sparkSession, path, digest)
