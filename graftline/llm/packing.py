"""Cost-balanced packing of token ids into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention inside a
piece).  Each task packs its own rows in windows of a bounded number of tokens:
whole sequences are cut from long documents, then the rest of each document, in
descending order, goes to the sequence of lowest cost that still has room for it.
What fits nowhere whole is cut to fill the remaining room, lowest cost first; what
is left then waits for the next window.

The last tokens of a task, fewer than one sequence, are written apart.  These tails
are dealt anew, a window's worth to a task, and packed in the same way; only what is
left there goes to sequences of power-of-two lengths, which need no padding.

No text and no packed id is shuffled.  Sequence ids are (partition << 40) + number,
with bit 62 set for those of tails, and every task's rows are committed as one, so a
task that runs again replaces its sequences whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import stash
from ..operators.unions import union_all
from . import text as tx
from .tokens import END_ID, encoded


@dataclass(frozen=True)
class Packing:
    length: int = 2048
    linear: float = 1.0
    #: Cost of a squared token against a token: attention against the other layers.
    quadratic: float = 1 / 2048
    #: Sequences in one window.
    window: int = 512


@dataclass
class _Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    total: int

    @property
    def n(self) -> int:
        return len(self.ids)

    def split(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


@dataclass
class Packer:
    """Packs the documents, or pieces of them, that it is given, in order."""

    p: Packing
    base: int = 0
    number: int = 0
    waiting: list[_Piece] = field(default_factory=list)
    held: int = 0
    out: list[tuple] = field(default_factory=list)

    def _put(self, piece: _Piece, sequence: int | None, offset: int) -> None:
        self.out.append((piece.doc, piece.start, piece.n, piece.ids.tobytes(), piece.total, None if sequence is None else self.base + sequence, offset))

    def add(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        piece = _Piece(doc, start, ids, len(ids) if total is None else total)
        while piece.n >= self.p.length:
            head, piece = piece.split(self.p.length)
            self._put(head, self.number, 0)
            self.number += 1
        if piece.n:
            # A copy, so that a batch of texts doesn't stay in memory for what waits of it.
            self.waiting.append(_Piece(piece.doc, piece.start, piece.ids.copy(), piece.total))
            self.held += piece.n
        if self.held >= self.p.window * self.p.length:
            self.pack([self.p.length] * (self.held // self.p.length))

    def pack(self, room: list[int]) -> None:
        """Fill sequences of these lengths; what is left waits."""
        p, k = self.p, len(room)
        if not k:
            return
        left, cost, used = np.array(room, np.int64), np.zeros(k), np.zeros(k, np.int64)

        def put(piece: _Piece, s: int) -> None:
            self._put(piece, self.number + s, int(used[s]))
            used[s] += piece.n
            left[s] -= piece.n
            cost[s] += p.linear * piece.n + p.quadratic * piece.n * piece.n

        rest: list[_Piece] = []
        for piece in sorted(self.waiting, key=lambda x: -x.n):
            fits = np.where(left >= piece.n, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] < np.inf:
                put(piece, s)
            else:
                rest.append(piece)
        over: list[_Piece] = []
        for piece in rest:
            while piece.n and left.any():
                s = int(np.where(left > 0, cost, np.inf).argmin())
                head, piece = piece.split(min(piece.n, int(left[s])))
                put(head, s)
            if piece.n:
                over.append(piece)
        self.waiting, self.held = over, sum(x.n for x in over)
        self.number += k

    def full(self) -> None:
        """Pack as many whole sequences as the waiting tokens give."""
        self.pack([self.p.length] * (self.held // self.p.length))

    def leave(self) -> None:
        """Give what waits as pieces without a sequence."""
        for piece in self.waiting:
            self._put(piece, None, 0)
        self.waiting, self.held = [], 0

    def finish(self) -> None:
        self.full()
        self.pack([1 << b for b in range(self.held.bit_length() - 1, -1, -1) if self.held >> b & 1])

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, p: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row for each piece.

    ``ids`` are little-endian unsigned 32-bit.  Null and empty texts are one end
    id; repeated rows are packed as often as they occur; null ids stay null.  An
    empty table gives no pieces.  Other columns of ``docs`` are not read.  Packed
    pieces are written to the shared folder and read from there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(p, TaskContext.get().partitionId() << 40)
        for batch, ids, at in encoded(batches, path, end_id):
            cut = at.tolist()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                packer.add(doc, ids[cut[k] : cut[k + 1]])
                if len(packer.out) >= 1024:
                    yield packer.take()
            if packer.out:
                yield packer.take()
        packer.full()
        packer.leave()
        yield packer.take()

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(p, 1 << 62 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, start, ids, total in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                packer.add(doc, np.frombuffer(ids, "<u4"), start, total)
            if packer.out:
                yield packer.take()
        packer.finish()
        yield packer.take()

    rows = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
    # A task's tails come last in its file, so that only the last pages are read for them.
    written = stash(rows, "pieces")
    left = written.filter("sequence_id is null").select("doc_id", "start", "ids", "doc_tokens", "length")
    tokens = left.agg(F.sum("length").alias("n")).first()["n"] or 0
    again = left.repartition(max(1, -(-tokens // (p.window * p.length)))).select("doc_id", "start", "ids", "doc_tokens").mapInArrow(tails, PIECES)
    return union_all([written.filter("sequence_id is not null"), again])
