"""Cross-tokenizer alignment: which tokens of two tokenizers overlap in a text, and how often over all documents.

Tokens are byte ranges of one string, a space and the text.  Every stretch between
two neighbouring token ends, of either side, belongs to one token of each: it is one
link.  Where both sides end, a group of tokens is complete.

What is kept of a chunk of texts are its *postings*: for each id of side A the ids of
side B that it is linked with, the documents and the multiplicities, packed into
one row.  Postings and the table of pair counts are dealt by side A's id and sorted
(by Spark, which spills), so an id's counts come first, its maximum is taken, and
its postings stream past in batches.  Each task sums what its postings contribute to
each document; these sums are shuffled by chunk and added up.  An id with very many postings is
dealt over several tasks, each of which gets the id's counts, one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import discard, stash
from . import text as tx
from . import tokens as tk


@dataclass(frozen=True)
class Bounds:
    """What tasks hold at once; results don't depend on it."""

    #: Bytes of text whose postings are packed together; a longer single text forms a chunk of its own.
    chunk_bytes: int = 2 << 20
    #: Postings of one id in one task; an id with more is dealt over several.
    shard_postings: int = 4_000_000
    #: Pair counts that a task holds before it passes them on.
    pairs: int = 1_000_000
    #: Documents whose sums a task holds.
    documents: int = 2_000_000


#: Rows of a chunk: its documents are numbered in 16 bits.
CHUNK_ROWS = 1 << 16
#: Pieces in a worker's dictionary of each tokenizer.
CACHE_PIECES = 150_000

_NUMBER = "<u4"


class _ByteSide(tk.PieceEncoder):
    """A byte-level tokenizer of the tokenizers library; special strings are plain text, and each text follows a space."""

    def __init__(self, path: str, pieces: int):
        super().__init__(path, pieces=pieces, special=False)
        back = {letter: byte for byte, letter in tk._LETTERS.items()}
        self.entries = [b""] * self.vocab_size
        for entry, i in self.tokenizer.get_vocab().items():
            own = [back.get(c) for c in entry]
            self.entries[i] = entry.encode() if None in own else bytes(own)

    def apart(self, texts: list[str]) -> list[bytes]:
        return self._ids([" " + x for x in texts])


class _PieceSide(tk.PieceEncoder):
    """A sentencepiece model, which puts a space before each text.

    No piece of the vocabulary holds a line end, or a space after another character
    (checked when it is loaded), so merges never cross from a word to the space
    after it or a line end: words are encoded one by one.
    """

    def __init__(self, path: str, pieces: int):
        import sentencepiece

        self.code, self.kind = "I", "<u4"
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab_size = m.vocab_size()
        entries = [m.id_to_piece(i) for i in range(self.vocab_size)]
        self.entries = [bytes([int(e[3:-1], 16)]) if m.is_byte(i) else e.replace("▁", " ").encode() for i, e in enumerate(entries)]
        parted = not any("\n" in e or "▁" in e.lstrip("▁") for e in entries)
        plain = m.encode("a  b\n", out_type=str)[-1:] == ["<0x0A>"] and m.decode(m.encode("a  b")) == "a  b"
        self.cut = "led" if parted and plain else "whole"
        #: Texts with these are encoded whole: runs of spaces, spaces at an end, and the character that stands for a space.
        self.whole = "  |^ | $|▁"
        self.known = tk._Known(self._learn, pieces)

    def _raw(self, text: str) -> bytes:
        return np.array(self.model.encode(text), _NUMBER).tobytes()

    def _learn(self, piece: str) -> bytes:
        if piece == " ":  # the space alone, which the library gives to no text
            return self._raw("a ")[len(self._raw("a")) :]
        if piece[:1] == " ":
            return self._raw(piece[1:])
        lead = self._raw("\n")  # text after a line end has no space before it
        return self._raw("\n" + piece)[len(lead) :]

    def apart(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, _NUMBER).tobytes() for x in self.model.encode(texts, num_threads=1)]


class Side:
    """One tokenizer: ids of led texts, and what bytes each id stands for."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        self.encoder = (_PieceSide if path.endswith(".model") else _ByteSide)(path, pieces)
        self.size = self.encoder.vocab_size
        self.entries = pa.array(self.encoder.entries, pa.large_binary())
        self.lengths = np.array([len(e) for e in self.encoder.entries], np.int64)
        self._written: pa.Array | None = None

    def written(self, b: Side) -> pa.Array:
        """Each id of this side (inside a group, at its end) and of ``b`` with the mark after it."""
        if self._written is None:
            self._written = pa.array([f"{i}{c}" for i in range(self.size) for c in ",|"] + [f"{i}{c}" for i in range(b.size) for c in ",;"], pa.large_string())
        return self._written

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, none of them null, each after a space; an empty text has none."""
        enc = self.encoder
        empty = pc.equal(pc.binary_length(texts), 0)
        apart = pa.array(np.ones(len(texts), bool)) if enc.cut == "whole" else pc.match_substring_regex(texts, enc.whole)
        apart = pc.and_not(apart, empty)
        led = pc.if_else(pc.or_(apart, empty), "", pc.binary_join_element_wise(" ", texts, ""))
        data, off = tx.string_parts(led)
        ids, at = enc._pieces(data, off)
        if not pc.any(apart).as_py():
            return ids, at
        rows = iter(enc.apart(texts.filter(apart).to_pylist()))
        found = [np.frombuffer(next(rows), enc.kind) if w else ids[at[k] : at[k + 1]] for k, w in enumerate(apart.to_pylist())]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def bytes_of(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, offsets of the texts in them)."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        data = self.entries.take(pa.array(ids)).buffers()[2] if len(ids) else None
        return np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8), ends[at]


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """This worker's two sides."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Side(path_a), Side(path_b)
    return _sides[path_a, path_b]


def _same(data: np.ndarray, off: np.ndarray, other: np.ndarray, other_off: np.ndarray) -> np.ndarray:
    """Which texts have the same bytes in both."""
    same = np.diff(off) == np.diff(other_off)
    if same.all() and np.array_equal(data, other):
        return same
    for k in np.flatnonzero(same):
        same[k] = np.array_equal(data[off[k] : off[k + 1]], other[other_off[k] : other_off[k + 1]])
    return same


class Chunk:
    """The tokens and links of a run of texts, none of them null."""

    def __init__(self, a: Side, b: Side, texts: pa.Array):
        n = len(texts)
        data, off = tx.string_parts(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, "")))
        (ids_a, at_a), (ids_b, at_b) = a.ids(texts), b.ids(texts)
        ok = (np.diff(off) > 0) & _same(data, off, *a.bytes_of(ids_a, at_a)) & _same(data, off, *b.bytes_of(ids_b, at_b))
        if not ok.all():
            ids_a, ids_b = ids_a[np.repeat(ok, np.diff(at_a))], ids_b[np.repeat(ok, np.diff(at_b))]
        self.a, self.b, self.ids_a, self.ids_b = a, b, ids_a, ids_b
        self.n_a, self.n_b = np.where(ok, np.diff(at_a), 0), np.where(ok, np.diff(at_b), 0)
        self.off = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(off), 0))])
        size = int(self.off[-1]) + 1
        self.ends_a, self.ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
        self.is_a, self.is_b = np.zeros(size, bool), np.zeros(size, bool)
        self.is_a[self.ends_a] = True
        self.is_b[self.ends_b] = True
        links = np.flatnonzero(self.is_a | self.is_b)
        self.before_a, self.before_b = np.cumsum(self.is_a, dtype=np.int32), np.cumsum(self.is_b, dtype=np.int32)
        self.link_a = self.before_a[links] - self.is_a[links]
        self.link_b = self.before_b[links] - self.is_b[links]
        self.n_links = np.diff(np.searchsorted(links, self.off, "right"))
        self.both = np.flatnonzero(self.is_a & self.is_b)
        self.n_groups = np.diff(np.searchsorted(self.both, self.off, "right"))
        self.n = n

    def groups(self) -> tuple[memoryview, np.ndarray]:
        """(all texts' groups as text, offsets): ids of A after one another, a bar, those of B, a semicolon after each group."""
        table = self.a.written(self.b)
        last_a, last_b = self.is_b[self.ends_a], self.is_a[self.ends_b]
        group_a = np.searchsorted(self.both, self.ends_a)
        group_b = np.searchsorted(self.both, self.ends_b)
        in_a, in_b = self.before_a[self.both], self.before_b[self.both]
        at_a = np.arange(len(self.ids_a)) + np.concatenate([[0], in_b])[group_a]
        at_b = np.arange(len(self.ids_b)) + in_a[group_b]
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        order[at_a] = self.ids_a.astype(np.int64) * 2 + last_a
        order[at_b] = (self.ids_b.astype(np.int64) + self.a.size) * 2 + last_b
        text = table.take(pa.array(order))
        ends = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1]
        first = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return memoryview(text.buffers()[2] or b""), ends[first]

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, document, multiplicity), sorted and distinct."""
        doc_bits, b_bits = max(1, (self.n - 1).bit_length()), max(1, (self.b.size - 1).bit_length())
        doc = np.repeat(np.arange(self.n), self.n_links)
        key = (self.ids_a[self.link_a].astype(np.int64) << (b_bits + doc_bits)) | (self.ids_b[self.link_b].astype(np.int64) << doc_bits) | doc
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key, times = key[first], np.diff(np.append(first, len(key)))
        return key >> (b_bits + doc_bits), (key >> doc_bits) & ((1 << b_bits) - 1), key & ((1 << doc_bits) - 1), times


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length at the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _packed(x: np.ndarray, cuts: np.ndarray, kind: str) -> pa.Array:
    return tk.binary(np.ascontiguousarray(x, kind), cuts)


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, numbers of them in each row) of a packed column."""
    size = np.dtype(kind).itemsize
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None and off[-1] > off[0] else np.zeros(0, kind)
    return held, np.diff(off) // size


class _PairCounts:
    """Sums of numbers of documents by pair, as sorted arrays."""

    def __init__(self, bound: int):
        self.bound = bound
        self.key, self.n, self.parts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.waiting += len(key)
        if self.waiting > self.bound:
            self.settle()

    def settle(self) -> int:
        if self.parts:
            key = np.concatenate([self.key, *(k for k, _ in self.parts)])
            n = np.concatenate([self.n, *(m for _, m in self.parts)])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            cuts = _runs(key)
            self.key, self.n = key[cuts[:-1]], np.add.reduceat(n, cuts[:-1]) if len(key) else n
            self.parts, self.waiting = [], 0
        return len(self.key)

    def batches(self) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        """(a, b packed, n packed) rows; the sums start anew."""
        self.settle()
        a = self.key >> 32
        cuts = _runs(a)
        for k in range(0, len(cuts) - 1, 4096):
            part = cuts[k : k + 4097]
            own, at = slice(part[0], part[-1]), part - part[0]
            yield a[part[:-1]], _packed(self.key[own] & 0xFFFFFFFF, at, _NUMBER), _packed(self.n[own], at, "<i8")
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)


_FIRST = "kind int, doc_id long, chunk long, doc int, n_a long, n_b long, n_groups long, n_links long, groups binary, a int, docs int, b binary, at binary, times binary, n binary"
_DOC, _POSTINGS, _COUNTS = 0, 1, 2


def _types(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _made(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _first_pass(docs: DataFrame, path_a: str, path_b: str, digest: bool, bounds: Bounds) -> DataFrame:
    """Rows of three kinds: documents, packed postings of a chunk and an id, packed pair counts of an id."""
    schema = _types(_FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        counts, chunk = _PairCounts(bounds.pairs), TaskContext.get().partitionId() << 36

        def counted() -> Iterator[pa.RecordBatch]:
            for ids, others, n in counts.batches():
                yield _made(schema, len(ids), kind=np.full(len(ids), _COUNTS), a=ids, b=others, n=n)

        for batch in tx.pieces(batches, CHUNK_ROWS):
            texts = batch.column(1)
            for lo, hi, _, _ in tx.chunks(texts, bounds.chunk_bytes):
                c = Chunk(a, b, texts.slice(lo, hi - lo))
                data, off = c.groups()
                own = [data[off[k] : max(off[k], off[k + 1] - 1)] for k in range(c.n)]
                groups = [hashlib.sha256(x).digest() if len(x) else b"" for x in own] if digest else [bytes(x) for x in own]
                yield _made(schema, c.n, kind=np.full(c.n, _DOC), doc_id=batch.column(0).slice(lo, hi - lo), chunk=np.full(c.n, chunk), doc=np.arange(c.n), n_a=c.n_a, n_b=c.n_b, n_groups=c.n_groups, n_links=c.n_links, groups=groups)
                ids, others, at, times = c.postings()
                cuts = _runs(ids)
                if len(ids):
                    m, starts = len(cuts) - 1, cuts[:-1]
                    yield _made(schema, m, kind=np.full(m, _POSTINGS), chunk=np.full(m, chunk), a=ids[starts], docs=np.full(m, c.n), b=_packed(others, cuts, _NUMBER), at=_packed(at, cuts, "<u2"), times=_packed(times, cuts, _NUMBER))
                    pair = (ids << 32) | others
                    ends = _runs(pair)
                    counts.add(pair[ends[:-1]], np.diff(ends))
                    if len(counts.key) > bounds.pairs:
                        yield from counted()
                chunk += 1
        yield from counted()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, _FIRST)


def _summed(counts: DataFrame, bounds: Bounds) -> DataFrame:
    """(a, b, n, postings): each id's counts over all tasks, packed, sorted by b."""
    schema = _types("a int, b binary, n binary, postings long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _PairCounts(bounds.pairs)

        def passed(below: int | None) -> Iterator[pa.RecordBatch]:
            """The sums of the ids before ``below``, which is still to come; of all without it."""
            held.settle()
            own = held.key >> 32 < below if below is not None else np.ones(len(held.key), bool)
            later = held.key[~own], held.n[~own]
            held.key, held.n = held.key[own], held.n[own]
            total = np.add.reduceat(held.n, _runs(held.key >> 32)[:-1]) if len(held.key) else held.n
            done = 0
            for ids, others, n in held.batches():
                yield _made(schema, len(ids), a=ids, b=others, n=n, postings=total[done : done + len(ids)])
                done += len(ids)
            held.key, held.n = later

        for batch in batches:
            others, sizes = _unpacked(batch.column(1), _NUMBER)
            n, _ = _unpacked(batch.column(2), "<i8")
            ids = np.repeat(batch.column(0).to_numpy().astype(np.int64), sizes)
            held.add((ids << 32) | others, n)
            if len(ids) and held.settle() > bounds.pairs:
                yield from passed(int(ids[-1]))
        yield from passed(None)

    dealt = counts.select("a", "b", "n").repartition("a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "a int, b binary, n binary, postings long")


def _contributions(stream: DataFrame, bounds: Bounds) -> DataFrame:
    """(chunk, docs, at, best, total): what the postings of a task give to a chunk's documents, packed.

    ``stream``: (a, shard, kind, chunk, docs, b, at, times, n), sorted, an id's counts before its postings.
    """
    schema = _types("chunk long, docs int, at binary, best binary, total binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = n = most = np.zeros(0, np.int64)
        place: dict[int, tuple[int, int]] = {}
        best, total, used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def passed() -> Iterator[pa.RecordBatch]:
            chunks = list(place.items())
            for k in range(0, len(chunks), 64):
                rows, at, size = chunks[k : k + 64], [], [0]
                for _, (start, docs) in rows:
                    own = np.flatnonzero(total[start : start + docs])
                    at.append(own)
                    size.append(len(own))
                cuts, flat = np.cumsum(size), np.concatenate([x + start for x, (_, (start, _)) in zip(at, rows, strict=True)])
                yield _made(schema, len(rows), chunk=[c for c, _ in rows], docs=[d for _, (_, d) in rows], at=_packed(np.concatenate(at), cuts, "<u2"), best=_packed(best[flat], cuts, "<i8"), total=_packed(total[flat], cuts, "<i8"))

        for batch in batches:
            a = batch.column(0).to_numpy().astype(np.int64)
            counting = batch.column(2).to_numpy() == 0
            if counting.any():
                rows = batch.filter(pa.array(counting))
                b, sizes = _unpacked(rows.column(5), _NUMBER)
                counted, _ = _unpacked(rows.column(8), "<i8")
                ids = np.repeat(a[counting], sizes)
                stays = key >> 32 == a[0]  # postings of the last batch's id may go on
                own = np.concatenate([key[stays], (ids << 32) | b])
                counted = np.concatenate([n[stays], counted])
                # An id of several shards may come with its counts more than once.
                key, first = np.unique(own, return_index=True)
                n = counted[first]
                cuts = _runs(key >> 32)
                most = np.repeat(np.maximum.reduceat(n, cuts[:-1]), np.diff(cuts)) if len(key) else n
            rows = batch.filter(pa.array(~counting))
            if not rows.num_rows:
                continue
            b, sizes = _unpacked(rows.column(5), _NUMBER)
            at, _ = _unpacked(rows.column(6), "<u2")
            times, _ = _unpacked(rows.column(7), _NUMBER)
            where = np.searchsorted(key, (np.repeat(a[~counting], sizes) << 32) | b)
            start = np.empty(rows.num_rows, np.int64)
            for k, (chunk, docs) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)):
                if chunk not in place:
                    place[chunk] = (used, docs)
                    used += docs
                start[k] = place[chunk][0]
            if used > len(total):
                grown = max(used, 2 * len(total), 4096) - len(total)
                best, total = np.append(best, np.zeros(grown, np.int64)), np.append(total, np.zeros(grown, np.int64))
            slot = np.repeat(start, sizes) + at
            times = times.astype(np.int64)
            np.add.at(total, slot, times * n[where])
            top = n[where] == most[where]
            np.add.at(best, slot[top], times[top])
            if used > bounds.documents:
                yield from passed()
                place, used = {}, 0
                best[:], total[:] = 0, 0
        if place:
            yield from passed()

    return stream.mapInArrow(run, "chunk long, docs int, at binary, best binary, total binary")


def _by_document(parts: DataFrame) -> DataFrame:
    """(chunk, doc, n_best, count_sum): the contributions of all tasks summed."""
    schema = _types("chunk long, doc int, n_best long, count_sum long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, None, None

        def closed() -> pa.RecordBatch:
            own = np.flatnonzero(total)
            return _made(schema, len(own), chunk=np.full(len(own), now), doc=own, n_best=best[own], count_sum=total[own])

        for batch in batches:
            for k, (chunk, docs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if chunk != now:
                    if now is not None:
                        yield closed()
                    now, best, total = chunk, np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                (at, _), (x, _), (y, _) = (_unpacked(batch.column(c).slice(k, 1), kind) for c, kind in ((2, "<u2"), (3, "<i8"), (4, "<i8")))
                best[at] += x
                total[at] += y
        if now is not None:
            yield closed()

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, doc int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, bounds: Bounds = Bounds()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row for each input row.

    ``path_a``, ``path_b``: a byte-level BPE of the tokenizers library (.json) or a
    sentencepiece model (.model).  ``n_links`` counts pairs of tokens whose bytes
    overlap; a pair of ids counts once for each document that holds it linked, over
    all rows; ``count_sum`` adds these counts over a document's links, and ``n_best``
    counts the links whose pair has its A id's highest count (ties included).
    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of the ids between common ends; with
    ``digest`` its SHA-256.

    Null and empty texts have no tokens, and neither have texts whose tokens don't
    join to the text's own bytes: zeros, and empty ``groups``.  Rows that share an id
    or have none are documents of their own.  An empty table gives an empty one.
    Other columns of ``docs`` are not read.
    """
    texts = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = stash(_first_pass(texts, path_a, path_b, digest, bounds), "alignment")
    counts = stash(_summed(first.filter(F.col("kind") == _COUNTS), bounds), "pair_counts")
    none = F.expr("X''")
    # One row for each id of A at most: a table that the vocabulary bounds.
    shards = F.ceil(F.col("postings") / bounds.shard_postings).cast("int")
    split = counts.filter(F.col("postings") > bounds.shard_postings).select("a", shards.alias("shards"))
    postings = first.filter(F.col("kind") == _POSTINGS).join(F.broadcast(split), "a", "left")
    own = F.pmod(F.xxhash64("chunk"), F.coalesce("shards", F.lit(1))).cast("int")
    left = postings.select("a", own.alias("shard"), F.lit(1).alias("kind"), "chunk", "docs", "b", "at", "times", none.alias("n"))
    right = counts.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    right = right.select("a", "shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.lit(0).alias("docs"), "b", none.alias("at"), none.alias("times"), "n")
    stream = left.unionByName(right).repartition("a", "shard").sortWithinPartitions("a", "shard", "kind", "chunk")
    sums = stash(_by_document(_contributions(stream, bounds)), "document_sums")
    rows = first.filter(F.col("kind") == _DOC).select("chunk", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.join(sums, ["chunk", "doc"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.when(F.length("groups") > 0, F.lower(F.hex("groups")) if digest else F.col("groups").cast("string")).otherwise("").alias("groups"))
    discard(counts)
    return out


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """(a, b, documents): how many rows hold the two ids linked; cases as in ``align``."""
    texts = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = _first_pass(texts, path_a, path_b, True, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, sizes = _unpacked(batch.column(1), _NUMBER)
            n, _ = _unpacked(batch.column(2), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(b.astype(np.int32)), pa.array(n)], names=["a", "b", "documents"])

    return _summed(first.filter(F.col("kind") == _COUNTS), bounds).select("a", "b", "n").mapInArrow(run, "a int, b int, documents long")
