"""Exact deduplication by owners in Patricia tries.

Every task inserts its whole texts, as byte strings, into a local trie, so that the
copies within a task are one terminal node from the start: a text that makes up a
third of the table leaves a task a few times only.  Terminals are then dealt by
length and content hash to owning partitions, which insert the full byte strings
into tries of their own.  An owner's terminal node holds the identifier that stays,
the number of rows and the local terminals that ended there; these answer for
their documents through one join.  Equality is decided by bytes, never by a hash.

An edge of a trie is a pair of offsets into one of the strings below it: all of
these share their bytes up to the edge's end, so an offset means the same in each.
A trie that grows beyond its bound moves its largest subtree to an unlinked
temporary file of the task and leaves a stub of one byte; strings that reach the
stub follow, and the file is then read into a trie of its own.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import discard, stash
from . import text as tx

#: Bytes that a task's trie of its own texts holds before its terminals are passed on.
LOCAL_BYTES = 16 << 20
#: Bytes that an owner's trie holds before it spills a subtree.
OWNER_BYTES = 64 << 20
#: Bytes counted for a node beside its string.
NODE_BYTES = 400
#: Bytes of texts in one batch of results.
BATCH_BYTES = 2 << 20


class Terminal:
    """What is known of one string: the identifier that stays, its rows, and the marks of those who inserted it."""

    __slots__ = ("best", "rows", "marks")

    def __init__(self):
        self.best, self.rows, self.marks = None, 0, []


class _Node:
    __slots__ = ("text", "end", "children", "terminal", "spill")

    def __init__(self, text: bytes, end: int):
        self.text, self.end = text, end
        self.children: dict[int, _Node] = {}
        self.terminal: Terminal | None = None
        self.spill = None


def _shared(a: bytes, b: bytes, low: int, high: int) -> int:
    """The first offset from ``low`` on at which the strings differ, or ``high``; they agree before ``low``."""
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings that share their first ``skip`` bytes.

    ``largest``: whether the largest identifier stays, else the smallest.  A null
    identifier stays only where there is no other.  Beyond ``limit`` bytes the largest subtree is
    spilled; with ``limit`` None none is.
    """

    def __init__(self, largest: bool = False, limit: int | None = None, skip: int = 0):
        self.largest, self.limit, self.skip = largest, limit, skip
        self.root = _Node(b"", skip)
        self.held = self.strings = self.spilled = 0

    def insert(self, key: bytes, best: int | None, rows: int = 1, marks: list | None = None) -> Terminal | None:
        """The terminal of ``key`` with this identifier taken in; None if it was passed to a spilled subtree."""
        node = self.root
        while node.end < len(key):
            at = node.end
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key, len(key))
                self.held += len(key) - at + NODE_BYTES
            elif child.spill is not None:
                pickle.dump((key, best, rows, marks or []), child.spill)
                return None
            elif key[at : child.end] != child.text[at : child.end]:
                fork = _Node(child.text, _shared(key, child.text, at, min(len(key), child.end)))
                fork.children[child.text[fork.end]] = child
                node.children[key[at]] = child = fork
                self.held += NODE_BYTES
            node = child
        found = node.terminal
        if found is None:
            found = node.terminal = Terminal()
            node.text = key
            self.strings += 1
            self.held += NODE_BYTES
        if found.best is None or (best is not None and (best > found.best if self.largest else best < found.best)):
            found.best = best
        found.rows += rows
        if marks:
            found.marks += marks
        if self.limit is not None:
            while self.held > self.limit and self.strings > 1 and self._spill():
                pass
        return found

    def _sizes(self) -> dict[int, tuple[int, int]]:
        """(bytes, strings) below each node, its own edge included."""
        order, todo = [], [(self.root, self.skip)]
        while todo:
            node, start = todo.pop()
            order.append((node, start))
            todo += [(c, node.end) for c in node.children.values()]
        sizes: dict[int, tuple[int, int]] = {}
        for node, start in reversed(order):
            below = [sizes[id(c)] for c in node.children.values()]
            own = node.terminal is not None
            sizes[id(node)] = (node.end - start + NODE_BYTES * (1 + own) + sum(b for b, _ in below), own + sum(n for _, n in below))
        return sizes

    def _spill(self) -> bool:
        """Move the largest subtree that isn't most of the trie, or else the largest single string, to a file."""
        sizes, path, node = self._sizes(), [self.root], self.root
        while True:
            open_ = [c for c in node.children.values() if c.spill is None]
            if not open_:
                return False
            child = max(open_, key=lambda c: sizes[id(c)])
            if sizes[id(child)][1] <= max(1, self.strings // 2) or not child.children:
                break
            node = child
            path.append(node)
        at = node.end
        prefix = child.text[: at + 1]
        for above in path:  # their strings may lie in the subtree that goes
            if above.terminal is None:
                above.text = prefix
        stub = _Node(prefix, at + 1)
        stub.spill = tempfile.TemporaryFile()
        todo = [child]
        while todo:
            gone = todo.pop()
            if gone.spill is not None:
                gone.spill.seek(0)
                for row in _rows_of(gone.spill):
                    pickle.dump(row, stub.spill)
                gone.spill.close()
            if gone.terminal is not None:
                pickle.dump((gone.text, gone.terminal.best, gone.terminal.rows, gone.terminal.marks), stub.spill)
            todo += gone.children.values()
        node.children[prefix[at]] = stub
        self.held -= sizes[id(child)][0]
        self.strings -= sizes[id(child)][1]
        self.spilled += 1
        return True

    def terminals(self) -> Iterator[tuple[bytes, Terminal]]:
        """Each string with its terminal; spilled subtrees come after the rest, from tries of their own. The trie is emptied."""
        todo, files = [self.root], []
        self.root = _Node(b"", self.skip)
        self.held = self.strings = 0
        while todo:
            node = todo.pop()
            if node.terminal is not None:
                yield node.text, node.terminal
            if node.spill is not None:
                files.append((node.spill, node.end))
            todo += node.children.values()
        while files:
            file, skip = files.pop()
            part = PatriciaTrie(self.largest, self.limit, skip)
            file.seek(0)
            for row in _rows_of(file):
                part.insert(*row)
            file.close()
            yield from part.terminals()


def _rows_of(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _inserted(docs: DataFrame, largest: bool, local_bytes: int) -> DataFrame:
    """A row (doc_id, mark) for each row, and a row (mark, digest, text, best, rows) for each local terminal."""
    schema = "doc_id long, mark long, digest binary, text binary, best long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, next_mark = PatriciaTrie(largest), TaskContext.get().partitionId() << 40
        digests: dict[int, bytes] = {}

        def passed(keep: bool) -> Iterator[pa.RecordBatch]:
            """All terminals; if ``keep``, those of repeated strings stay, up to a quarter of the bound."""
            held, out, size = [], [], 0
            room = local_bytes // 4
            for key, t in trie.terminals():
                if keep and t.rows > 1 and room > 0:
                    room -= len(key) + 2 * NODE_BYTES
                    held.append((key, t))
                    continue
                out.append((None, t.marks[0], digests.pop(t.marks[0]), key, t.best, t.rows))
                size += len(key)
                if size > BATCH_BYTES:
                    yield _batch(out, schema_names)
                    out, size = [], 0
            for key, t in held:
                trie.insert(key, t.best, t.rows, t.marks)
            if out:
                yield _batch(out, schema_names)

        for batch in batches:
            ids, marks = batch.column(0), []
            data, off = tx.string_parts(batch.column(1))
            data, digest = data.tobytes(), batch.column(2)
            for k, best in enumerate(ids.to_pylist()):
                t = trie.insert(data[off[k] : off[k + 1]], best)
                if not t.marks:
                    t.marks.append(next_mark)
                    digests[next_mark] = digest[k].as_py()
                    next_mark += 1
                marks.append(t.marks[0])
                if trie.held > local_bytes:
                    yield from passed(True)
            n = len(marks)
            yield pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=schema_names)
        yield from passed(False)

    schema_names = ["doc_id", "mark", "digest", "text", "best", "size"]
    return docs.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _owners(terminals: DataFrame, largest: bool, owner_bytes: int) -> DataFrame:
    """(mark, digest, keep_id, group_size): what each local terminal's string belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(largest, owner_bytes)
        for batch in batches:
            for mark, digest, text, best, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(text, best, size, [(mark, digest)])
        rows: list[tuple] = []
        for _, t in trie.terminals():
            rows += [(mark, digest, t.best, t.rows) for mark, digest in t.marks]
            if len(rows) >= 4096:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["mark", "digest", "keep_id", "group_size"])

    dealt = terminals.repartition(F.length("text"), F.col("digest")).select("mark", "digest", "text", "best", "size")
    return dealt.mapInArrow(run, "mark long, digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", local_bytes: int = LOCAL_BYTES, owner_bytes: int = OWNER_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each input row; ``digest`` is the SHA-256 of the text in UTF-8.

    Texts are equal when all their bytes are; a null text is an empty one.  Of
    equal texts the row with the smallest (``keep``: or the largest) identifier
    stays, and ``group_size`` counts all rows.  Repeated rows of one identifier and text are one
    document: they are counted one by one and stay or go together.  A null
    identifier stays only where every equal text has one, and all of these stay.
    An empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    texts = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    inserted = stash(_inserted(hashed, keep == "largest", local_bytes), "inserted")
    owners = stash(_owners(inserted.filter("text is not null"), keep == "largest", owner_bytes), "owners")
    rows = inserted.filter("text is null").select("doc_id", "mark")
    out = rows.join(owners, "mark").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return out


def without_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns; identifiers must be unique.

    Rows without an identifier stay where ``exact_duplicates`` keeps them.
    """
    gone = exact_duplicates(docs, keep, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
