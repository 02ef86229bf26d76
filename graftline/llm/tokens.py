"""Whole-text encoding with a public tokenizer, one dictionary lookup for each distinct piece of a batch.

A text is cut at blanks and line ends that the tokenizer's own splitting never
joins across, so the ids of a text are the ids of its pieces in order.  Arrow finds
a chunk's distinct pieces and gathers their ids; each worker keeps a bounded
dictionary of pieces, and new ones go through the tokenizers library.  A text whose
blanks the cut can't trust, or that may hold the string of an added token, is encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Pieces that a worker's dictionary holds since it was last full; as many older ones may stay.
CACHE_PIECES = 200_000
#: Bytes of text encoded at once; a longer single text forms a chunk of its own.
CHUNK_BYTES = 2 << 20
END_ID = 1

#: A word of letters that are such in every version of Unicode, and ASCII marks after it.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: A blank or line end at an end, white space beside white space, or any other kind of it.
_UNSAFE = "^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
_encoders: dict[tuple[str, bool, int], PieceEncoder] = {}


class _Known(dict):
    """Ids of pieces, of bounded number: those used since it last filled up, and as a reserve those before."""

    def __init__(self, learn: Callable[[str], bytes], pieces: int):
        super().__init__()
        self.learn, self.pieces, self.before = learn, pieces, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.before.get(x)
        if ids is None:
            ids = self.learn(x)
        self[x] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.pieces:
            self.before = dict(self)
            self.clear()


class PieceEncoder:
    """Ids of texts as unsigned 32-bit numbers, or as 16-bit ones if ``short``.

    Strings of special tokens give these tokens' ids if ``special``, else the ids of ordinary text.
    """

    def __init__(self, path: str, short: bool = False, pieces: int = CACHE_PIECES, special: bool = True):
        self.code, self.kind = ("H", "<u2") if short else ("I", "<u4")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.vocab_size = self.tokenizer.get_vocab_size()
        split = spec.get("pre_tokenizer") or {}
        parts = split.get("pretokenizers", [])
        #: "led": a piece keeps the space before it; "dropped": white space gives no ids; "whole": no cutting.
        self.cut = "whole"
        if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer"):
            self.cut = "led"
        elif parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in parts[0]["pattern"].get("Regex", ""):
            self.cut = "dropped"
        #: How strings of added tokens begin; a text without these holds none.
        marks = sorted({t["content"][:2] for t in spec.get("added_tokens", [])}) if special else []
        if any(c.isalpha() or not c.isascii() for m in marks for c in m):  # a normalizer may make them
            self.cut = "whole"
        #: A text with a match is encoded whole.
        self.whole = "|".join(([_UNSAFE] if self.cut == "led" else []) + [re.escape(m) for m in marks])
        self.known = _Known(self._learn, pieces)

    def _learn(self, piece: str) -> bytes:
        """A word of letters goes through the merges alone; marks after it have ids of their own."""
        lead, x = (" ", piece[1:]) if piece[:1] == " " else ("", piece)
        merge, lower = self.tokenizer.model.tokenize, self.cut == "dropped"
        if not x and lower:
            return b""
        if x.isascii() and x.islower() and x.isalpha():  # bytes are written as the letters that they are
            return array(self.code, [t.id for t in merge((_LETTERS[32] + x) if lead else x)]).tobytes()
        m = _MARKED.fullmatch(x)
        if m is None:
            return self._ids([piece])[0]
        word, marks = m.groups()
        if lower:
            word = word.lower()
        if marks:
            return self.known[lead + word] + self.known[marks]
        if word != x:
            return self.known[lead + word]
        return array(self.code, [t.id for t in merge(piece.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets) of chunks: the ids of a string column's texts one after the other; nulls are empty."""
        collects = gc.isenabled()
        gc.disable()  # many new strings, no cycles
        try:
            for a, b, data, off in tx.chunks(column, CHUNK_BYTES):
                yield a, b, *self._chunk(column.slice(a, b - a).fill_null(""), data, off)
        finally:
            if collects:
                gc.enable()

    def _chunk(self, texts: pa.Array, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = np.ones(len(texts), bool)
        if self.cut != "whole":
            apart = pc.match_substring_regex(texts, self.whole).to_numpy(False) if self.whole else np.zeros(len(texts), bool)
            if apart.any():
                data, off = tx.string_parts(pc.if_else(pa.array(apart), "", texts))
            ids, at = self._pieces(data, off)
            if not apart.any():
                return ids, at
        rows = iter(self._ids(texts.filter(pa.array(apart)).to_pylist()))
        found = [np.frombuffer(next(rows), self.kind) if w else ids[at[k] : at[k + 1]] for k, w in enumerate(apart.tolist())]
        return np.concatenate(found) if found else np.zeros(0, self.kind), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts that are cut: before each blank, and before and after each line end."""
        line = data == 10
        begin = (data == 32) | line
        if self.cut == "dropped":
            data = np.where(line, np.uint8(32), data)
        else:
            begin[1:] |= line[:-1]
        begin[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        ends = np.append(starts, len(data))
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        own = pieces.dictionary.to_numpy(False).tolist()
        if self.cut == "dropped":
            own = [x[1:] if x[:1] == " " else x for x in own]
        self.known.turn()
        gathered = pa.array(list(map(self.known.__getitem__, own)), pa.large_binary()).take(pieces.indices)
        _, at, ids = gathered.buffers()
        at = np.frombuffer(at, np.int64)[: len(starts) + 1] // np.dtype(self.kind).itemsize
        ids = np.frombuffer(ids, self.kind)[: at[-1]] if ids is not None and at[-1] else np.zeros(0, self.kind)
        return ids, at[np.searchsorted(starts, off)]


def encoder(path: str, short: bool = False, pieces: int = CACHE_PIECES) -> PieceEncoder:
    """This worker's encoder of a tokenizer file."""
    key = (path, short, pieces)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None = END_ID, short: bool = False, pieces: int = CACHE_PIECES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of column 1 and their offsets; nulls are empty, ``end_id`` closes each text."""
    enc = encoder(path, short, pieces)
    for batch in batches:
        for a, b, ids, at in enc.encode(batch.column(1)):
            if end_id is not None:
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            yield batch.slice(a, b - a), ids, at


def binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of each row's ids, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(id, n_tokens): the encoded length of each row's whole text.

    Null and empty texts hold the end alone; null ids stay null, and repeated rows
    are counted as often as they occur.  Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at))], names=["id", "n_tokens"])

    return tx.bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long")
