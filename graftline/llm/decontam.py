"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark texts are cut into overlapping windows (a short text is one window).  A
place of a document that matches a window of n characters with at most e edits
shares at least n - q + 1 - q * e of its q-grams, all within e diagonals of each
other.  So the q-grams shared with a text are counted in overlapping diagonal bands
and there for each window; windows that reach the bound are regions, and each region
is verified by banded alignment.  Any excerpt of window + stride - 1 characters holds
a whole window, so it is found wherever in the benchmark text it begins.  A window
that several benchmark texts share is held once, for the first of them, with the
number of texts that hold it; so a preamble common to all of them costs no more than one.

Characters are bytes of the UTF-8 text, with A-Z in lower case and each white space
as one blank.  The query set (the benchmark) is held in blocks of bounded size, and
every block is run against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx


@dataclass(frozen=True)
class Decontam:
    q: int = 10
    #: Characters of a window, and from one window to the next.
    window: int = 96
    stride: int = 8
    #: Edits for each character of a window.
    edit_share: float = 0.08
    #: Shorter benchmark texts are matched exactly, as whole words.
    least_chars: int = 40
    #: Characters of benchmark text whose index is broadcast at once.
    block_chars: int = 1_000_000

    def edits(self, n: int) -> int:
        """The edit budget of a window of n characters; smaller where q-grams would bound nothing."""
        return max(0, min(int(n * self.edit_share), (n - self.q) // self.q))

    def bound(self, n: int) -> int:
        return max(1, n - self.q + 1 - self.q * self.edits(n))


_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 11, 12, 13]] = 32
_BLANK[65:91] += 32
#: Bytes of words in lower case: ASCII letters and digits, and all of longer characters.
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[48:58, 97:123, 128:256]] = True


def _qgrams(low: np.ndarray, q: int) -> np.ndarray:
    at = np.arange(max(0, len(low) - q + 1))
    return tx.span_hashes(low, at, at + q)


@dataclass(frozen=True)
class Index:
    """Benchmark texts of one block, the starts of their windows, and the places of their q-grams."""

    p: Decontam
    ids: list[int | None]
    body: list[np.ndarray]
    #: Characters of each text's windows, and q-grams that a match of one shares.
    size: np.ndarray
    bound: np.ndarray
    #: Text and start of each window, and the benchmark texts that hold it.
    source: np.ndarray
    begin: np.ndarray
    shared: np.ndarray
    #: Of windows that several texts hold: the items of the others.
    others: dict[int, list[int | None]]
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    #: The first item, the number of items and the other items of each short text, and the sorted hashes and distinct lengths of the short texts.
    short: dict[bytes, list]
    short_hashes: np.ndarray
    short_lengths: list[int]

    @property
    def item(self) -> np.ndarray:
        """The item of each window."""
        return np.array(self.ids, object)[self.source]

    def window(self, w: int) -> np.ndarray:
        t, a = self.source[w], self.begin[w]
        return self.body[t][a : a + self.size[t]]

    @property
    def text(self) -> list[np.ndarray]:
        return [self.window(w) for w in range(len(self.source))]

    @staticmethod
    def build(items: list[tuple[int | None, str]], p: Decontam) -> Index:
        """The index of benchmark texts in order: where windows or short texts are equal, the first item stands."""
        ids, body, short = [], [], {}
        grams, owner, place, source, begin = [np.zeros(0, np.uint64)], *([np.zeros(0, np.int32)] for _ in range(4))
        seen: dict[bytes, list[int]] = {}  # window: its number, the items that hold it, the last of these
        others: dict[int, list[int | None]] = {}
        for number, (i, t) in enumerate(items):
            low = _BLANK[np.frombuffer(t.encode(), np.uint8)]
            if len(low) < max(p.least_chars, p.q):
                if own := low.tobytes().strip():
                    held = short.setdefault(own, [i, 0, []])
                    held[1] += 1
                    if held[1] > 1:
                        held[2].append(i)
                continue
            n = min(len(low), p.window)
            starts = []
            for a in sorted({*range(0, len(low) - n + 1, p.stride), len(low) - n}):
                held = seen.get(w := low[a : a + n].tobytes())
                if held is None:
                    seen[w] = [len(seen), 1, number]
                    starts.append(a)
                elif held[2] != number:
                    held[1], held[2] = held[1] + 1, number
                    others.setdefault(held[0], []).append(i)
            if not starts:
                continue
            # Only q-grams inside windows that this text holds first.
            inside = np.zeros(len(low) + 1, np.int32)
            np.add.at(inside, starts, 1)
            np.add.at(inside, np.array(starts) + (n - p.q + 1), -1)
            at = np.flatnonzero(np.cumsum(inside)[: len(low) - p.q + 1])
            grams.append(_qgrams(low, p.q)[at])
            owner.append(np.full(len(at), len(ids), np.int32))
            place.append(at.astype(np.int32))
            source.append(np.full(len(starts), len(ids), np.int32))
            begin.append(np.array(starts, np.int32))
            ids.append(i)
            body.append(low)
        h, own, at, of, starts = (np.concatenate(x) for x in (grams, owner, place, source, begin))
        order = np.argsort(h, kind="stable")
        values, first = np.unique(h[order], return_index=True)
        size = np.array([min(len(x), p.window) for x in body], np.int64)
        bound = np.array([p.bound(n) for n in size.tolist()], np.int64)
        brief, ends = np.frombuffer(b"".join(short), np.uint8), np.cumsum([0, *map(len, short)])
        shared = np.array([n for _, n, _ in seen.values()], np.int64)
        return Index(p, ids, body, size, bound, of.astype(np.int64), starts.astype(np.int64), shared, others, values, np.append(first, len(h)).astype(np.int32), own[order], at[order], short, np.unique(tx.span_hashes(brief, ends[:-1], ends[1:])), sorted({*map(len, short)}))


def _align(windows: list[np.ndarray], texts: list[np.ndarray], band: int) -> np.ndarray:
    """Least edits of each window against its text, starting and ending anywhere within the band.

    Text position i + k stands against window position i, for k in 0 .. band - 1;
    all pairs are aligned together, one column of the band after the other.
    """
    n = max(map(len, windows))
    pattern, body = np.zeros((n, len(windows)), np.int16), np.full((n + band, len(windows)), -1, np.int16)
    sizes = np.array([len(w) for w in windows])
    for c, (w, t) in enumerate(zip(windows, texts, strict=True)):
        pattern[: len(w), c] = w
        body[: len(t), c] = t[: n + band]
    far = np.int32(1 << 20)
    now = np.zeros((band + 1, len(windows)), np.int32)
    now[band] = far
    out = np.zeros(len(windows), np.int32)
    for i in range(n):
        step = np.minimum(now[:band] + (body[i : i + band] != pattern[i]), now[1 : band + 1] + 1)
        for k in range(1, band):
            np.minimum(step[k], step[k - 1] + 1, out=step[k])
        now[:band] = step
        ended = sizes == i + 1
        if ended.any():
            out[ended] = step[:, ended].min(axis=0)
    return out


def _cut(low: np.ndarray, start: int, end: int, least: int, most: int) -> np.ndarray:
    """low[start:end] with -1 before the document's first character, so that diagonals before it exist."""
    body = low[max(start, least) : min(end, most)].astype(np.int16)
    return np.concatenate([np.full(least - start, -1, np.int16), body]) if start < least else body


def _regions(low: np.ndarray, off: np.ndarray, index: Index, maybe: np.ndarray) -> Iterator[Region]:
    """(document, item, items, start, end, edits) of verified regions of a chunk."""
    p, mask = index.p, np.uint64(len(maybe) - 1)
    h = _qgrams(low, p.q)
    at = np.flatnonzero(maybe[h & mask])
    h = h[at]
    k = np.minimum(np.searchsorted(index.grams, h), len(index.grams) - 1)
    hit = index.grams[k] == h
    at, k = at[hit], k[hit]
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + p.q <= off[doc + 1]
    at, k, doc = at[inside], k[inside], doc[inside]
    # A document must have enough hits for the smallest bound before its hits are spread over texts.
    enough = np.bincount(doc, minlength=len(off) - 1)[doc] >= index.bound.min(initial=1 << 62)
    at, k, doc = at[enough], k[enough], doc[enough]
    if not len(at):
        return
    head = index.first[k].astype(np.int64)
    size = index.first[k + 1] - head
    post = np.repeat(head - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    at, doc, text, place = np.repeat(at, size), np.repeat(doc, size), index.owner[post].astype(np.int64), index.place[post].astype(np.int64)
    shift = max(map(len, index.body))
    diagonal = at - place + shift  # not negative
    reach = max(p.edits(p.window), 1)
    # Bands of 2 * reach diagonals, one every reach diagonals: drift of up to reach lies whole in one of them.
    band = np.concatenate([diagonal // reach, diagonal // reach - 1])
    # One number for (document, text, band): documents and texts of a chunk are few.
    packed = (np.tile(doc * len(index.body) + text, 2) << np.int64(32)) | (band + 1)
    place = np.tile(place, 2)
    order = np.lexsort((place, packed))
    packed, place = packed[order], place[order]
    new = np.ones(len(packed), bool)
    new[1:] = (packed[1:] != packed[:-1]) | (place[1:] != place[:-1])
    packed, place = packed[new], place[new]
    groups, head, counts = np.unique(packed, return_index=True, return_counts=True)
    keep = counts >= index.bound[(groups >> np.int64(32)) % len(index.body)]
    place, groups, lowest, highest = place[np.repeat(keep, counts)], groups[keep], place[head[keep]], place[(head + counts - 1)[keep]]
    t, rank = (groups >> np.int64(32)) % len(index.body), np.arange(len(groups)) << np.int64(32)
    # The windows of the text between a band's first and last hit; a window's hits are counted in the sorted places.
    key = (index.source << np.int64(32)) + index.begin
    inner = index.size[t] - p.q
    w0 = np.searchsorted(key, (t << np.int64(32)) + np.maximum(lowest - inner, 0))
    n = np.searchsorted(key, (t << np.int64(32)) + highest, "right") - w0
    w = np.repeat(w0 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    hits = np.repeat(rank, counts[keep]) + place
    low_key = np.repeat(rank, n) + index.begin[w]
    shared = np.searchsorted(hits, low_key + np.repeat(inner, n), "right") - np.searchsorted(hits, low_key)
    near = shared >= np.repeat(index.bound[t], n)
    pair, w = np.repeat(groups, n)[near], w[near]
    d, b = (pair >> np.int64(32)) // len(index.body), (pair & np.int64((1 << 32) - 1)) - 1
    width = 4 * reach + 1
    for a in range(0, len(d), 4096):
        dd, ww = d[a : a + 4096], w[a : a + 4096]
        start = (b[a : a + 4096] - 1) * reach - shift + index.begin[ww]
        own = [index.window(x) for x in ww]
        texts = [_cut(low, s, s + len(x) + width, off[y], off[y + 1]) for s, x, y in zip(start, own, dd, strict=True)]
        edits = _align(own, texts, width)
        for y, v, x, m, s, e, n in zip(dd.tolist(), ww.tolist(), index.source[ww].tolist(), index.shared[ww].tolist(), start.tolist(), edits.tolist(), map(len, own), strict=True):
            if e <= p.edits(n):
                s += reach
                yield y, index.ids[x], m, max(s, int(off[y])), min(s + n + reach, int(off[y + 1])), e, tuple(index.others.get(v, ()))


def _exact(low: np.ndarray, off: np.ndarray, index: Index) -> Iterator[Region]:
    """(document, item, items, start, end, 0, other items) of the places of short benchmark texts, which no letter or digit goes on."""
    if not index.short or not len(low):
        return
    letter = _LETTER[low]
    free = np.ones(len(low) + 1, bool)
    free[1:-1] = ~(letter[1:] & letter[:-1])
    free[off] = True
    starts = np.flatnonzero(free[:-1])
    doc = np.searchsorted(off, starts, "right") - 1
    limit = off[doc + 1]
    for n in index.short_lengths:
        fits = starts + n <= limit
        fits[fits] = free[starts[fits] + n]
        at, own = starts[fits], doc[fits]
        if not len(at):
            continue
        h = tx.span_hashes(low, at, at + n)
        k = np.minimum(np.searchsorted(index.short_hashes, h), len(index.short_hashes) - 1)
        hit = index.short_hashes[k] == h
        for d, a in zip(own[hit].tolist(), at[hit].tolist(), strict=True):
            if held := index.short.get(low[a : a + n].tobytes()):
                item, items, others = held
                yield d, item, items, a, a + n, 0, tuple(others)


#: (document, item, items, start, end, edits, other items) of a matched window.
Region = tuple[int, int | None, int, int, int, int, tuple]


def _best(regions: Iterator[Region], p: Decontam) -> Iterator[Region]:
    """The regions with those that better ones of other items cover, but for what edits and the stride leave open, told among these items' others.

    Regions count in order of their edits; so where benchmark texts are alike, the
    nearest of them stands for a place, and names the rest.
    """
    by_doc: dict[int, list] = {}
    for r in regions:
        by_doc.setdefault(r[0], []).append(r)
    for own in by_doc.values():
        if len({r[1] for r in own}) == 1:
            yield from own
            continue
        first = min(r[3] for r in own)
        size = max(r[4] for r in own) - first
        covered, by = bytearray(size), np.full(size, -1, np.int64)
        taken: dict[int | None, list[Region]] = {}
        named: dict[int | None, set] = {}
        items: list[int | None] = []
        for r in sorted(own, key=lambda r: r[5]):
            _, item, _, a, b, _, others = r
            a, b = a - first, b - first
            if item in taken or covered.count(0, a, b) > 2 * p.edits(b - a) + p.stride:
                taken.setdefault(item, []).append(r)
                free = by[a:b] < 0
                by[a:b][free] = len(items)
                items.append(item)
                covered[a:b] = b"\1" * (b - a)
            else:  # of the items that cover it, the one that covers the most
                over = by[a:b]
                stands = items[int(np.bincount(over[over >= 0]).argmax())]
                named.setdefault(stands, set()).update((item, *others))
        for item, rows in taken.items():
            more = tuple(named.get(item, ()))
            for k, r in enumerate(rows):
                yield (*r[:6], r[6] + more) if not k else r


class _Finder:
    """Benchmark texts in the texts of a column."""

    def __init__(self, index: Index):
        self.index = index
        bits = max(16, int(np.ceil(np.log2(max(1, len(index.grams)) * 16))))
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[index.grams & np.uint64((1 << bits) - 1)] = True

    def __call__(self, column: pa.Array) -> dict[tuple[int, int | None], list]:
        """(row, item): [items, regions, start, end, edits, other items], in code points."""
        found: dict[tuple[int, int | None], list] = {}
        for a, _, data, off in tx.chunks(column):
            letter = None
            low = _BLANK[data]
            for d, item, items, start, end, e, others in chain(_best(_regions(low, off, self.index, self.maybe), self.index.p), _exact(low, off, self.index)):
                if letter is None:
                    letter = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                s, t = (int(letter[x] - letter[off[d]]) for x in (start, end))
                was = found.setdefault((a + d, item), [items, 0, s, t, e, set()])
                was[5].update(x for x in others if x is not None and x != item)
                was[:5] = [max(was[0], items), was[1] + 1, min(was[2], s), max(was[3], t), min(was[4], e)]
        return found


def _indexes(benchmark: DataFrame, p: Decontam) -> Iterator[Index]:
    """An index of each block of the benchmark, of at most about ``block_chars`` characters."""
    texts = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text is not null")
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // p.block_chars))
    for block in range(blocks):
        own = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy(F.asc_nulls_last("item_id"), "text")
        index = Index.build([(r["item_id"], r["text"]) for r in own.collect()], p)
        if index.ids or index.short:
            yield index


def leaks(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, items, regions, start, end, edits, also): the benchmark texts found in each document row.

    A window or short text that several benchmark texts share counts as found for the
    first of them in order of id, and items says how many share it (in a block of the
    benchmark).  A region that nearer matches of other items cover is counted as theirs; so
    what all benchmark texts begin with gives one row a document.  ``also`` names, in order, the
    other benchmark texts that share a row's windows or whose regions it covers: every
    pair of a document and a benchmark text found in it is a row's item_id or in its also.
    start and end span the matched windows in code points (to within the edit
    budget), edits is the best window's.  A benchmark text under ``least_chars`` bytes
    is found where it stands exactly (letter case and kind of white space aside) and no
    letter, digit or byte over 127 goes on at its ends.  Null, empty and blank texts on
    either side match nothing; repeated rows give repeated results; a null id of either
    side stays null.
    """
    spark = docs.sparkSession
    rows = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, items long, regions long, start long, end long, edits int, also array<long>"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, p):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            find = _Finder(held.value)
            for batch in tx.pieces(batches, 1024):
                found = find(batch.column(1))
                at = pa.array([k for k, _ in found], pa.int64())
                columns = [batch.column(0).take(at), pa.array([i for _, i in found], pa.int64()), *(pa.array([v[k] for v in found.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())))]
                columns.append(pa.array([sorted(v[5]) for v in found.values()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "items", "regions", "start", "end", "edits", "also"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text by the rules of ``leaks``, all columns as they are.

    Null and empty texts stay; repeated rows stay or go together.  Empty in, empty out.
    """
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, p):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            find = _Finder(held.value)
            for batch in tx.pieces(batches, 1024):
                keep = np.ones(batch.num_rows, bool)
                keep[[k for k, _ in find(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = tx.bounded(docs).mapInArrow(run, docs.schema)
    return docs
