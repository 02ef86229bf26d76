"""MinHash near-duplicate groups with odd-sketch candidate filtering.

Each document's distinct word shingles give ``bands * rows`` MinHash samples.
Documents that agree on all samples of a band meet in a bucket.  The samples are
also folded into a parity bitmap (an odd sketch); the population count of the XOR
of two bitmaps estimates the similarity of a candidate pair, and pairs estimated
far below the threshold go.  What is left is confirmed on the full shingle sets.

Equal shingle sets are one class from the start, so copies never make pairs.  In
each bucket every class is first compared with one center only: the member that
meets the most others over all buckets.  A second round compares, in bounded
blocks, just those members around a center which the first round has left in
different components, and gives only links that join components.  So a large group
of near copies makes about one row a member, and no joining link is lost.  Around a
center with many such members, only sets whose sizes allow the similarity meet, and
of a block's sets only those are confirmed that share one of their rarest shingles,
as sets of that similarity must: texts that share just a long preamble don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.stash import discard, stash
from . import text as tx


@dataclass(frozen=True)
class NearDedup:
    """Parameters.  A pair at the threshold 0.8 shares no band with probability (1 - 0.8**rows)**bands."""

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    sketch_words: int = 8
    #: Similarity estimated by the odd sketch below which a candidate goes (five standard errors under 0.8).
    estimate: float = 0.62
    #: Members around a center that are compared in one block, and bytes of their sets.
    block: int = 1024
    block_bytes: int = 16 << 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_flips(self) -> int:
        """The largest XOR population count that still estimates ``estimate``."""
        bits = 64 * self.sketch_words
        return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * self.samples * (1 - self.estimate))))


def _hashers(p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(90001 + p.samples))
    return rng.integers(0, 2**32, p.samples, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, p.samples, dtype=np.uint32)


def minhash(values: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """The smallest of each hash function over a set of 64-bit values."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for k in range(0, len(x), step):
        np.minimum(least, (x[k : k + step, None] * a + b).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmap: the bit chosen by (sample number, sample) is flipped once for each sample."""
    bit = tx.mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * words)
    parity = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _band_keys(samples: np.ndarray, p: NearDedup) -> np.ndarray:
    h = np.arange(1, p.bands + 1, dtype=np.uint64)
    for k in range(p.rows):
        h = tx.mix(h * np.uint64(0x9E3779B97F4A7C15) + samples[k :: p.rows].astype(np.uint64))
    return h.view(np.int64)


def signatures(docs: DataFrame, p: NearDedup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, sketch); set_a and set_b are 128 bits of the set."""
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashers(p)
        for batch in tx.pieces(batches, 512):
            n = batch.num_rows
            size, ha, hb = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            bands, sketch = np.zeros((n, p.bands), np.int64), np.zeros((n, p.sketch_words), np.int64)
            for k, s in tx.document_shingles(batch.column(1), p.width):
                if not len(s):
                    continue
                m = minhash(s, a, b)
                size[k], ha[k] = len(s), np.sum(s, dtype=np.uint64).astype(np.int64)
                hb[k] = np.sum(tx.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64).astype(np.int64)
                bands[k], sketch[k] = _band_keys(m, p), odd_sketch(m, p.sketch_words)
            lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())) for x in (bands, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(ha), pa.array(hb), *lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def _flips(p: NearDedup, x: str, y: str) -> F.Column:
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(p.sketch_words)), F.lit(0))


def _similar(pairs: DataFrame, sketches: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (u, v) whose odd sketches are near enough."""
    a = sketches.select(F.col("rep").alias("u"), F.col("sketch").alias("su"))
    b = sketches.select(F.col("rep").alias("v"), F.col("sketch").alias("sv"))
    return pairs.join(a, "u").join(b, "v").filter(_flips(p, "su", "sv") <= p.most_flips).select("u", "v")


def shingle_sets(docs: DataFrame, ids: DataFrame, p: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """(rep, set): the sorted shingle hashes of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 512):
            sets = [s.tobytes() for _, s in tx.document_shingles(batch.column(1), p.width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(ids, "rep", "left_semi").mapInArrow(run, "rep long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (u, v) with 100 * |intersection| >= percent * |union| on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 1024):
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (left, right))
                if not len(x) or not len(y) or 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep[k] = 100 * both >= p.percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    a = sets.select(F.col("rep").alias("u"), F.col("set").alias("xu"))
    b = sets.select(F.col("rep").alias("v"), F.col("set").alias("xv"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "xu", "xv").mapInArrow(run, "u long, v long").distinct()


def _blocks(members: DataFrame, p: NearDedup, extra: list[str]) -> DataFrame:
    """Members (center, rep, n, label, sketch, ...) dealt to pairs of blocks of a center's members.

    Sets of similarity t have sizes within a factor of t.  So members of a center
    with over ``block`` of them go by classes of size, a factor of t wide: group g has
    the members of class g and, as upper ones, those of class g + 1, and only pairs
    with a member of class g count.  A group of over ``block`` members has several
    blocks, and so has one whose sets have over ``block_bytes``; each pair of blocks is
    dealt by itself, so no task holds more than two.
    """
    # Only centers, and groups, that need it are joined, from a written table: a few rows, which Spark may broadcast by their size.
    many = stash(members.groupBy("center").agg(F.count("*").alias("_n")).filter(F.col("_n") > p.block).select("center", F.lit(True).alias("many")), "many")
    own_class = F.floor(F.log(F.col("n").cast("double")) / (float(np.log(100 / p.percent)) + 1e-6)).cast("int")
    place = lambda g, upper: F.struct(g.alias("g"), F.lit(upper).alias("upper"))
    places = F.when(F.col("many"), F.array(place(own_class, False), place(own_class - 1, True))).otherwise(F.array(place(F.lit(0), False)))
    sized = members.join(many, "center", "left").withColumn("_at", F.explode(places)).select("*", "_at.g", "_at.upper").drop("_at", "many")
    cuts = stash(sized.groupBy("center", "g").agg(F.ceil(F.greatest(F.count("*") / p.block, F.sum("n") * 8 / p.block_bytes)).cast("int").alias("cut")).filter("cut > 1"), "cuts")
    cut = F.coalesce("cut", F.lit(1))
    dealt = sized.join(cuts, ["center", "g"], "left").withColumn("own", F.pmod(F.xxhash64("rep"), cut).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    dealt = dealt.select("center", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "upper", "rep", "label", "sketch", *extra)
    return dealt.repartition("center", "g", "i", "j").sortWithinPartitions("center", "g", "i", "j")


class _Group:
    """One pair of blocks in memory."""

    def __init__(self, rows: list[tuple], p: NearDedup):
        self.p, (self.center, _, self.i, self.j) = p, rows[0][:4]
        self.own = np.array([r[4] for r in rows])
        self.upper = np.array([r[5] for r in rows], bool)
        self.rep = np.array([r[6] for r in rows], np.int64)
        self.label = np.array([r[7] for r in rows], np.int64)
        # Unsigned, because bitwise_count counts the bits of the absolute value.
        self.sketch = np.array([r[8] for r in rows], np.int64).view(np.uint64)
        self.sets = [np.frombuffer(r[9], np.uint64) for r in rows] if len(rows[0]) > 9 else []

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each left member with the right members of other labels whose sketches are near enough."""
        left = np.flatnonzero(self.own == self.i)
        right = left if self.i == self.j else np.flatnonzero(self.own == self.j)
        for k, x in enumerate(left):
            y = right[k + 1 :] if self.i == self.j else right
            y = y[(self.label[y] != self.label[x]) & ~(self.upper[y] & self.upper[x])]
            far = np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(axis=1)
            if (far <= self.p.most_flips).any():
                yield x, y[far <= self.p.most_flips]

    def sharing(self) -> np.ndarray | None:
        """Which members share one of their rarest shingles; None if nearly all do, so that this saves nothing.

        A set of n of similarity t with another has ceil(t * n) shingles in common
        with it, so in any one order of all shingles the first n - ceil(t * n) + 1 of
        both have one in common.  The order is from rare to frequent in this group.
        """
        size = np.array([len(s) for s in self.sets])
        owner = np.repeat(np.arange(len(size)), size)
        _, which, times = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        order = np.lexsort((which, times[which], owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        early = order[place < np.repeat(size - -(-size * self.p.percent // 100) + 1, size)]
        by = early[np.argsort(which[early], kind="stable")]
        cuts = np.flatnonzero(np.diff(which[by])) + 1
        groups = [g for g in np.split(owner[by], cuts) if len(g) > 1]
        if sum(len(g) ** 2 for g in groups) > 4 * len(size) ** 2:
            groups = list({g.tobytes(): g for g in groups}.values())  # often the same members, for a run of shingles
            if sum(len(g) ** 2 for g in groups) > 16 * len(size) ** 2:
                return None
        out = np.zeros((len(size), len(size)), bool)
        for g in groups:
            out[np.ix_(g, g)] = True
        return out

    def flagged(self) -> list[tuple[int, int]]:
        hit = np.zeros(len(self.rep), bool)
        for x, y in self.near():
            hit[x] = True
            hit[y] = True
        return [(self.center, int(r)) for r in self.rep[hit]]

    def links(self) -> list[tuple[int, int]]:
        """Confirmed links that join labels which nothing in the group has joined before."""
        out, size, may = [], np.array([len(s) for s in self.sets]), self.sharing()
        for x, y in self.near():
            if may is not None:
                y = y[may[x, y]]
            y = y[(self.label[y] != self.label[x]) & (100 * np.minimum(size[y], size[x]) >= self.p.percent * np.maximum(size[y], size[x]))]
            for a in range(0, len(y), 256):
                part = y[a : a + 256]
                own = self.sets[x]
                values = np.concatenate([self.sets[k] for k in part])
                at = np.searchsorted(own, values)
                same = own[np.minimum(at, len(own) - 1)] == values
                both = np.add.reduceat(same, np.concatenate([[0], np.cumsum(size[part])[:-1]]), dtype=np.int64)
                for k in part[100 * both >= self.p.percent * (size[part] + size[x] - both)]:
                    if self.label[k] != self.label[x]:
                        out.append((int(self.rep[x]), int(self.rep[k])))
                        self.label[self.label == self.label[k]] = self.label[x]
        return out


def _compare(members: DataFrame, p: NearDedup, exact: bool) -> DataFrame:
    """exact: links (u, v); else the members (u: center, v: rep) that have a near sketch under another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            group = _Group(held, p)
            return group.links() if exact else group.flagged()

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

        for batch in batches:
            done: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:4] != row[:4]:
                    done += close()
                    held = []
                held.append(row)
            yield made(done)
        yield made(close())

    return _blocks(members, p, ["set"] if exact else []).mapInArrow(run, "u long, v long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct()


def near_duplicates(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.

    Null, empty and wordless texts have no shingles and are linked with nothing.
    Equal texts are in one component.  Rows that share an id are one document: they
    share their links and all carry its component.  A row with a null id is
    returned with a null component, and kept.  An empty table gives an empty one.
    Other columns of ``docs`` are not read.
    """
    sig = stash(signatures(tx.bounded(docs), p, id_col, text_col), "signatures")
    real = sig.filter("n_shingles > 0 and doc_id is not null")
    # Written, so that the join reads both sides anew and a class of very many copies can be split.
    classes = stash(real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = stash(real.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "rep").distinct(), "members")
    reps = real.join(classes.select("rep", "set_a", "set_b"), [real.doc_id == F.col("rep"), real.set_a == classes.set_a, real.set_b == classes.set_b]).select("rep", "n_shingles", "bands", "sketch")
    buckets = stash(reps.select("rep", F.explode("bands").alias("key")).distinct(), "buckets")
    sketches = reps.select("rep", "sketch")

    # A bucket's center is the member that meets the most others over all buckets: the likely hub of a group.
    met = stash(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "met")
    degree = met.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("degree"))
    centers = met.join(degree, "rep").groupBy("key").agg((-F.max(F.struct("degree", -F.col("rep")))["col2"]).alias("center"))
    around = stash(met.join(centers, "key").select("center", "rep").distinct(), "around")
    star = stash(_similar(around.filter("rep <> center").select(F.col("center").alias("u"), F.col("rep").alias("v")), sketches, p).distinct(), "star")
    sets = stash(shingle_sets(docs, _ends(star), p, id_col, text_col), "sets")
    # Rows of one id with different texts are one document.
    same = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    linked = stash(confirmed(star, sets, p).unionByName(same), "links")
    first = stash(connected_components(linked), "components")

    labelled = around.join(first, around.rep == first.node, "left").select("center", "rep", F.coalesce("component", "rep").alias("label"))
    split = labelled.groupBy("center").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("center")
    members = stash(labelled.join(split, "center").join(reps.select("rep", F.col("n_shingles").alias("n"), "sketch").distinct(), "rep").select("center", "rep", "n", "label", "sketch"), "split")
    flagged = stash(_compare(members, p, exact=False).select(F.col("u").alias("center"), F.col("v").alias("rep")), "flagged")
    sets2 = stash(shingle_sets(docs, flagged.select("rep").distinct(), p, id_col, text_col), "sets")
    sized = sets2.withColumn("n", (F.length("set") / 8).cast("long"))
    more = _compare(members.join(flagged, ["center", "rep"]).join(sized, ["rep", "n"]), p, exact=True)
    comp = stash(connected_components(linked.unionByName(more)), "components")
    discard(classes, buckets, met, around, star, sets, linked, first, members, flagged, sets2)

    found = member.join(comp, member.rep == comp.node, "left").select("doc_id", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component_id"))
    found = found.groupBy("doc_id", "n").agg(F.min("component_id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(found, (sig.doc_id == found.doc_id) & (sig.n_shingles == found.n), "left")
    out = out.select(sig.doc_id, "n_shingles", F.coalesce("component_id", sig.doc_id).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
