"""Hidden Markov language model over words, trained by Baum-Welch over all training rows.

Observations are the most frequent training words, an end for each text, and for
any other word its class (byte length and last byte).  A text's probability is the
product of the scaled forward recursion over its observations and, for each word
that is seen as its class, the word's share of the class: (c + 1) / (N_g + V_g + 1)
with c the word's training count, N_g and V_g the class's tokens and distinct words.

Counts of words and the expected counts of each Baum-Welch round are summed in each
task, then shuffled by word and by observation.  Counts of frequent words go to the
tasks as a table of bounded size; all other words are joined by their hash.  Every
round reads all training rows.  Training and scores are exact over whole texts:
long ones are worked through in segments, with the forward and backward messages
carried from one to the next, so memory is bounded by a segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stash import stash
from . import text as tx

CLASSES = 128


@dataclass(frozen=True)
class Hmm:
    states: int = 16
    #: Words, seen twice at least, that are observations of their own, at most.
    vocabulary: int = 32_000
    #: Words whose counts every task holds, about; where counts tie, those of the least hashes.
    held_words: int = 400_000
    #: Baum-Welch rounds, each over all training rows.
    rounds: int = 5
    #: Tokens of a segment of a text, and of a batch that is computed at once.
    segment: int = 1024
    batch_tokens: int = 1 << 19
    #: Weight of the overall distribution in each state's own.
    smoothing: float = 50.0


def classes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word, from its length and last byte."""
    return (np.minimum((ends - starts) // 4, 3) * 32 + (low[ends - 1] & 31)).astype(np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text leaves 2 when divided by 7; rows with a null id are training rows."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(h, class, c): the count of every word of a text column, by its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        size = 0

        def made() -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            kind = np.concatenate(kinds)[first]
            hashes.clear()
            kinds.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind), pa.array(n.astype(np.int64))], names=["h", "class", "n"])

        for batch in batches:
            for _, _, data, off in tx.chunks(batch.column(0)):
                low, starts, ends, _ = tx.words(data, off)
                hashes.append(tx.span_hashes(low, starts, ends))
                kinds.append(classes(low, starts, ends))
                size += len(starts)
                if size >= flush:
                    yield made()
                    size = 0
        if size:
            yield made()

    return texts.mapInArrow(run, "h long, class int, n long").groupBy("h", "class").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Words:
    """Counts of the frequent words, in order of hash, and what else tasks need to read a text."""

    hashes: np.ndarray
    counts: np.ndarray
    #: Rank among the vocabulary, or the vocabulary's size for words outside it.
    rank: np.ndarray
    size: int
    tokens: int
    distinct: int
    #: log10(N_g + V_g + 1) of each class.
    class_norm: np.ndarray
    ends: int
    #: Words of at least the second count are held, and of those of at least the first the share of the lower hashes.
    border: tuple[int, int]
    share: float

    @property
    def symbols(self) -> int:
        return self.size + CLASSES + 1

    @property
    def end(self) -> int:
        return self.size + CLASSES

    @property
    def norm(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))


def is_held(border: tuple[int, int], share: float) -> Column:
    """Whether a word of the count table is held."""
    c, at = F.col("c"), int(share * 2**64) - 2**63
    low = F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("long")) < F.lit(min(at, 2**63 - 1)).cast("long")
    return (c >= border[1]) | ((c >= border[0]) & low)


class Reader:
    """Looks words up by their hash's upper bits, then along the few that share them."""

    BITS = 20

    def __init__(self, words: Words):
        self.words = words
        top = (words.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.BITS) + 1)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the held words, or -1."""
        out = np.full(len(h), -1, np.int32)
        bucket = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end, rest = self.first[bucket], self.first[bucket + 1], np.arange(len(h))
        while True:
            live = at < end
            at, end, rest = at[live], end[live], rest[live]
            if not len(rest):
                return out
            hit = self.words.hashes[at] == h[rest]
            out[rest[hit]] = at[hit]
            at, end, rest = at[~hit] + 1, end[~hit], rest[~hit]


def frequent(counts: DataFrame, p: Hmm, train_rows: int) -> Words:
    """The held words of a count table.

    The least count held is found from a histogram of counts with ten significant
    bits, which has at most some tens of thousands of rows at any size of corpus.  Of
    the counts at the border, so many words are held as there is room, by their hash.
    """
    power = F.greatest(F.lit(0), F.floor(F.log2(F.col("c").cast("double"))).cast("int") - 9)
    coarse = F.pow(F.lit(2.0), power).cast("long")
    hist = counts.groupBy((F.floor(F.col("c") / coarse) * coarse).cast("long").alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc("at")).collect()
    low, high, share, room = 1 << 62, 1 << 62, 0.0, p.held_words
    for r in hist:
        low, share = r["at"], min(1.0, room / r["n"])
        room -= r["n"]
        if room < 0:
            break
        high = r["at"]
    by_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    held = counts.filter(is_held((low, high), share)).toArrow()
    h, c, kind = held["h"].to_numpy().view(np.uint64), held["c"].to_numpy(), held["class"].to_numpy()
    order = np.argsort(h)
    h, c, kind = h[order], c[order], kind[order]
    # Words seen once are always read as their class, so that classes stand for new words too.
    ranked = np.lexsort((h, -c))[: min(p.vocabulary, int((c > 1).sum()))]
    size = len(ranked)
    rank = np.full(len(h), size, np.int32)
    rank[ranked] = np.arange(size)
    n_g, v_g = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        n_g[r["class"]], v_g[r["class"]] = r["n"], r["v"]
    tokens, distinct = int(n_g.sum()) + train_rows, int(v_g.sum()) + (train_rows > 0)
    n_g -= np.bincount(kind[ranked], c[ranked], CLASSES)
    v_g -= np.bincount(kind[ranked], minlength=CLASSES)
    return Words(h, c, rank, size, tokens, distinct, np.log10(n_g + v_g + 1), train_rows, (low, high), share)


SEQUENCES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, log_class double, symbols binary, far binary"


def sequences(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's observations, the sums over its held words, and the hashes of its other words.

    log_all sums log10(c + 1) over held words and the end; log_class sums, over
    words seen as their class, log10(c + 1) where c is held less the class's norm.
    """
    kind = "<u2" if words.symbols <= 1 << 16 else "<u4"
    known = docs.sparkSession.sparkContext.broadcast(words)  # at most held_words rows of 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = known.value
        reader, row = Reader(w), TaskContext.get().partitionId() << 40
        log_count = np.append(np.log10(w.counts + 1.0), 0.0)  # the last is for words not held
        rank = np.append(w.rank, w.size)
        for batch in tx.pieces(batches, 1024):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "log_all", "log_class", "symbols", "far")}
            for a, b, data, off in tx.chunks(batch.column(2)):
                low, starts, ends, first = tx.words(data, off)
                h = tx.span_hashes(low, starts, ends)
                at, g = reader.find(h), classes(low, starts, ends)
                r, logs = rank[at], log_count[at]
                seen_as_class = r == w.size
                symbol = np.where(seen_as_class, w.size + g, r)
                by_class = np.where(seen_as_class, logs - w.class_norm[g], 0.0)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (logs, by_class, at >= 0)]
                for k in range(b - a):
                    i, j = first[k], first[k + 1]
                    out["n_tokens"].append(j - i + 1)
                    out["n_known"].append(int(sums[2][j] - sums[2][i]) + (w.ends > 0))
                    out["log_all"].append(sums[0][j] - sums[0][i] + np.log10(w.ends + 1.0))
                    out["log_class"].append(sums[1][j] - sums[1][i])
                    out["symbols"].append(np.append(symbol[i:j], w.end).astype(kind).tobytes())
                    out["far"].append(h[i:j][at[i:j] < 0].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            columns = [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", *out])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SEQUENCES)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # observations x states


@dataclass
class Counts:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def zero(states: int, symbols: int) -> Counts:
        return Counts(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def normalised(c: Counts, share: np.ndarray, p: Hmm) -> Model:
    """The model of expected counts; ``share`` is the overall distribution of observations."""
    emit = c.emit + p.smoothing * share[:, None]
    step = c.step + 0.1
    return Model((c.start + 0.1) / (c.start + 0.1).sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _in_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of sequences by length, sequences alive at each step, first place of each step)."""
    order = np.argsort(-lengths, kind="stable")
    alive = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), "right")
    return order, alive, np.concatenate([[0], np.cumsum(alive)])


def _by_step(seqs: list[np.ndarray], order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observations step after step, and the sequence of each."""
    lengths = np.array([len(seqs[k]) for k in order], np.int64)
    seq = np.repeat(np.arange(len(order)), lengths)
    at = np.arange(len(seq)) - np.concatenate([[0], np.cumsum(lengths)])[seq]
    place = first[at] + seq
    obs, who = np.empty(len(seq), np.int64), np.empty(len(seq), np.int64)
    obs[place] = np.concatenate([seqs[k] for k in order])
    who[place] = seq
    return obs, who


def expect(seqs: list[np.ndarray], m: Model, c: Counts, size: int = 1024) -> None:
    """Add the expected counts of whole sequences.

    A first pass keeps the forward message at the end of each segment of ``size``
    steps; from the last segment on, each is then run forward again from there, and
    backward from the message of the segment after it.
    """
    seqs = sorted(seqs, key=len, reverse=True)
    lengths = np.array([len(s) for s in seqs], np.int64)
    emit, step = m.emit.astype(np.float32), m.step.astype(np.float32)
    start, backward = m.start.astype(np.float32), step.T.copy()
    borders: list[np.ndarray] = []  # the message at the end of each segment but the last, of sequences that go on
    for k in range(int(lengths.max(initial=0) - 1) // size):
        n = int((lengths > (k + 1) * size).sum())
        body, state = np.stack([s[k * size : (k + 1) * size] for s in seqs[:n]], axis=1), borders[-1][:n] if borders else None
        for t in range(size):
            state = (state @ step if state is not None else start) * emit[body[t]]
            state /= state.sum(axis=1, keepdims=True)
        borders.append(state)
    moves, carried = np.zeros_like(m.step), None
    for k in range(len(borders), -1, -1):
        live = int((lengths > k * size).sum())
        if not live:
            break
        cut = [s[k * size : (k + 1) * size] for s in seqs[:live]]
        order, alive, first = _in_step(np.array([len(s) for s in cut]))
        obs, _ = _by_step(cut, order, first)
        own = emit[obs]
        alpha, scale = np.empty_like(own), np.empty(len(obs), np.float32)
        for t in range(len(alive)):
            a, b = first[t], first[t + 1]
            if t:
                before = alpha[first[t - 1] : first[t - 1] + b - a] @ step
            else:
                before = borders[k - 1][:live] @ step if k else start
            now = before * own[a:b]
            total = now.sum(axis=1)
            np.divide(now, total[:, None], out=alpha[a:b])
            scale[a:b] = total
        own /= scale[:, None]
        ahead = carried
        for t in range(len(alive) - 1, -1, -1):
            a, b = first[t], first[t + 1]
            back = np.ones((b - a, step.shape[0]), np.float32)
            if ahead is not None:
                n = len(ahead)
                moves += alpha[a : a + n].T @ ahead
                back[:n] = ahead @ backward
            ahead = own[a:b] * back
            if t == 0 and k == 0:
                c.start += (alpha[a:b] * back).sum(axis=0)
            alpha[a:b] *= back  # now the states' posterior
        carried = ahead
        for s in range(step.shape[0]):
            c.emit[:, s] += np.bincount(obs, alpha[:, s], len(c.emit))
    c.step += moves * m.step


def log_likelihoods(seqs: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 probability of each whole sequence, by the scaled forward recursion."""
    lengths = np.array([len(s) for s in seqs], np.int64)
    order, alive, first = _in_step(lengths)
    obs, who = _by_step(seqs, order, first)
    scale, state = np.empty(len(obs)), None
    for t, n in enumerate(alive):
        a, b = first[t], first[t + 1]
        now = (np.broadcast_to(m.start, (n, len(m.start))) if t == 0 else state[:n] @ m.step) * m.emit[obs[a:b]]
        total = now.sum(axis=1)
        state = now / total[:, None]
        scale[a:b] = total
    out = np.empty(len(seqs))
    out[order] = np.bincount(who, np.log10(scale), len(seqs))
    return out


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _batched(batches: Iterator[pa.RecordBatch], col: int, bytes_each: int, most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined or cut to about ``most`` observations."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in tx.pieces(iter([batch]), 512):
            held.append(part)
            size += part.column(col).nbytes // bytes_each
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _grouped(batches: Iterator[pa.RecordBatch], kind: str, segment: int, most: int) -> Iterator[list[np.ndarray]]:
    """The sequences of column 0 in groups of about ``most`` observations.

    Those longer than a segment go among themselves, four times as many at once: a
    group is worked through segment by segment.
    """
    held: list[list[np.ndarray]] = [[], []]
    size = [0, 0]
    for batch in batches:
        for x in _arrays(batch.column(0), kind):
            k = int(len(x) > segment)
            held[k].append(x.copy())
            size[k] += len(x)
            if size[k] >= (most, 4 * most)[k]:
                yield held[k]
                held[k], size[k] = [], 0
    yield from (x for x in held if x)


def train(seqs: DataFrame, words: Words, p: Hmm) -> Model:
    """Baum-Welch over all training rows of ``seqs``, from a random first guess.

    A round's expected counts reach the driver as one row for each observation and
    state, a number that the vocabulary bounds.  Without training rows the guess stands.
    """
    kind = "<u2" if words.symbols <= 1 << 16 else "<u4"
    rng = np.random.Generator(np.random.PCG64(5))
    share = np.full(words.symbols, 0.01)
    held = words.rank < words.size
    share[words.rank[held]] += words.counts[held]
    share[words.size : words.size + CLASSES] += np.maximum(0, 10**words.class_norm - 1)
    share[words.end] += words.ends
    share /= share.sum()
    guess = Counts.zero(p.states, words.symbols)
    guess.emit += 1000 * share[:, None] * rng.gamma(1.0, 1.0, guess.emit.shape)
    guess.step += np.eye(p.states) * 50 + 1
    guess.start += 1
    m = normalised(guess, share, p)
    names, symbols = [f"s{k}" for k in range(p.states)], words.symbols
    rows = seqs.filter("not held_out").select("symbols")
    for _ in range(p.rounds if words.ends else 0):
        sent = seqs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = Counts.zero(p.states, symbols)
            for group in _grouped(batches, kind, p.segment, p.batch_tokens):
                expect(group, sent.value, c, p.segment)
            table = np.concatenate([c.emit, c.step, c.start[None]])
            seen = np.flatnonzero(table.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), *(pa.array(table[seen, k]) for k in range(p.states))], names=["at", *names])

        made = rows.mapInArrow(run, "at long, " + ", ".join(f"{n} double" for n in names))
        got = made.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        table = np.zeros((symbols + p.states + 1, p.states))
        table[got["at"].to_numpy()] = np.stack([got[n].to_numpy() for n in names], axis=1)
        m = normalised(Counts(table[-1], table[symbols:-1], table[:symbols]), share, p)
    return m


def score(docs: DataFrame, p: Hmm = Hmm(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    Learns from the rows that ``held_out`` leaves.  Null and empty texts are one
    end.  Words never trained on have count 0.  Repeated rows count and are scored
    as often as they occur; with no training rows every count is 0.
    """
    train_docs = tx.bounded(docs).filter(~held_out(id_col))
    texts = train_docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stash(word_counts(texts), "counts")
    words = frequent(counts, p, train_docs.count())
    seqs = stash(sequences(docs, words, id_col, text_col), "sequences")
    m = train(seqs, words, p)
    sent = docs.sparkSession.sparkContext.broadcast(m)
    kind, width = ("<u2", 2) if words.symbols <= 1 << 16 else ("<u4", 4)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batched(batches, 0, width, 2 * p.batch_tokens):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(log_likelihoods(_arrays(batch.column(0), kind), sent.value))], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_class", "forward"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 512):
            own = [np.unique(x, return_counts=True) for x in _arrays(batch.column(1), "<u8")]
            row = np.repeat(batch.column(0).to_numpy(), [len(h) for h, _ in own])
            h = np.concatenate([h for h, _ in own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(h), pa.array(np.concatenate([n for _, n in own]).astype(np.int32))], names=["row", "h", "n"])

    own = seqs.select("symbols", "row", "doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_class").mapInArrow(forward, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, log_class double, forward double")
    rest = seqs.filter(F.length("far") > 0).select("row", "far").mapInArrow(far, "row long, h long, n int").join(counts.filter(~is_held(words.border, words.share)).select("h", "c"), "h")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log_far"), F.sum("n").alias("known_far"))
    zero = F.lit(0)
    out = own.join(rest, "row", "left")
    log_far = F.coalesce("log_far", zero.cast("double"))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_far", zero)).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("log_all") + log_far - F.col("n_tokens") * words.norm).alias("base_score"),
        (F.col("forward") + F.col("log_class") + log_far).alias("score"),
    )
