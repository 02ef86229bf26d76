"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(cut_k - w . x): one weight vector is shared by all ordered
cuts.  x marks the distinct words (runs of letters) and word beginnings of the whole
text that the model knows, over the root of their number, so that long texts score
little higher.  The model knows every feature of the sample that leans to toxic rows
with enough of a log-likelihood ratio, however many these are.  The
expected severity is the sum over k >= 1 of P(grade >= k).

The fit uses a bounded sample of labelled rows (``per_grade`` rows of each toxic
grade and ``clean_rows`` of grade 0, first in order of a hash of the id), weighted back to the grades' true shares.
Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import discard, stash
from . import text as tx


@dataclass(frozen=True)
class Ordinal:
    grades: int = 3
    #: Labelled rows of each toxic grade that the fit uses at most, and of grade 0.
    per_grade: int = 4000
    clean_rows: int = 12_000
    #: Bytes of a word's beginning that make a feature of their own.
    prefix: int = 5
    #: Features kept: those that lean to toxic rows with so high a log-likelihood ratio.
    least_ratio: float = 12.0
    #: Weight of the penalty on squared weights, against one sampled row.
    l2: float = 0.2
    steps: int = 500
    rate: float = 0.1
    #: P(grade >= 1) from which a document is toxic.
    threshold: float = 0.4


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    p: Ordinal

    def at_least(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row for each score."""
        return 1 / (1 + np.exp(np.clip(self.cuts - f[:, None], -50, 50)))


def row_features(column: pa.Array, prefix: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct feature hashes): words, and the first ``prefix`` bytes of longer ones."""
    mark = np.uint64(0x5DEECE66D)
    for a, b, data, off in tx.chunks(column):
        low, starts, ends, first = tx.words(data, off, tx.NOT_LETTERS)
        whole = tx.span_hashes(low, starts, ends)
        long = ends - starts > prefix
        begun = tx.mix(tx.span_hashes(low, starts[long], starts[long] + prefix) ^ mark)
        at = np.concatenate([[0], np.cumsum(long)])
        for k in range(b - a):
            i, j = first[k], first[k + 1]
            yield a + k, np.unique(np.concatenate([whole[i:j], begun[at[i] : at[j]]]))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """((grade, features) of the sampled rows, written; the labelled rows that each row of a grade stands for).

    Grade 0 is not toxic, 1 toxic, 2 toxic and of poor quality; rows without a
    toxic label are left out, a null quality counts as good.
    """
    grade = F.when(F.col("toxic") > 0, F.lit(1) + (F.coalesce("quality", F.lit(1)) == 0).cast("int")).otherwise(0)
    graded = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).select("doc_id", F.least(grade, F.lit(p.grades - 1)).alias("grade"))
    totals = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    parts = [graded.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.per_grade if g else p.clean_rows) for g in range(p.grades)]
    chosen = parts[0]
    for x in parts[1:]:
        chosen = chosen.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 512):
            found = [f.view(np.int64) for _, f in row_features(batch.column(1), p.prefix)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["grade", "features"])

    # The sample has at most clean_rows + (grades - 1) * per_grade rows of two numbers, so it can be broadcast.
    texts = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("grade", "text")
    sample = stash(texts.mapInArrow(run, "grade int, features array<long>"), "sample")
    seen = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    return sample, {g: totals[g] / n for g, n in seen.items()}


def telling_features(sample: DataFrame, p: Ordinal) -> np.ndarray:
    """The sorted hashes of the features kept, by log-likelihood ratio against the toxic share; the sample bounds their number."""
    rows = sample.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("grade") > 0).cast("int")), F.lit(0.0)).alias("r")).first()
    rate = min(max(rows["r"], 1e-6), 1 - 1e-6)
    by = sample.select((F.col("grade") > 0).cast("int").alias("toxic"), F.explode("features").alias("h")).groupBy("h").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).filter("n > 1")
    part = lambda k, share: k * F.log(F.greatest(k, F.lit(1e-9)) / (F.col("n") * share))
    ratio = 2 * (part(F.col("k").cast("double"), rate) + part((F.col("n") - F.col("k")).cast("double"), 1 - rate))
    kept = by.select("h", ratio.alias("ratio"), (F.col("k") > rate * F.col("n")).alias("over")).filter((F.col("ratio") >= p.least_ratio) & F.col("over")).select("h").toArrow()
    return np.sort(kept["h"].to_numpy().view(np.uint64))


def _loss_gradient(f: np.ndarray, grades: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weighted negative log-likelihood by f and by the cuts."""
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    up, down = (1 / (1 + np.exp(-np.clip(edge[grades + k] - f, -50, 50))) for k in (1, 0))
    mass = np.maximum(up - down, 1e-12)
    slope_up, slope_down = up * (1 - up), down * (1 - down)
    by_f = weights * (slope_up - slope_down) / mass
    by_cut = np.zeros(len(cuts))
    for k in range(len(cuts)):
        by_cut[k] = (weights * (np.where(grades == k + 1, slope_down, 0) - np.where(grades == k, slope_up, 0)) / mass).sum()
    return by_f, by_cut


def fit(values: np.ndarray, index: np.ndarray, row: np.ndarray, grades: np.ndarray, weights: np.ndarray, p: Ordinal) -> Model:
    """Full-batch Adam on the sampled rows; with no rows, nothing is toxic.

    Entry k says that row ``row[k]`` has feature ``values[index[k]]``.
    """
    if not len(grades):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(p.grades - 1, 30.0), p)
    n, l2 = len(values), p.l2 / len(grades)
    share = np.bincount(row, minlength=len(grades))[row] ** -0.5
    above = np.array([weights[grades > k].sum() for k in range(p.grades - 1)])
    above = np.clip(above, 1e-6, 1 - 1e-6) * np.geomspace(1, 0.999, p.grades - 1)
    cuts = -np.log(above / (1 - above))
    state = np.concatenate([np.zeros(n), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, p.steps + 1):
        w, cut = state[: n], state[n] + np.concatenate([[0], np.cumsum(np.exp(state[n + 1 :]))])
        f = np.bincount(row, w[index] * share, len(grades))
        by_f, by_cut = _loss_gradient(f, grades, weights, cut)
        g = np.empty_like(state)
        g[: n] = np.bincount(index, by_f[row] * share, n) + l2 * w
        g[n] = by_cut.sum()
        g[n + 1 :] = np.cumsum(by_cut[:0:-1])[::-1] * np.exp(state[n + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        state = state - p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    cut = state[n] + np.concatenate([[0], np.cumsum(np.exp(state[n + 1 :]))])
    return Model(values, state[: n], cut, p)


def train(docs: DataFrame, labels: DataFrame, p: Ordinal = Ordinal(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of labelled rows; ``labels`` has doc_id, quality and toxic.

    Labels without an id or a toxic mark are left out; of several labels of one
    document the most toxic and the poorest count.  Null and empty texts have no
    features; rows that share a labelled id all count.  Without labelled rows nothing is toxic.
    """
    sample, share = labelled_sample(docs, labels, p, id_col, text_col)
    values = telling_features(sample, p)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for x in batch.column(1):
                h = x.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(values, h), max(0, len(values) - 1))
                own.append(at[values[at] == h].astype(np.int32) if len(values) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["grade", "at"])

    rows = sample.select("grade", "features").mapInArrow(places, "grade int, at array<int>").toArrow()
    discard(sample)
    grades = rows["grade"].to_numpy()
    lists = rows["at"].combine_chunks()
    index = np.asarray(lists.flatten(), np.int64)
    row = np.repeat(np.arange(len(grades)), np.diff(np.asarray(lists.offsets))) if len(grades) else np.zeros(0, np.int64)
    weights = np.array([share[g] for g in grades.tolist()])
    return fit(values, index, row, grades, weights / max(weights.sum(), 1e-9), p)


class _Scorer:
    """P(grade >= k) of the texts of a column, with a bitmap before the look-up of features."""

    def __init__(self, model: Model):
        self.model, self.mask = model, np.uint64((1 << 22) - 1)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[model.features & self.mask] = True

    def __call__(self, column: pa.Array) -> np.ndarray:
        m, f = self.model, np.zeros(len(column))
        for k, x in row_features(column, m.p.prefix):
            x = x[self.maybe[x & self.mask]]
            if len(x):
                at = np.minimum(np.searchsorted(m.features, x), len(m.features) - 1)
                at = at[m.features[at] == x]
                f[k] = m.weights[at].sum() / max(1, len(at)) ** 0.5
        return m.at_least(f)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_toxic, expected_severity, toxic), one row for each input row.

    Null and empty texts have no features and get the labels' own shares.  Equal
    texts get equal scores.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(model)
        for batch in tx.pieces(batches, 512):
            over = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over[:, 0]), pa.array(over.sum(axis=1)), pa.array(over[:, 0] >= model.p.threshold)], names=["doc_id", "p_toxic", "expected_severity", "toxic"])

    rows = tx.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, p_toxic double, expected_severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, all columns as they are.

    Null and empty texts have no features and stay unless most labels are toxic;
    repeated rows stay or go together.  Empty in, empty out.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(model)
        for batch in tx.pieces(batches, 512):
            yield batch.filter(pa.array(score(batch.column(at))[:, 0] < model.p.threshold))

    return tx.bounded(docs).mapInArrow(run, docs.schema)
