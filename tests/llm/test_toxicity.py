import random
import re

import numpy as np
import pyarrow as pa

from graftline.llm import queries, toxicity
from graftline.llm.toxicity import Ordinal, severity, train


def rows(n, seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("na", "ri", "to", "lem", "shu")]
    out = []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = rng.choices(vocab, k=rng.choice([5, 30, 200]))
        if toxic:
            for _ in range(rng.choice([1, 2, 5])):
                words.insert(rng.randrange(len(words)), rng.choice(["Vileword!", "scumbagish", "ÄRGÄR"]))
        out.append((i, " ".join(words), int(toxic), int(rng.random() > 0.1)))
    return out


def test_held_out_accuracy(spark):
    data = rows(1500, 1)
    docs = spark.createDataFrame([(d, t, 0, 0.0) for d, t, _, _ in data], "doc_id long, text string, grade int, p_toxic double").repartition(3)
    labels = spark.createDataFrame([(d, q, y) for d, _, y, q in data[:1000]] + [(3000, 1, None), (None, 1, 1), (5, None, data[5][2])], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r for r in severity(docs, model).collect()}
    assert len(got) == 1500
    held = data[1000:]
    assert sum(got[d].toxic for d, _, y, _ in held if y) > 0.95 * sum(y for *_, y, _ in held)
    assert sum(got[d].toxic for d, _, y, _ in held if not y) <= 0.01 * len(held)
    assert (np.diff(model.cuts) > 0).all()
    assert all(abs(r.expected_severity - r.p_toxic) < 1 and r.expected_severity >= r.p_toxic for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "Vileword!"), (2, "x " * 100_000), (7, "bana"), (8, "bana")], "doc_id long, text string")
    odd = severity(odd, model).collect()
    assert len(odd) == 6 and len({(r.p_toxic, r.toxic) for r in odd if r.doc_id in (7, 8)}) == 1
    assert next(r for r in odd if r.doc_id is None).toxic and not next(r for r in odd if r.doc_id == 1).toxic
    assert severity(docs.limit(0), model).collect() == []


def by_hand(model, text):
    """(probability of being toxic, expected severity) of a text, word by word."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def names(word):
        """The hashes of a word and of its beginning, each as a text of its own."""
        out = {int(h) for _, own in toxicity.row_features(pa.array([word]), 10**6) for h in own}
        beginning = word[: model.p.prefix]
        if len(word) > model.p.prefix:
            mark = np.uint64(0x5DEECE66D)
            low = np.frombuffer(beginning, np.uint8)
            out.add(int(toxicity.tx.mix(toxicity.tx.span_hashes(low, np.array([0]), np.array([len(low)])) ^ mark)[0]))
        return out

    words = {w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())}
    known = [weight[h] for h in set().union(*map(names, words), set()) if h in weight]
    f = sum(known) / max(1, len(known)) ** 0.5
    over = [1 / (1 + np.exp(c - f)) for c in model.cuts]
    return over[0], sum(over)


def test_scores_by_hand(spark):
    """Every document's probabilities, word by word."""
    data = rows(400, 3)
    data = [(d, t + (" Straße né\u00e9 x-y1z Ünï" if d % 3 else ""), y, q) for d, t, y, q in data] + [(900, "", 0, 1)]
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in data], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(d, q, y) for d, _, y, q in data], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in severity(docs, model).collect()}
    for d, t, _, _ in data:
        p_toxic, expected = by_hand(model, t)
        assert abs(got[d].p_toxic - p_toxic) < 1e-9 and abs(got[d].expected_severity - expected) < 1e-9


def test_query_by_hand(spark):
    """The registered query over all documents: each score from the trained model word by word, and how it stands against the labels."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model, got = train(docs, labels), {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        p_toxic, expected = by_hand(model, t or "")
        assert abs(got[d].p_toxic - p_toxic) < 1e-6 and abs(got[d].expected_severity - expected) < 1e-6
    clean = [got[r.doc_id].toxic for r in labels.filter("toxic = 0").collect()]
    assert sum(clean) <= 0.05 * len(clean)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.toxic for r in severity(docs, model).collect()] == [False]


def test_gradient():
    rng = np.random.default_rng(0)
    f, grades, weights, cuts = rng.normal(size=20), rng.integers(0, 3, 20), rng.random(20), np.array([-0.3, 0.9])

    def loss(f, cuts):
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = lambda x: 1 / (1 + np.exp(-x))
        return -(weights * np.log(s(edge[grades + 1] - f) - s(edge[grades] - f))).sum()

    by_f, by_cut = toxicity._loss_gradient(f, grades, weights, cuts)
    for k in range(20):
        step = np.eye(20)[k] * 1e-6
        assert abs((loss(f + step, cuts) - loss(f - step, cuts)) / 2e-6 - by_f[k]) < 1e-4
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert abs((loss(f, cuts + step) - loss(f, cuts - step)) / 2e-6 - by_cut[k]) < 1e-4


def test_sample_is_bounded(spark):
    data = rows(300, 2)
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, y) for d, _, y, q in data], "doc_id long, quality int, toxic int")
    sample, share = toxicity.labelled_sample(docs, labels, Ordinal(per_grade=10, clean_rows=20))
    seen = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    assert (seen[0], seen[1]) == (20, 10) and abs(sum(seen[g] * share[g] for g in seen) - 300) < 1e-6
