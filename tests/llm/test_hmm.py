import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graftline.llm import hmm
from graftline.llm.hmm import Hmm, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def rows(n=300):
    rng = random.Random(4)
    tongues = [[a + b for a in x for b in "aeiou"] for x in (["th", "wh", "ng", "st"], ["sch", "ver", "ung", "tz"])]
    out = []
    for i in range(n):
        own = tongues[i % 2]
        words = ["".join(rng.choices(own, k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.choice([0, 1, 3, 40, 200]))]
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out + [(1000, None), (1001, ""), (1001, "thA THa unseenword"), (None, "tha"), (1002, "tha " * 30_000)]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.mark.parametrize("p", [Hmm(states=3, vocabulary=30, held_words=60, segment=50), Hmm(states=2)])
def test_contract(spark, p):
    data = rows()
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in data], "doc_id long, text string, h int, row int").repartition(3)
    got = sorted(map(tuple, score(docs, p).collect()), key=str)
    c = Counter()
    for d, t in data:
        if not held(d):
            c.update([*words_of(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in data:
        own = [*words_of(t), None]
        want.append((d, held(d), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    want.sort(key=str)
    key = lambda r: (str(r[0]), r[2], r[3])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    out = [g for g in got if g[1]]
    assert sum(g[6] for g in out) > sum(g[5] for g in out)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score(docs).collect() == []
    only = spark.createDataFrame([(d, "a b") for d in range(60) if held(d)], "doc_id long, text string")
    assert all(r.n_known == 0 and r.base_score == 0 and r.score <= 0 for r in score(only).collect())


def brute(seq, m):
    """Sum over all state paths."""
    import itertools

    total = 0
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        x = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:], strict=False):
            x *= m.step[a, b] * m.emit[o, b]
        total += x
    return total


def random_model(rng, s, n):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    start = norm(rng.random(s), 0)
    return hmm.Model(start, norm(rng.random((s, s)), 1), norm(rng.random((n, s)), 0))


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    m = random_model(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 6, 2, 4, 6)]
    assert hmm.log_likelihoods(seqs, m) == pytest.approx([math.log10(brute(s, m)) for s in seqs])


@pytest.mark.parametrize("size", [1, 2, 3, 1024])
def test_expected_counts(size):
    """Over whole sequences, however they are cut into segments."""
    import itertools

    rng = np.random.default_rng(2)
    m = random_model(rng, 2, 4)
    seqs = [rng.integers(0, 4, n) for n in (3, 5, 1, 6, 6)]
    c = hmm.Counts.zero(2, 4)
    hmm.expect(seqs, m, c, size)
    want = hmm.Counts.zero(2, 4)
    for seq in seqs:
        z = brute(seq, m)
        for path in itertools.product(range(2), repeat=len(seq)):
            x = m.start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, o in zip(path, path[1:], seq[1:], strict=False):
                x *= m.step[a, b] * m.emit[o, b]
            x /= z
            want.start[path[0]] += x
            for a, b in zip(path, path[1:], strict=False):
                want.step[a, b] += x
            for s, o in zip(path, seq, strict=True):
                want.emit[o, s] += x
    for a, b in ((c.start, want.start), (c.step, want.step), (c.emit, want.emit)):
        assert np.allclose(a, b, atol=1e-4)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    truth = random_model(rng, 3, 12)
    m = random_model(rng, 3, 12)
    seqs = [rng.choice(12, p=truth.emit[:, k % 3], size=80) for k in range(60)]
    last = -np.inf
    for _ in range(6):
        now = hmm.log_likelihoods(seqs, m).sum()
        assert now > last
        last, c = now, hmm.Counts.zero(3, 12)
        hmm.expect(seqs, m, c, 30)
        m = hmm.normalised(c, np.full(12, 1 / 12), Hmm(smoothing=0.01))


def test_ties_do_not_empty_the_vocabulary(spark):
    """Words of one count, more of them than are held: as many as there is room for are held and observed."""
    texts = [(d, " ".join(f"w{k}" for k in range(200))) for d in range(40) if not held(d)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    counts = hmm.word_counts(docs.select("text"))
    for most in (300, 150, 20):
        w = hmm.frequent(counts, Hmm(held_words=most), len(texts))
        assert w.size == len(w.hashes) and (w.size == 200 if most >= 200 else 0.6 * most < w.size < 1.5 * most)
        assert counts.filter(~hmm.is_held(w.border, w.share)).count() == 200 - w.size
