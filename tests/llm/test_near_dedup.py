import random
import re

import numpy as np
import pytest

from graftline.llm.near_dedup import NearDedup, _Group, near_duplicates, odd_sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if same or (sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        out.append((d, len(sets[i]), c, True if d is None else d == c))
    return sorted(out, key=str)


def sample(n=160, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocab) for _ in range(55))
    rows, base = [], [rng.choice(vocab) for _ in range(90)]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 60]))]
        elif kind == 1:
            words = common.split() + [rng.choice(vocab) for _ in range(rng.choice([5, 12, 20, 60]))]
        else:
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1000 - i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(5, None), (6, ""), (7, " \n"), (8, "One"), (9, "one"), (10, "Ärger ÄRGER x"), (10, "Ärger ÄRGER x"), (11, rows[3][1]), (12, rows[3][1].upper()), (None, rows[3][1])]
    rows += [(20, "p q r s t u v w"), (20, "a b c d e f g h"), (21, "a b c d e f g h"), (22, "p q r s t u v w")]
    return rows


@pytest.mark.parametrize(("width", "block"), [(4, 1024), (5, 4)])
def test_against_brute_force(spark, width, block):
    rows = sample()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rep int, component string").repartition(3)
    got = near_duplicates(docs, NearDedup(width=width, block=block)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width, 80)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = near_duplicates(spark.createDataFrame([(1, "x " * 50000)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, True)]


def test_near_counts_all_flips():
    rng, p = np.random.Generator(np.random.PCG64(4)), NearDedup()
    base = rng.integers(0, 2**32, p.samples, dtype=np.uint32)
    rows = []
    for k in range(80):
        own = np.where(rng.random(p.samples) < 0.1, rng.integers(0, 2**32, p.samples, dtype=np.uint32), base)
        rows.append((0, 0, 0, 0, 0, False, k, k, odd_sketch(own, p.sketch_words).tolist()))
    got = {(int(x), int(k)) for x, y in _Group(rows, p).near() for k in y}
    flips = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(rows[x][8], rows[y][8], strict=True))
    assert got == {(x, y) for y in range(80) for x in range(y) if flips(x, y) <= p.most_flips}


def test_many_near_copies(spark):
    """Copies of one template at similarities around 0.8, whose links lie mostly apart from the center."""
    rng = random.Random(0)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(2, 8)):
            words[rng.randrange(150)] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates(docs, NearDedup(width=4)).collect()
    want = brute(rows, 4, 80)
    assert len({r[2] for r in want}) > 20
    assert sorted(map(tuple, got), key=str) == want


def test_classes_of_size(spark):
    """Texts that share a long beginning, of many lengths: only those of like sizes meet around their center, and no link is lost."""
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    common, rows = [rng.choice(vocab) for _ in range(60)], []
    for i in range(160):
        n = rng.choice([8, 12, 30, 45, 60])
        own = [rng.choice(vocab) for _ in range(n)] if i % 4 or i < 8 else list(rows[rng.randrange(i)][1].split()[60:])
        if i % 4 == 0 and own:
            own[rng.randrange(len(own))] = "zz"
        rows.append((i, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 4, 80)
    assert len({r[2] for r in want}) > 20
    for block in (3, 1024):
        assert sorted(map(tuple, near_duplicates(docs, NearDedup(width=4, block=block)).collect()), key=str) == want


@pytest.mark.parametrize("block_bytes", [16 << 20, 20_000])
def test_shared_preamble(spark, block_bytes):
    """Texts just below the threshold because of one long beginning, a few of them linked by what follows it."""
    rng = random.Random(7)
    preamble, rows = [f"p{i}" for i in range(150)], []
    for i in range(240):
        own = [f"o{rng.randrange(10**9)}" for _ in range(45)]
        if i % 6 == 5:
            own = rows[-1][1].split()[150:]
            own[rng.randrange(20, 45)] = "changed"
        rows.append((i, " ".join(preamble + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 4, 80)
    assert len({r[2] for r in want}) == 200
    assert sorted(map(tuple, near_duplicates(docs, NearDedup(width=4, block_bytes=block_bytes)).collect()), key=str) == want


def test_sharing_loses_no_similar_pair():
    rng, p = np.random.Generator(np.random.PCG64(11)), NearDedup()
    sets = []
    for k in range(120):
        base = sets[rng.integers(0, k)] if k % 3 else rng.integers(0, 5000, 80).astype(np.uint64)
        keep = base[rng.random(len(base)) > rng.choice([0.02, 0.08, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 5000, rng.integers(0, 12)).astype(np.uint64)])))
    group = _Group([(0, 0, 0, 0, 0, False, k, k, [0] * p.sketch_words, s.tobytes()) for k, s in enumerate(sets)], p)
    may, similar = group.sharing(), 0
    for x in range(120):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                similar += 1
                assert may[x, y]
    assert similar > 50 and may.mean() < 0.9
