import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from graftline.operators import consensus, dedupe, graph, joins, matching


@pytest.mark.parametrize("seed", range(3))
def test_band_and_interval_joins(spark, seed):
    rng = random.Random(seed)
    a = [(rng.choice("xy"), i, rng.randrange(-40, 200)) for i in range(80)]
    b = [(rng.choice("xy"), i, rng.randrange(-40, 200)) for i in range(80)]
    left, right = spark.createDataFrame(a, "k string, i int, p int"), spark.createDataFrame(b, "k string, j int, q int")
    got = sorted((r.i, r.j) for r in joins.band_join(left, right, ["k"], "p", "q", 21).collect())
    assert got == sorted((i, j) for k, i, p in a for m, j, q in b if k == m and p - 21 <= q < p)
    a = [(k, i, p, p + rng.choice([0, 1, 5, 90])) for k, i, p in a]
    b = [(k, i, p, p + rng.choice([0, 1, 5, 90])) for k, i, p in b]
    left, right = spark.createDataFrame(a, "k string, i int, s int, e int"), spark.createDataFrame(b, "k string, j int, t int, f int")
    got = sorted((r.i, r.j) for r in joins.interval_join(left, right, ["k"], ("s", "e"), ("t", "f"), 16).collect())
    want = sorted((i, j) for k, i, s, e in a for m, j, t, f in b if k == m and s < f and t < e and s < e and t < f)
    assert got == want
    for levels in (1, 2):
        assert sorted((r.i, r.j) for r in joins.interval_join(left, right, ["k"], ("s", "e"), ("t", "f"), 4, levels).collect()) == want


def test_nearest_within_equals_search(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice("xy"), rng.randrange(400), rng.choice(["5p", "3p"])) for _ in range(150)})
    df = joins.nearest_within(spark.createDataFrame(rows, "k string, p int, o string"), ["k"], "p", F.col("o") == "5p", F.col("o") == "3p", 9, width=32)
    got = {(r.k, r.p, r.o): (r.near_5p, r.near_3p) for r in df.collect()}
    assert len(got) == len(rows)
    for k, p, o in rows:
        three = sorted(q for m, q, w in rows if m == k and w == "3p")
        five = sorted(q for m, q, w in rows if m == k and w == "5p")
        i, j = bisect_left(three, p), bisect_right(five, p)
        assert got[k, p, o] == (i > 0 and p - three[i - 1] <= 9, j < len(five) and five[j] - p <= 9)


@pytest.mark.parametrize("positions", [[], [1], [1, 2], [1, 2, 3]])
def test_asof_is_strict(spark, positions):
    probe = spark.createDataFrame([("k", x) for x in range(6)], "k string, at int")
    build = spark.createDataFrame([("k", x, f"v{x}") for x in positions], "k string, pos int, v string")
    down = {r.at: r.pos for r in joins.asof(probe, build, ["k"], "at", "pos", ["v"]).collect()}
    up = {r.at: r.pos for r in joins.asof(probe, build, ["k"], "at", "pos", ["v"], "forward").collect()}
    for x in range(6):
        assert down[x] == max((p for p in positions if p < x), default=None)
        assert up[x] == min((p for p in positions if p > x), default=None)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_match_equals_sequential(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(30)})
    rows = [(a, b, rng.randrange(3)) for a, b in pairs]
    df = spark.createDataFrame([*rows, (None, 1, 0), (1, None, 0)], "a int, b int, w int").withColumn("_binrank", F.lit(1))
    order = [F.col("w"), F.col("a"), F.col("b")]
    got = {(r.a, r.b) for r in matching.greedy_match(df, ["a"], ["b"], order, rest=seed * 5).collect()}
    all_ = matching.greedy_match(df, ["a"], ["b"], order)
    assert all_.columns == df.columns and {(r.a, r.b) for r in all_.collect()} == got
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    assert got == want
    assert matching.greedy_match(df.limit(0), ["a"], ["b"], [F.col("w")]).collect() == []


def test_cascade_and_ties(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (1, 1, "c"), (2, 3, "d")], "k int, r int, v string").withColumn("_rank", F.lit(7)).withColumn("_most", F.lit(8))
    assert matching.cascade(df, ["k"], F.col("r")).columns == df.columns == matching.ties_at_max(df, ["k"], F.col("r")).columns
    assert sorted(r.v for r in matching.cascade(df, ["k"], F.col("r")).collect()) == ["b", "c", "d"]
    assert sorted(r.v for r in matching.ties_at_max(df, ["k"], F.col("r")).collect()) == ["a", "d"]


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cover(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(30)})
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    assert {r.node: r.component for r in graph.connected_components(df, nodes).collect()} == {x: find(x) for x in range(n)}
    rank = rng.sample(range(n), n)
    near = {x: set() for x in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for x in sorted(range(n), key=lambda x: rank[x]):
        reps = [y for y in near[x] if want.get(y) == y]
        want[x] = min(reps, key=lambda y: rank[y]) if reps else x
    ranked = spark.createDataFrame([(x, rank[x]) for x in range(n)], "node long, rank int")
    assert {r.node: r.rep for r in graph.greedy_cover(ranked, df).collect()} == want


def node_model(words, similarity, least):
    """The prefix tree written out: totals of every node from all words, clusters of leaves, a walk by depth."""
    nodes = {}
    for w, q, n in words:
        for d in range(1, len(w) + 1):
            node = nodes.setdefault(w[:d], [0, 0])
            node[0] += q[d - 1]
            node[1] += n
    leaves = [w for w in sorted({w for w, *_ in words}) if not any(v != w and v.startswith(w) for v, *_ in words)]
    groups = [{w} for w in leaves]
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(i):
                if any(consensus.prefix_similarity(a, b) >= similarity for a in groups[i] for b in groups[j]):
                    groups[j] |= groups.pop(i)
                    merged = True
                    break
            if merged:
                break
    out = []
    for own in groups:
        text, d = "", 1
        while True:
            here = {w[:d] for w in own if len(w) >= d}
            if not here or sum(nodes[x][1] for x in here) < least:
                break
            sums = {}
            for x in here:
                sums[x[-1]] = sums.get(x[-1], 0) + nodes[x][0]
            best = [c for c, s in sums.items() if s == max(sums.values())]
            text += best[0] if len(best) == 1 else "N"
            d += 1
        out.append((text, sum(n for w, _, n in words if any(x.startswith(w) for x in own))))
    return sorted(out)


def test_site_consensus_equals_node_model(spark):
    rng = random.Random(7)
    for _ in range(300):
        texts = {"".join(rng.choices("ACG", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 6))}
        words = [(w, [rng.randrange(1, 5) for _ in w], rng.randint(1, 3)) for w in texts]
        assert sorted(consensus.site_consensus(words, 0.75, 2)) == node_model(words, 0.75, 2)
    rows = [(1, "ACGT", [9, 9, 9, 9]), (1, "ACG", [1, 1, 1]), (1, "ACGA", [9, 9, 9, 9]), (2, "T", [3])]
    got = consensus.consensus_clusters(spark.createDataFrame(rows, "k int, word string, quals array<int>"), ["k"]).collect()
    assert {(r.k, r.consensus, r.n_reads) for r in got} == {(1, "ACGN", 3), (2, "", 1)}


def test_identity_clusters(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("ACGT", k=200))
    other = "".join(rng.choices("ACGT", k=200))
    near = list(base)
    for k in rng.sample(range(200), 10):
        near[k] = rng.choice("ACGT")
    half = list(base)
    for k in rng.sample(range(200), 100):
        half[k] = rng.choice("ACGT")
    rc = dedupe._revcomp("".join(near))
    rows = [(1, base + "A"), (2, "".join(near)), (3, rc), (4, "".join(half)), (5, base[:100]), (6, other), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "id int, seq string")
    got = {r.id: r.rep for r in dedupe.identity_clusters(df, "id", "seq").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    seqs = spark.createDataFrame([(1, "ACGG"), (2, "CCGT"), (3, "acgg"), (4, "TTTT")], "id int, seq string")
    assert sorted((r.first, r.copies) for r in dedupe.dedupe(seqs, "seq", F.col("id")).collect()) == [(1, 3), (4, 1)]


def greedy_brute(rows, p):
    reps, out = [], {}
    for i, s in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
        out[i] = next((r for r, t in reps if s and t and dedupe.same_cluster(t, s, p)), i)
        if out[i] == i:
            reps.append((i, s))
    return out


def test_identity_clusters_against_all_pairs(spark):
    """Families of near copies at many lengths: clusters as greedy over all pairs gives them, and the recall of candidates."""
    rng, p = random.Random(5), dedupe.Identity()
    rows = []
    for n in (30, 60, 90, 340, 400, 460, 700):
        for _ in range(4):
            base = "".join(rng.choices("ACGT", k=n))
            for _ in range(5):
                s = list(base)
                for k in rng.sample(range(n), int(n * rng.choice([0, 0.03, 0.06, 0.09]))):
                    s[k] = rng.choice("ACGT")
                s = "".join(s)[: n - rng.randrange(n // 12)]
                rows.append((len(rows), dedupe._revcomp(s) if rng.random() < 0.3 else s))
    got = {r.id: r.rep for r in dedupe.identity_clusters(spark.createDataFrame(rows, "id int, seq string"), "id", "seq", p).collect()}
    want = greedy_brute(rows, p)
    assert len(got) == len(rows) and sum(got[k] == want[k] for k in want) >= 0.97 * len(rows)


def test_candidates_of_short_sequences():
    """Pairs of 60 and 100 bases at the edit limit share a word."""
    rng, p = random.Random(6), dedupe.Identity()
    for n, least in ((60, 0.96), (100, 0.99), (300, 0.99)):
        shared = pairs = 0
        while pairs < 150:
            a = "".join(rng.choices("ACGT", k=n))
            b = list(a)
            for k in rng.sample(range(n), int(0.1 * n)):
                b[k] = rng.choice("ACGT".replace(b[k], ""))
            if dedupe.same_cluster(a, "".join(b), p):
                pairs += 1
                shared += len(np.intersect1d(dedupe.minimum_words(a, p), dedupe.minimum_words("".join(b), p))) > 0
        assert shared >= least * pairs, (n, shared)


def test_positional_consensus_prefers_the_reference(spark):
    bases = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "C", 5), (1, 1, "G", 5)], "k int, pos int, base string, q int")
    ref = spark.createDataFrame([(1, 0, "T"), (1, 1, "T"), (1, 2, "T")], "k int, pos int, base string")
    got = consensus.positional_consensus(bases, ["k"], "pos", "base", "q", ref)
    assert sorted((r.pos, r.base) for r in got.collect()) == [(0, "T"), (1, "C"), (2, "T")]
    assert consensus.ordered_concat(got, ["k"], "pos", "base", "s").first().s == "TCT"
