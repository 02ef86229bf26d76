import random

from graftline.llm import decontam
from graftline.llm.decontam import Decontam, leaks, without_leaks


def semi_global(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edit(t, n, rng):
    t = list(t)
    for _ in range(n):
        k = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[k] = rng.choice("abcdef ")
        elif kind == 1:
            t.insert(k, rng.choice("abcdef "))
        else:
            del t[k]
    return "".join(t)


def test_against_brute_force(spark):
    rng = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice([8, 14, 25, 50]))) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (53, "The  SAME text.\n" * 4)]
    docs = []
    for i in range(90):
        t = prose(rng.choice([0, 5, 60, 200]))
        if i % 3:
            inner = edit(items[i % 12][1], rng.choice([0, 1, 3, 6, 9, 14, 30]), rng)
            k = rng.randrange(len(t) + 1)
            t = t[:k] + (inner.upper() if i % 7 == 0 else inner) + t[k:]
        docs.append((i, t))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "the  same TEXT. " * 4), (103, "x" * 200_000 + items[2][1]), (103, "x")]
    p = Decontam(window=64, stride=32, q=5, edit_share=0.08, least_chars=20)
    index = decontam.Index.build([(i, t) for i, t in items if t], p)
    want = set()
    for d, t in docs:
        body = decontam._BLANK[list((t or "").encode())].tolist() if t else []
        for item, w in zip(index.item.tolist(), index.text, strict=True):
            if d != 103 and body and semi_global(w.tolist(), body) <= p.edits(len(w)):
                want.add((d, item))
    want.add((103, 2))
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, item_id int, edits int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(df, bench, p).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    small = leaks(df, bench, Decontam(window=64, stride=32, q=5, edit_share=0.08, least_chars=20, block_chars=300)).collect()
    assert {(r.doc_id, r.item_id) for r in small} == want
    exact = next(r for r in got if r.doc_id is None and r.item_id == 3)
    assert exact.edits == 0 and exact.start <= 2 * p.edits(64) and exact.end >= len(items[3][1]) - 2 * p.edits(64)
    assert leaks(df.limit(0), bench, p).collect() == [] and leaks(df, bench.limit(0), p).collect() == []


def test_band_edges():
    rng = random.Random(2)
    for _ in range(200):
        w = rng.choices(range(4), k=30)
        t = rng.choices(range(4), k=12) + w[: rng.randrange(31)] + rng.choices(range(4), k=9)
        text = decontam._cut(decontam.np.array(t), -8, len(t), 0, len(t))
        got = decontam._align([decontam.np.array(w)], [text], len(text))
        assert min(got[0], 9) == min(semi_global(w, t), 9)


def test_excerpts_wherever_they_begin(spark):
    """Every verbatim excerpt of window + stride - 1 = 103 bytes is found."""
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n))
    item, p = prose(233), Decontam()
    size = p.window + p.stride - 1
    assert size == 103
    docs = [(a, prose(150) + item[a : a + size] + prose(150)) for a in range(len(item) - size + 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item), (2, prose(400))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == {(a, 1) for a, _ in docs}


def test_short_and_nameless_items(spark):
    long = "the quick brown fox jumps over the lazy dog while nine wizards box"
    items = [(1, "How far is Mars?"), (2, " x=7\n"), (3, "cat"), (4, "cat"), (5, " \n"), (6, "né"), (None, long), (None, "zebra crossing")]
    docs = [(1, "Q: how far\tis MARS?No"), (2, "how far is marsh?"), (3, "cats, bobcat, né9"), (4, "a cat."), (5, "x=7"), (6, "cat"), (7, long.upper()), (8, "a Zebra crossing"), (9, "zebra"), (10, None), (11, "n"), (12, "ééé cat né")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (4, 3), (5, 2), (6, 3), (7, None), (8, None), (12, 3), (12, 6)}
    for p in (Decontam(), Decontam(block_chars=20)):
        got = leaks(df, bench, p).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.item_id != 4} == want
        assert p.block_chars == 20 or ({r.items for r in got if r.item_id == 3} == {2} and 4 not in {r.item_id for r in got})
        place = next(r for r in got if (r.doc_id, r.item_id) == (12, 6))
        assert (place.start, place.end, place.edits) == (8, 10, 0)
        assert {r.doc_id for r in without_leaks(df, bench, p).collect()} == {2, 3, 9, 10, 11}


def test_a_common_preamble_gives_one_row(spark):
    """What all benchmark texts begin with is found once a document; what is their own is found for each."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n))
    preamble = prose(240)
    items = [(i, preamble + prose(200)) for i in range(60)]
    docs = [(d, prose(100) + preamble + prose(100)) for d in range(20)] + [(100 + i, prose(50) + items[i][1][240:] + prose(50)) for i in range(60)] + [(500, prose(900))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.items) for r in got if r.doc_id < 100) == [(d, 0, 60) for d in range(20)]
    assert {(r.doc_id, r.item_id, r.items) for r in got if r.doc_id >= 100} == {(100 + i, i, 1) for i in range(60)}


def test_links_of_like_items_are_all_named(spark):
    """Two benchmark texts that differ in two characters, a third that shares the first half: a document of one names all it holds."""
    rng = random.Random(31)
    prose = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n))
    a = prose(260)
    b = a[:100] + "QQ".lower() + a[102:]
    items = {1: a, 2: b, 3: a[:130] + prose(130), 4: prose(260)}
    docs = [(10, prose(50) + a + prose(50)), (11, prose(50) + b), (12, a[130:] + prose(40)), (13, prose(300)), (14, prose(20) + items[3])]
    df, names = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), "item_id long, text string"
    links = {(r.doc_id, i) for r in leaks(df, spark.createDataFrame(list(items.items()), names)).collect() for i in (r.item_id, *r.also)}
    alone = {(r.doc_id, i) for i, t in items.items() for r in leaks(df, spark.createDataFrame([(i, t)], names)).collect()}
    assert links == alone and {(10, 1), (10, 2), (10, 3), (11, 1), (12, 2), (14, 1)} <= links


def test_recall_of_passages(spark):
    """Edited passages of benchmark texts, against semi-global edit distance over all their windows."""
    rng, p = random.Random(12), Decontam()
    prose = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n))
    items, docs, near = [(i, prose(300)) for i in range(6)], [], set()
    for d in range(120):
        a, n = rng.randrange(150), rng.randrange(100, 150)
        piece = edit(items[d % 6][1][a : a + n], rng.choice([0, 2, 4, 6, 9]), rng)
        docs.append((d, prose(80) + piece + prose(80)))
        if any(semi_global(items[d % 6][1][k : k + 96], piece) <= p.edits(96) for k in range(max(0, a - 8), min(205, a + n))):
            near.add(d)
    found = {r.doc_id for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= near and len(found) >= 0.9 * len(near) and len(near) > 60
