import hashlib
import random
from collections import defaultdict

import pytest
from graftline.llm import exact_dedup as x
from graftline.llm import queries
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"


def brute(rows, largest):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    pick = max if largest else min
    best = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def strings(seed, n):
    rng = random.Random(seed)
    base = [b"".join(rng.choice([b"ab", b"a", b"b", b"abc" * 9]) for _ in range(rng.randint(0, 12))) for _ in range(n // 3)]
    return [rng.choice(base) for _ in range(n)]


@pytest.mark.parametrize("limit", [None, 2_000, 20_000])
@pytest.mark.parametrize("largest", [False, True])
def test_trie_equals_dictionary(limit, largest):
    for seed in range(8):
        keys = strings(seed, 400)
        trie = x.PatriciaTrie(largest, limit)
        want: dict[bytes, list[int]] = defaultdict(list)
        for i, key in enumerate(keys):
            trie.insert(key, i, 1, [i])
            want[key].append(i)
            if limit:
                assert trie.held <= limit or trie.strings == 1
        assert (trie.spilled > 0) == (limit == 2_000 or (limit == 20_000 and trie.spilled > 0))
        got = {k: (t.best, t.rows, sorted(t.marks)) for k, t in trie.terminals()}
        assert got == {k: ((max if largest else min)(v), len(v), v) for k, v in want.items()}


def test_a_prefix_is_a_string_of_its_own():
    trie = x.PatriciaTrie()
    for i, key in enumerate([b"abc", b"ab", b"", b"abd", b"ab", b"\x00", b""]):
        trie.insert(key, i)
    assert {k: (t.best, t.rows) for k, t in trie.terminals()} == {b"": (2, 2), b"ab": (1, 2), b"abc": (0, 1), b"abd": (3, 1), b"\x00": (5, 1)}


def test_a_single_giant_string_is_not_spilled():
    trie = x.PatriciaTrie(limit=1000)
    for i in range(3):
        trie.insert(b"x" * 50_000, i)
    assert [(len(k), t.best, t.rows) for k, t in trie.terminals()] == [(50_000, 0, 3)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("sizes", [(x.LOCAL_BYTES, x.OWNER_BYTES), (3_000, 4_000)])
def test_equals_brute_force(spark, keep, sizes):
    rng = random.Random(5)
    texts = [f"text {k} " + "word " * rng.randint(0, 200) for k in range(60)] + ["", None, "ä", "a\u0000b", "x" * 200_000]
    rows = [(k, rng.choice(texts) if k % 3 else texts[7]) for k in range(900)]
    rows += [(None, texts[3]), (None, "only without"), (None, "only without"), (5, rows[5][1]), (5, "another text of 5")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, mark="clash", digest=1, best=None) for i, t in rows], "doc_id long, text string, mark string, digest int, best string").repartition(5)
    found = x.exact_duplicates(df, keep, local_bytes=sizes[0], owner_bytes=sizes[1]).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in found), key=str) == brute(rows, keep == "largest")


def test_empty_table(spark):
    assert x.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_without_copies_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", "w")], "doc_id long, text string, lang string")
    assert sorted(r.lang for r in x.without_copies(df).collect()) == ["x", "z"]
    assert sorted(r.lang for r in x.without_copies(df, "largest").collect()) == ["w", "y"]


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op11_exact_dedup(spark, SF)
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows, True)
