import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from graftline.llm import huffman, length_histogram, packing, tokens
from graftline.llm.tokens import PieceEncoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a \nb", "it's o'clock", "\ta b", "naïve Ünïcode ß", "x y z", "é ́ a", "<|endoftext|> b", "12 345", "a b c", "ᲀ \x1c b", "ǅ İ ΑΣ Σ", "!!! ???", "\n", "\r\n x", "日本 語", "b ᠎ c"]


def direct(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def encode(enc, texts):
    """The ids of each text, over all chunks of the column."""
    out = []
    for a, b, ids, at in enc.encode(pa.array(texts, pa.string())):
        assert len(at) == b - a + 1 and a == len(out)
        out += [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("special", [True, False])
def test_pieces_equal_whole_texts(path, special, monkeypatch):
    rng = random.Random(3)
    alphabet = ["a", "Be", "'s", " ", " ", "\n", "1", "é", ".", "　", "\t", "word", "́", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(400)]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(path, special=special, pieces=20)
    assert encode(enc, texts) == want and encode(enc, [None, *texts][1:]) == want and encode(enc, []) == []
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 100)
    assert encode(PieceEncoder(path, short=True, special=special), texts) == want and encode(enc, [None, "a"]) == [[], direct(path, "a")]


def rows():
    rng = random.Random(8)
    vocab = ["alpha", "be", "gamma", "Δelta", "é", "of", "the", "tree."]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(60)]
    return [(100 - i, t) for i, t in enumerate(texts)] + [(3, None), (3, None), (4, ""), (5, "of the " * 9000), (None, "x"), (100, texts[0])]


def docs(spark):
    return spark.createDataFrame([(a, b, 7, 8) for a, b in rows()], "doc_id long, text string, start int, ids int").repartition(3)


def test_histogram(spark):
    want = sorted(len(direct(BYTE, t or "")) + 1 for _, t in rows())
    hist = length_histogram.histogram(tokens.token_counts(docs(spark), BYTE)).collect()
    assert [r.n_tokens for r in sorted(hist)] == sorted(set(want))
    for r in hist:
        n = r.n_tokens
        assert r.docs == want.count(n) and r.tokens == n * r.docs
        assert r.docs_at_least == sum(x >= n for x in want) and r.docs_up_to == sum(x <= n for x in want)
        assert r.tokens_at_least == sum(x for x in want if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in want) and r.cut_tokens == sum(want) - r.truncated_total
    df = length_histogram.histogram(tokens.token_counts(docs(spark), BYTE))
    for r in length_histogram.truncated_totals(df, [1, 7, 100, 2048, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in want) and r.docs_cut == sum(x > r.context_limit for x in want)
    for r in length_histogram.quantiles(df, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == want[-(-int(round(r.share * len(want) * 1000)) // 1000) - 1]


def check_packing(pieces, want, length):
    by_doc, by_seq = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = sorted((d is None, d or 0, sum(len(x) for _, x in p)) for (d, _), p in by_doc.items())
    assert sum(g[2] for g in got) == sum(len(x) for _, x in want)
    pad = 0
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
    return by_doc, pad


def test_packing(spark):
    want = [(d, direct(BYTE, t or "") + [1]) for d, t in rows()]
    p = packing.Packing(length=256, window=4)
    by_doc, pad = check_packing(packing.pack(docs(spark), BYTE, p).collect(), want, 256)
    assert pad == 0
    for d, ids in want:
        if d not in (3, 100):
            assert sum((x for _, x in sorted(by_doc[d, len(ids)])), []) == ids
    empty = packing.pack(docs(spark).limit(0), BYTE)
    assert empty.collect() == []


def test_tails_of_tasks_are_packed_together(spark):
    """However many tasks there are, all but the last few sequences are whole."""
    want = [(d, direct(BYTE, t or "") + [1]) for d, t in rows()]
    p = packing.Packing(length=256, window=400)
    pieces = packing.pack(docs(spark).repartition(40), BYTE, p).collect()
    check_packing(pieces, want, 256)
    size = {}
    for r in pieces:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    short = [n for n in size.values() if n < 256]
    assert len(size) > 100 and len(short) <= 8 and len(set(short)) == len(short)


def test_packer_is_linear_in_a_text():
    packer = packing.Packer(packing.Packing())
    packer.add(1, np.arange(3_000_001, dtype="<u4"))
    packer.finish()
    assert b"".join(r[3] for r in packer.out) == np.arange(3_000_001, dtype="<u4").tobytes()


def test_packer_balances_cost():
    rng = random.Random(1)
    packer = packing.Packer(packing.Packing(length=2048, window=64))
    for d in range(500):
        packer.add(d, np.full(rng.choice([20, 200, 700, 1500]), d, "<u4"))
    packer.finish()
    assert sum(r[2] for r in packer.out) == sum(len(np.frombuffer(r[3], "<u4")) for r in packer.out)
    whole = {}
    for r in packer.out:
        whole[r[0]] = whole.get(r[0], 0) + 1
    assert sum(n > 1 for n in whole.values()) < 0.2 * len(whole)


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(4)
    import heapq

    for n in (1, 2, 3, 7, 60):
        counts = np.array([rng.choice([0, 1, 2, 5, 100, 3000]) for _ in range(n)] + [1])
        lengths = huffman.code_lengths(counts)
        used = lengths[counts > 0].astype(float)
        assert (lengths[counts == 0] == 0).all() and (2.0**-used).sum() <= 1
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0 if len(heap) > 1 else heap[0]
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((counts * lengths).sum()) == cost
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(np.array(fib))
    assert lengths.max() == 16 and (2.0 ** -lengths.astype(float)).sum() == 1


@pytest.mark.parametrize("sizes", [[], [0], [1], [2, 0, 127], [128], [129, 1, 1], [1000, 256, 3], [4096, 5]])
def test_blocks(sizes, monkeypatch):
    n = sum(sizes)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1000))
    code = huffman.Code(lengths)
    blocks = [huffman.encode_block(ids, np.array(sizes, np.int64), code.words(), lengths, 128)]
    monkeypatch.setattr(huffman, "RUN_IDS", 256)
    blocks.append(huffman.encode_block(ids, np.array(sizes, np.int64), code.words(), lengths, 128))
    for block in blocks:
        for lanes in (1, 3, 8192):
            assert huffman.decode_block(block, sizes, *code.tables(), lanes_at_once=lanes).tolist() == ids.tolist()


def test_files_are_in_order_of_ids(spark, tmp_path):
    """Files by name, blocks by number: documents in ascending order, over many parts, one of a shared id among them."""
    many = docs(spark).unionByName(spark.createDataFrame([(50, f"of the tree {k}", 0, 0) for k in range(400)], "doc_id long, text string, start int, ids int"))
    huffman.write_ids(many, f"file://{tmp_path}/x", WORD, block_ids=300, part_ids=2000)
    seen, parts = [], []
    for f in sorted((tmp_path / "x" / "blocks").glob("part-*.parquet")):
        rows_of = pq.read_table(f).to_pylist()
        assert [r["block"] for r in rows_of] == list(range(len(rows_of))) and len({r["part"] for r in rows_of}) <= 1
        seen += [d for r in rows_of for d in r["doc_ids"]]
        parts += [r["part"] for r in rows_of]
    order = [(d is not None, d or 0) for d in seen]
    assert order == sorted(order) and len(order) == len(rows()) + 400
    shared = {p for p, r in zip(parts, spark.read.parquet(f"file://{tmp_path}/x/blocks").orderBy("part", "block").collect(), strict=True) if 50 in r.doc_ids}
    assert len(set(parts)) > 8 and parts == sorted(parts) and len(shared) > 1


def test_huffman_files(spark):
    want = [(d, np.array(direct(WORD, t or "") + [1], "<u4").tobytes()) for d, t in rows()]
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    got = [(r.start, r.doc_id, r.ids) for r in huffman.round_trip(docs(spark), WORD, block_ids=500, part_ids=4000).collect()]
    got.sort(key=lambda r: r[0])
    at = 0
    for (start, d, ids), (e, x) in zip(got, want, strict=True):
        assert (start, d, zlib.crc32(bytes(ids))) == (at, e, zlib.crc32(x))
        at += len(x) // 4
    short = huffman.round_trip(docs(spark), WORD, digest=True).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in short) == sorted((a, len(x) // 4, zlib.crc32(bytes(x))) for a, _, x in got)
    assert huffman.round_trip(docs(spark).limit(0), WORD).collect() == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_strings_of_added_tokens(spark, path):
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|startoftext|>of the<|endoftext|>\n", "<|ENDOFTEXT|> a", "<| endoftext|>", "a <b |> c", "plain words"]
    t = Tokenizer.from_file(path)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert encode(tokens.encoder(path), texts) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, tokens.token_counts(docs, path).collect())) == {k: len(x) + 1 for k, x in enumerate(want)}
