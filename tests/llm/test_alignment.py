import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from graftline.llm import alignment, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", "a", " ", "  ", "\n", " \n", "\n\n a", "a ", " a", "a  b", "tab\tand blank", "x\r\ny", "don't 's", "'s", "<|endoftext|> mid <|endoftext|>", "<s> </s> <unk> <0x41>", "▁", "a▁b", "日本語 テキスト", "😀😀 ok", "é", "a\u0000b", "ß" * 50, "1234567890 12", "   three   spaces   ", "word\nword\n", "!?...,;:"]


def brute(rows):
    """Links, groups and counts by the libraries' whole-text encoding and byte ranges."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for i, c in alignment.tk._LETTERS.items()}
    bytes_a = {i: bytes(back[c] for c in e) for e, i in a.get_vocab().items() if all(c in back for c in e)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], Counter()
    for doc, text in rows:
        want = (" " + text).encode() if text else b""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or b"".join(map(bytes_a.get, x)) != want or b"".join(map(piece, y)) != want:
            found.append((doc, 0, 0, 0, Counter(), ""))
            continue
        ends_x, ends_y, at = [], [], 0
        for i in x:
            at += len(bytes_a[i])
            ends_x.append(at)
        at = 0
        for i in y:
            at += len(piece(i))
            ends_y.append(at)
        links, groups, i, j, own = Counter(), [], 0, 0, ([], [])
        while i < len(x):
            links[x[i], y[j]] += 1
            own = (own[0] if own[0][-1:] == [i] else own[0] + [i], own[1] if own[1][-1:] == [j] else own[1] + [j])
            if ends_x[i] == ends_y[j]:
                groups.append(",".join(str(x[k]) for k in own[0]) + "|" + ",".join(str(y[k]) for k in own[1]))
                own, i, j = ([], []), i + 1, j + 1
            elif ends_x[i] < ends_y[j]:
                i += 1
            else:
                j += 1
        held.update(links.keys())
        found.append((doc, len(x), len(y), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for doc, n_a, n_b, n_groups, links, groups in found:
        best = sum(k for p, k in links.items() if held[p] == most[p[0]])
        out.append((doc, n_a, n_b, n_groups, sum(links.values()), best, sum(k * held[p] for p, k in links.items()), groups))
    return out, held


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def mixed(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Überfall", "naïve", "qzxv", "token", "12", "don't", "-", "日本", "\n", "a.b"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_sides_equal_whole_texts():
    a, b = alignment.Side(A), alignment.Side(B)
    whole_a, whole_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole_a.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + mixed(200) + ["".join(rng.choice("ab \n\t'é▁.1") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for side, whole in ((a, lambda t: whole_a.encode(" " + t, add_special_tokens=False).ids), (b, whole_b.encode)):
        ids, at = side.ids(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == (whole(t) if t else []), repr(t)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, small):
    bounds = alignment.Bounds(300, 7, 50, 20) if small else alignment.Bounds()
    texts = [*ODD, None, *mixed(150), *["the hot text of all"] * 80, "long " * 3000]
    rows = list(enumerate(texts)) + [(5, "repeated id"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, a int, chunk string").repartition(6)
    want, held = brute(rows)
    assert in_order(alignment.align(df, A, B, bounds=bounds).collect()) == in_order(want)
    hashed = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want]
    assert in_order(alignment.align(df, A, B, digest=True, bounds=bounds).collect()) == in_order(hashed)
    assert {(r.a, r.b): r.documents for r in alignment.pair_counts(df, A, B, bounds=bounds).collect()} == held


def test_pair_counts_settle():
    """Sums that settle often equal sums held at once."""
    counts, want = alignment._PairCounts(3), Counter()
    rng = random.Random(2)
    for _ in range(50):
        keys = sorted({(rng.randint(0, 5) << 32) | rng.randint(0, 5) for _ in range(4)})
        counts.add(alignment.np.array(keys), alignment.np.arange(1, len(keys) + 1))
        want.update({k: i + 1 for i, k in enumerate(keys)})
    got = {}
    for ids, b, n in counts.batches():
        (other, sizes), (values, _) = alignment._unpacked(b, "<u4"), alignment._unpacked(n, "<i8")
        got |= {(int(i) << 32) | int(o): int(v) for i, o, v in zip(alignment.np.repeat(ids, sizes), other, values, strict=True)}
    assert got == want


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)[0]]
    assert in_order(got.collect()) == in_order(want)
