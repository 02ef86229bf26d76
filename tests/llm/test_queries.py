"""The registered queries over the smallest tables, against independent versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from graftline.llm import secrets
from graftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def documents(sf=SF):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


DOCS = documents()


def run(spark, name, sf=SF):
    df = QUERIES[name](spark, sf)
    return df.columns, df.collect()


def ids_of(tokenizer):
    t = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    return {d: [*e.ids, 1] for d, e in zip(DOCS, t.encode_batch(list(DOCS.values()), add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(text):
    """Bytes with A-Z in lower case and each white space as a blank."""
    return bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in text.encode())


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_op2(spark):
    """Every document with a verbatim excerpt of 103 bytes is found, and what is reported lies within the edits."""
    _, rows = run(spark, "op2_decontamination")
    items = {r["item_id"]: plain(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"]}
    excerpts = {t[a : a + 103] for t in items.values() for a in range(max(1, len(t) - 102))}
    must = set()
    for d, t in DOCS.items():
        low = plain(t)
        if any(low[a : a + 103] in excerpts for a in range(len(low))) or any(len(x) < 103 and x in low for x in items.values()):
            must.add(d)
    assert must and must <= {r.doc_id for r in rows}
    for r in rows[:60]:
        body, item = plain(DOCS[r.doc_id][max(0, r.start - 8) : r.end + 8]), items[r.item_id]
        n = min(96, len(item))
        if n >= 40:
            grid = sorted({*range(0, len(item) - n + 1, 8), len(item) - n})
            assert any(edits(item[a : a + n], body) <= n * 0.08 for a in grid)


def test_op3(spark):
    columns, rows = run(spark, "op3_hmm_score")
    assert columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    words = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())), None] for d, t in DOCS.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(words)
    for r in rows:
        own = words[r.doc_id]
        assert tuple(r)[:5] == (r.doc_id, held[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op4(spark):
    _, rows = run(spark, "op4_token_counts")
    want = Counter(map(len, ids_of("byte_bpe_50k.json").values()))
    assert {r.n_tokens: r.docs for r in rows} == want
    total = sum(n * c for n, c in want.items())
    assert all(r.truncated_total + r.cut_tokens == total for r in rows)


def test_op5(spark):
    columns, rows = run(spark, "op5_packing")
    assert columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want, seen, sequences = ids_of("byte_bpe_50k.json"), {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, ids in want.items():
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in own) < 2048 for own in sequences.values()) <= 11


def test_op7(spark):
    columns, rows = run(spark, "op7_audio_features")
    assert columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    by_text = {}
    for r in rows:
        raw = DOCS[r.doc_id].encode()
        body = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert tuple(r)[1:5] == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])) and r.media_bytes == len(body) + 44
        assert by_text.setdefault(raw, r.feature) == r.feature and r.feature.count(",") == 31


def test_op9(spark):
    columns, rows = run(spark, "op9_huffman_ids")
    assert columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    at, got = 0, {r.doc_id: tuple(r)[1:4] for r in rows}
    for d, ids in sorted(ids_of("word_bpe_49k.json").items()):
        assert got.pop(d) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_by_hand(t):
    """The three kinds by scanning character by character."""
    out, i = [], 0
    while i < len(t):  # an assignment
        name = next((n for n in NAMES if all(c.isascii() for c in t[i : i + len(n)]) and t[i : i + len(n)].lower() == n), None)
        j = i + len(name or "")
        if name:
            j += t[j : j + 1] in ("'", '"') and t[j : j + 1] != ""
            while t[j : j + 1] == " ":
                j += 1
            if t[j : j + 1] in (":", "=") and t[j : j + 1]:
                j += 1
                while t[j : j + 1] == " ":
                    j += 1
                j += t[j : j + 1] in ("'", '"') and t[j : j + 1] != ""
                k = j
                while k < len(t) and t[k] in VALUE:
                    k += 1
                if k > j:
                    if k - j >= 8:
                        out.append((i, 0, k))
                    i = k
                    continue
        i += 1
    i = 0
    while i < len(t):  # an access key
        k = i + 4
        while t.startswith("AKIA", i) and k < len(t) and (t[k].isascii() and (t[k].isdigit() or t[k].isupper())):
            k += 1
        if t.startswith("AKIA", i) and k > i + 4:
            if k - i >= 16:
                out.append((i, 1, k))
            i = k
        else:
            i += 1
    i = 0
    while i < len(t):  # hexadecimal digits
        k = i
        while k < len(t) and t[k] in "0123456789abcdef":
            k += 1
        if k - i >= 32:
            out.append((i, 2, k))
        i = max(k, i + 1)
    return sorted(out)


def test_base_spans_by_hand():
    import random

    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apiKey", "api__key", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "AKI", "ABCDEF0123", "0123456789abcdef", "deadbeef", "Zz9+/_.=-", "é", "ſ", "K", "\n", "\t", "abcdefgh", "token=abcdefgh", "٣"]
    for _ in range(6000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert secrets.base_spans(t) == base_by_hand(t), t


def test_op10(spark):
    """Over the next larger tables, since the smallest hold no base span."""
    sf = "/root/testdata/sf0.01"
    docs = documents(sf)
    columns, rows = run(spark, "op10_secret_scan", sf)
    assert columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds, found = secrets.KINDS, 0
    for r in rows:
        base = base_by_hand(docs[r.doc_id])
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("markov")] == (text.split(",") if text else [])
        places = [(int(s.split(":")[1]), kinds.index(s.split(":")[0])) for s in spans]
        assert places == sorted(places) and len(places) == len(base) + r.n_markov
        found += len(base)
    assert len(rows) == len(docs) and found
