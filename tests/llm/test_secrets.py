import hashlib
import io
import random
import re

from graftline.llm import secrets

#: English-like words: the interpreter's own notices, one half to train on and one to hold out.
WORDS = sorted({w.lower() for w in re.findall("[A-Za-z]{3,}", " ".join(f.__doc__ or "" for f in (str, dict, re, random, hashlib, random.Random, re.sub, hashlib.sha256, str.split, int, property, print, sorted, open, io)))})
MODEL = secrets.fit(secrets.labelled_samples(WORDS[::2]))


def test_base_spans():
    t = 'é password: "abcdefgh1" TOKEN=short token=token =abcdefgh AKIAABCDEFGHIJKL AKIAABC ' + "0f" * 16 + " " + "0f" * 15 + "0 Api_Key:='zzzzzzzz'"
    got = [(secrets.KINDS[k], t[a:b]) for a, k, b in secrets.base_spans(t)]
    assert got == [("assign", 'password: "abcdefgh1'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0f" * 16)]
    assert secrets.base_spans("ſecret=abcdefghi") == []  # only ASCII letters have two cases


def test_held_out_accuracy():
    held = [(t, y) for t, y in secrets.labelled_samples(WORDS[1::2], n=1000, seed=77) if len(t) >= 16]
    caught = sum(MODEL.score(t) > MODEL.threshold for t, y in held if y)
    wrong = sum(MODEL.score(t) > MODEL.threshold for t, y in held if not y)
    assert caught > 0.7 * sum(y for _, y in held) and wrong < 0.02 * sum(1 - y for _, y in held)


def test_scan(spark):
    rng = random.Random(5)
    odd = "".join(rng.choices(secrets.ALPHABET[:62], k=40))
    key = "secret=" + "q" * 9
    rows = [(1, f"key {odd} and some_ordinary_identifier_name {key}", 0), (2, None, 0), (3, "", 0), (4, "x " * 60000 + key, 0), (None, key, 0), (4, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secret_spans int")
    got = sorted(secrets.scan(docs, MODEL, redacted_col="text2").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, -len(r.text or "")))
    assert [(s.kind, got[0].text[s.start : s.end]) for s in got[0].secret_spans] == [("markov", odd), ("assign", key)]
    assert got[0].text2 == "key [SECRET] and some_ordinary_identifier_name [SECRET]"
    assert [(len(r.secret_spans), r.text2) for r in got[1:3]] == [(0, None), (0, "")]
    assert got[3].secret_spans[0].start == 120000 and got[4].secret_spans == [] and got[5].text2 == "[SECRET]"
    assert secrets.scan(docs.limit(0), MODEL).collect() == []


def test_overlaps_redact_once():
    t = "token=" + "0f" * 20
    assert secrets.redact(t, secrets.base_spans(t), "#") == "#"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
