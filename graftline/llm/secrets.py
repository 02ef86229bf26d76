"""Secret spans: fixed patterns, then character Markov models.

Two character Markov models are trained from labelled samples, one of random
strings (label 1) and one of ordinary identifiers (label 0).  A token whose mean
log-likelihood ratio of the two is over the threshold is a further span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import text as tx

KINDS = ("assign", "access", "hex", "markov")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Characters of a token; any other is read as the last class.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CLASS = np.full(256, len(ALPHABET), np.int64)
for _k, _c in enumerate(ALPHABET):
    _CLASS[ord(_c)] = _k


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio of a transition, random strings against identifiers."""

    ratio: np.ndarray
    #: Mean ratio for each character (nats) from which a token is a span.
    threshold: float = 0.5

    def score(self, token: str) -> float:
        c = _CLASS[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
        before = np.concatenate([[self.ratio.shape[0] - 1], c[:-1]])
        return float(self.ratio[before, c].mean())


def fit(samples: list[tuple[str, int]], threshold: float = 0.5, smoothing: float = 0.5) -> Markov:
    """First-order models with additive smoothing from (token, label) samples."""
    n = len(ALPHABET) + 2  # the other characters, the start
    counts = np.full((2, n, n), smoothing)
    for token, label in samples:
        c = _CLASS[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
        np.add.at(counts[label], (np.concatenate([[n - 1], c[:-1]]), c), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return Markov(logs[1] - logs[0], threshold)


def labelled_samples(words: list[str], n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Random strings over the usual alphabets (1), and identifiers composed of ``words`` (0)."""
    rng = random.Random(seed)
    alphabets = [ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64], "0123456789abcdef"]
    words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["name", "value", "index", "count", "table", "column"]
    out = [("".join(rng.choices(a, k=rng.randint(16, 64))), 1) for a in rng.choices(alphabets, k=n)]
    for _ in range(n):
        own = rng.choices(words, k=rng.randint(1, 5))
        style = rng.randrange(5)
        if style == 0:
            name = "_".join(own).lower()
        elif style == 1:
            name = "".join(w.capitalize() for w in own)
        elif style == 2:
            name = "-".join(own)
        elif style == 3:
            name = "_".join(own).upper()
        else:
            name = "/".join(own).lower() + str(rng.randrange(1000))
        out.append((name, 0))
    return out


def training_words(texts: DataFrame, text_col: str = "text", most: int = 20_000) -> list[str]:
    """At most ``most`` distinct words of a labelled clean table, first in order of their hash."""
    word = F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z]+")).alias("word")
    rows = texts.select(word).filter(F.length("word").between(2, 24)).distinct().orderBy(F.xxhash64("word"), "word").limit(most)
    return [r["word"] for r in rows.collect()]


def spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """The base spans and, outside them, the model's, by start, then kind."""
    base = base_spans(text)
    more = []
    for m in _TOKEN.finditer(text):
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        if model.score(m[0]) > model.threshold:
            more.append((m.start(), 3, m.end()))
    return sorted(base + more) if more else base


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())]))


def scan(docs: DataFrame, model: Markov, text_col: str = "text", out_col: str = "secret_spans", redacted_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of each whole text, and with the text without them if ``redacted_col`` is named.

    Null and empty texts have no spans; a null text stays null.  Overlapping spans
    are redacted as one.  Columns of the names used are replaced, all others stay.
    """
    names = [c for c in docs.columns if c not in (out_col, redacted_col)]
    schema = [f for f in docs.schema.fields if f.name in names]
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    rows_in = tx.bounded(docs).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, 512):
            texts = batch.column(len(names)).to_pylist()
            found = [spans(t, model) if t else [] for t in texts]
            columns = [batch.column(k) for k in range(len(names))] + [pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in s] for s in found], kinds)]
            if redacted_col:
                columns.append(pa.array([redact(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    fields = [StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)] + [StructField(f"c{len(names)}", SPANS)]
    if redacted_col:
        fields.append(StructField(f"c{len(names) + 1}", StringType()))
    return rows_in.mapInArrow(run, StructType(fields)).toDF(*names, out_col, *([redacted_col] if redacted_col else []))


def redact(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    out, last = [], 0
    for a, _, b in found:
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join(out) + text[last:]
