"""Quality-weighted consensus aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import edit_distance_within
from .unions import union_all

#: Places of a list that are aggregated in one row.
PIECE = 16


def unique_argmax(keyed: DataFrame, keys: list[str], value: str, weight: Column, out: str = "consensus", tie: str = "N") -> DataFrame:
    """For each key the value of the greatest summed weight, ``tie`` where several have it; with the number of rows as ``support``."""
    by = keyed.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    top = by.groupBy(*keys).agg(F.max(F.struct("_w", value)).alias("_hi"), F.sum("_n").alias("support"), F.collect_list("_w").alias("_all"))
    best = F.col("_hi._w")
    many = F.size(F.filter("_all", lambda w: w == best)) > 1
    return top.select(*keys, F.when(many, F.lit(tie)).otherwise(F.col(f"_hi.{value}")).alias(out), "support")


def merge_mates(bases: DataFrame, keys: list[str], base: str = "base", qual: str = "qual") -> DataFrame:
    """For each key the base of the highest quality, and that quality; equal qualities go to the first base in order."""
    best = bases.groupBy(*keys).agg(F.min(F.struct((-F.col(qual)).alias("q"), F.col(base).alias("b"))).alias("_best"))
    return best.select(*keys, F.col("_best.b").alias(base), (-F.col("_best.q")).alias(qual))


def positional_consensus(bases: DataFrame, keys: list[str], pos: str, base: str, weight: str, reference: DataFrame | None = None) -> DataFrame:
    """(keys, pos, base): the base of the greatest summed weight at each position.

    ``reference`` rows (keys, pos, base) weigh 1 and win ties; other ties go to the
    first base in order.
    """
    rows = bases.select(*keys, pos, F.col(base).alias("_b"), F.col(weight).cast("long").alias("_w"), F.lit(0).alias("_ref"))
    if reference is not None:
        rows = union_all([rows, reference.select(*keys, pos, F.col(base).alias("_b"), F.lit(1).cast("long").alias("_w"), F.lit(1).alias("_ref"))])
    by = rows.groupBy(*keys, pos, "_b").agg(F.sum("_w").alias("_w"), F.max("_ref").alias("_ref"))
    best = by.groupBy(*keys, pos).agg(F.min(F.struct((-F.col("_w")).alias("w"), (-F.col("_ref")).alias("r"), F.col("_b").alias("b"))).alias("_best"))
    return best.select(*keys, pos, F.col("_best.b").alias(base))


def ordered_concat(rows: DataFrame, keys: list[str], pos: str, value: str, out: str) -> DataFrame:
    """The values of each key joined in order of position.  Keys must bound their rows (a window, a flank)."""
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("_all"))
    return parts.select(*keys, F.array_join(F.transform("_all", lambda x: x["v"]), "").alias(out))


def prefix_similarity(a: str, b: str) -> float:
    """1 - edit distance / m over the first m characters of both, m the shorter length."""
    m = min(len(a), len(b))
    return 1 - edit_distance_within(a[:m], b[:m], m) / m if m else 0.0


def _alike(a: str, b: str, similarity: float) -> bool:
    """Whether ``prefix_similarity`` is at least so much; the distance is followed no further than that allows."""
    m = min(len(a), len(b))
    if not m:
        return similarity <= 0
    most = int((1 - similarity) * m + 1e-9)
    return edit_distance_within(a[:m], b[:m], most) <= most


def site_consensus(words: list[tuple[str, list[int], int]], similarity: float = 0.75, min_support: int = 2) -> list[tuple[str, int]]:
    """(consensus, reads) of each cluster of clipped words at one site and orientation.

    ``words`` holds (word, qualities, reads that have it).  Leaves are words that
    are no proper beginning of another.  Leaves of similar beginnings are one
    cluster.  At each depth, every read that reaches it and whose word up to there
    begins a leaf of the cluster counts: the character of the greatest summed
    quality stands, N on a tie, until fewer than ``min_support`` reads count.  A
    cluster's reads are those whose whole word begins one of its leaves.
    """
    texts = sorted({w for w, _, _ in words})
    leaves = [w for k, w in enumerate(texts) if not (k + 1 < len(texts) and texts[k + 1].startswith(w))]
    group = list(range(len(leaves)))

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(leaves)):
        for j in range(i):
            if root(i) != root(j) and _alike(leaves[i], leaves[j], similarity):
                group[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for r in sorted({root(k) for k in range(len(leaves))}):
        own = [w for k, w in enumerate(leaves) if root(k) == r]
        text, depth = "", 0
        begins = {w[:n] for w in own for n in range(1, len(w) + 1)}
        live = [(w, q, n) for w, q, n in words if w[:1] in begins]
        while live:
            live = [(w, q, n) for w, q, n in live if len(w) > depth and w[: depth + 1] in begins]
            if sum(n for *_, n in live) < min_support:
                break
            weight: dict[str, int] = {}
            for w, q, n in live:
                weight[w[depth]] = weight.get(w[depth], 0) + q[depth]
            most = max(weight.values())
            best = [c for c, x in weight.items() if x == most]
            text += best[0] if len(best) == 1 else "N"
            depth += 1
        out.append((text, sum(n for w, _, n in words if w in begins)))
    return out


def consensus_clusters(words: DataFrame, keys: list[str], similarity: float = 0.75, min_support: int = 2) -> DataFrame:
    """(keys, consensus, n_reads), one row for each cluster of a key's words.

    Input: keys, word, quals (array), one row for each read.  Reads with the same
    word are summed by Spark before a key's distinct words meet in one task, so a
    deep site costs its distinct words and not its reads.
    """
    sums = by_pieces(words, [*keys, "word"], F.size("quals"), lambda i: F.get("quals", i), F.sum)
    merged = sums.groupBy(*keys).agg(F.collect_list(F.struct("word", "_piece", "_values", "_n")).alias("_all"))
    names = [f.name for f in words.select(*keys).schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.select(*keys).schema) + ", consensus string, n_reads long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, reads = [], [], []
            for k, own in enumerate(batch.column(len(names))):
                rows: dict[str, list] = {}
                for x in sorted(own.as_py(), key=lambda x: (x["word"], x["_piece"])):
                    held = rows.setdefault(x["word"], [[], 0])
                    held[0], held[1] = held[0] + x["_values"], max(held[1], x["_n"])
                for text, n in site_consensus([(w, q, n) for w, (q, n) in rows.items()], similarity, min_support):
                    at.append(k)
                    texts.append(text)
                    reads.append(n)
            own = batch.select(list(range(len(names)))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string()), pa.array(reads, pa.int64())], names=[*names, "consensus", "n_reads"])

    return merged.mapInArrow(run, schema)


def by_pieces(rows: DataFrame, keys: list[str], length: Column, value: Callable[[Column], Column], total: Callable[[Column], Column], width: int = PIECE) -> DataFrame:
    """(keys, _piece, _values, _n): the values at each place of lists, aggregated over the rows of a key.

    A list is a row for every ``width`` of its places and not one for each, and rows
    of one key are combined before the shuffle.  ``_n`` counts the rows that reach the piece.
    """
    pieces = F.sequence(F.lit(0), F.ceil(length / width).cast("int") - 1)
    cut = rows.withColumn("_length", length).filter("_length > 0").withColumn("_piece", F.explode(pieces))
    at = lambda j: F.col("_piece") * width + j
    by = cut.groupBy(*keys, "_piece").agg(F.max("_length").alias("_length"), F.count("*").alias("_n"), *[total(value(at(j))).alias(f"_v{j}") for j in range(width)])
    values = F.slice(F.array(*[f"_v{j}" for j in range(width)]), F.lit(1), F.least(F.lit(width), F.col("_length") - F.col("_piece") * width))
    return by.select(*keys, "_piece", values.alias("_values"), "_n")
