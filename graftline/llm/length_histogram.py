"""Exact histogram of encoded lengths with suffix sums.

For each length L that occurs, the histogram holds the documents of that length
and, from suffix sums, what a context limit of L keeps: documents longer than L,
tokens left after cutting every document at L, and tokens cut.  Any other limit is
answered from its neighbouring row, so totals, quantiles and truncated totals are
exact for every limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stash import stash

#: Lengths in one coarse bin; within a bin and over bins the sums run apart.
BIN = 1024


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs, tokens, docs_at_least, tokens_at_least, truncated_total, cut_tokens, docs_up_to).

    docs_at_least and tokens_at_least count documents of this length or more;
    truncated_total is the corpus size with every document cut at this length.
    Null lengths are left out.  An empty table gives an empty result.
    """
    by = lengths.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("n_tokens")).agg(F.count("*").alias("docs"))
    by = stash(by, "lengths")  # one row for each length; what follows reads it several times
    by = by.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("bin", F.floor(F.col("n_tokens") / BIN))
    bins = by.groupBy("bin").agg(F.sum("docs").alias("bin_docs"), F.sum("tokens").alias("bin_tokens"))
    # A row for each bin of lengths: few at any size of corpus.
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = lambda x: F.coalesce(x, F.lit(0))
    bins = bins.select(
        "bin", none(F.sum("bin_docs").over(above)).alias("docs_above"), none(F.sum("bin_tokens").over(above)).alias("tokens_above"), none(F.sum("bin_docs").over(below)).alias("docs_below"), F.sum("bin_tokens").over(all_).alias("total")
    )
    down = Window.partitionBy("bin").orderBy(F.desc("n_tokens"))
    up = Window.partitionBy("bin").orderBy("n_tokens")
    out = by.join(bins, "bin").select(
        "n_tokens", "docs", "tokens", (F.sum("docs").over(down) + F.col("docs_above")).alias("docs_at_least"), (F.sum("tokens").over(down) + F.col("tokens_above")).alias("tokens_at_least"), (F.sum("docs").over(up) + F.col("docs_below")).alias("docs_up_to"), "total"
    )
    kept = F.col("total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select("n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", kept.alias("truncated_total"), (F.col("total") - kept).alias("cut_tokens"), "docs_up_to")


def _answers(row: DataFrame, asked: list, names: str, kinds: str) -> DataFrame:
    """One row of many columns as one row for each question; no join is needed."""
    columns = ", ".join(f"CAST({x} AS {kinds}), {', '.join(f'{n}{k}' for n in ('a', 'b'))}" for k, x in enumerate(asked))
    return row.selectExpr(f"stack({len(asked)}, {columns}) AS ({names})")


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut) for any limits, from the histogram alone.

    One pass over the histogram answers all of them; an empty one gives zeros, and no limits no rows.
    """
    limits = sorted({int(x) for x in limits})
    if not limits:
        return hist.sparkSession.createDataFrame([], "context_limit long, truncated_total long, docs_cut long")
    sums = []
    for k, x in enumerate(limits):
        sums.append(F.coalesce(F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(x))), F.lit(0)).cast("long").alias(f"a{k}"))
        sums.append(F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("docs"))), F.lit(0)).cast("long").alias(f"b{k}"))
    return _answers(hist.agg(*sums), limits, "context_limit, truncated_total, docs_cut", "BIGINT")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents don't exceed; null without documents."""
    shares = sorted({float(x) for x in shares})
    if not shares:
        return hist.sparkSession.createDataFrame([], "share double, n_tokens long")
    n = hist.agg(F.sum("docs").alias("n")).first()["n"] or 0
    least = [F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(x) * F.lit(n)), F.col("n_tokens"))) for x in shares]
    row = hist.agg(*[c for k, x in enumerate(least) for c in (x.alias(f"a{k}"), F.lit(None).alias(f"b{k}"))])
    return _answers(row, shares, "share, n_tokens, _none", "DOUBLE").drop("_none")
