"""Greedy one-to-one matching and priority cascades."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import fresh
from .stash import discard, stash
from .unions import union_all


def greedy_match(pairs: DataFrame, left: list[str], right: list[str], order: list[Column], rest: int = 200_000) -> DataFrame:
    """The pairs that sequential greedy matching accepts, with all their columns.

    Sequential greedy takes pairs in ``order`` and drops every other pair of their
    left or right node.  In each round here, the pairs that come first for both of
    their nodes are taken and all pairs of these nodes go; under a strict total
    order the result is the same.  ``order`` must leave no ties among pairs that
    differ in a node; repeated pairs of the same nodes count once.

    Each round is written to the shared folder, so the plan does not grow.  A hot
    node costs a min() over its pairs, combined before the shuffle.  Every round
    takes at least the first pair of all, and as soon as no more than ``rest`` pairs
    are left, one task goes through these in order.

    Rows with a null in a key of a node match nothing and go.  ``pairs`` may have
    columns of any names.
    """
    b = fresh(pairs)
    rank, best_l, best_r = b + "rank", b + "left", b + "right"
    columns = [F.col(f"`{c}`") for c in pairs.columns]
    known = reduce(lambda x, y: x & y, (F.col(f"`{c}`").isNotNull() for c in left + right))
    now = stash(pairs.filter(known).withColumn(rank, F.struct(*[F.when(F.lit(True), o) for o in order])), "match")
    found: list[DataFrame] = []
    while (n := now.count()) > rest:
        seen = now.join(now.groupBy(*left).agg(F.min(rank).alias(best_l)), left).join(now.groupBy(*right).agg(F.min(rank).alias(best_r)), right)
        won = stash(seen.filter((F.col(rank) == F.col(best_l)) & (F.col(rank) == F.col(best_r))).select(*columns).dropDuplicates(left + right), "won")
        found.append(won)
        after = stash(now.join(won.select(*left).distinct(), left, "left_anti").join(won.select(*right).distinct(), right, "left_anti"), "match")
        discard(now)
        now = after
    if n:
        found.append(stash(_in_order(now, left, right, rank).select(*columns), "won"))
    discard(now)
    return union_all(found) if found else pairs.filter(F.lit(False))


def _in_order(pairs: DataFrame, left: list[str], right: list[str], rank: str) -> DataFrame:
    """Sequential greedy matching of a bounded number of pairs in one task, which sorts them and holds the nodes taken."""
    key = lambda names: F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))
    named = pairs.select(key(left).alias("l"), key(right).alias("r"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(pairs.columns)])
    ordered = named.repartition(1).sortWithinPartitions(f"c{pairs.columns.index(rank)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken_l, taken_r = set(), set()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                free = x not in taken_l and y not in taken_r
                keep.append(free)
                if free:
                    taken_l.add(x)
                    taken_r.add(y)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, named.schema).drop("l", "r").toDF(*pairs.columns)


def cascade(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """For each key the rows of its best (least) rank: what a chain of anti-joins by level would keep, in one pass.

    Nulls are a key like any other, and rows of a null rank go.
    """
    return _at_best(rows, keys, rank, F.min)


def ties_at_max(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """For each key all rows that have its greatest value; rows whose value is null go."""
    return _at_best(rows.filter(value.isNotNull()), keys, value, F.max)


def _at_best(rows: DataFrame, keys: list[str], value: Column, best: Callable) -> DataFrame:
    b = fresh(rows)
    own, top = b + "own", b + "top"
    marked = rows.withColumn(own, value).withColumn(top, best(own).over(Window.partitionBy(*keys)))
    return marked.filter(F.col(own) == F.col(top)).drop(own, top)
