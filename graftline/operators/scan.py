"""Segmented scans: running sums and carried values along an order, one key over many tasks.

Rows are dealt to ranges of (key, order).  Within a range a window runs by key; what
a key's earlier ranges add up to, or last held, is found from one row for each
range and key, and only keys that go over a border have such a carry: at most one
for each border.  So a key with a large share of all rows, or a table without any key,
is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stash import stash
from .unions import fresh


def _ranged(rows: DataFrame, keys: list[str], order: list[Column], part: str) -> DataFrame:
    """The rows in ranges of (keys, order), numbered in that order; written, so that a row's range is fixed."""
    places = [F.asc(k) for k in keys] + order
    return stash(rows.repartitionByRange(*places).withColumn(part, F.spark_partition_id()), "ranges")


def _carried(parts: DataFrame, rows: DataFrame, keys: list[str], part: str, carry: str) -> DataFrame:
    """``rows`` with the carries of ``parts``, of which there are at most as many as borders between ranges."""
    some = parts.filter(F.col(carry).isNotNull()).select(F.col(part).alias(f"{part}_"), *[F.col(k).alias(f"{part}_{i}") for i, k in enumerate(keys)], carry)
    same = F.col(part) == F.col(f"{part}_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{part}_{i}"))
    return rows.join(F.broadcast(some), same, "left").drop(f"{part}_", *[f"{part}_{i}" for i in range(len(keys))])


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` from its key's first row up to itself, in order (total within a key).

    Null values count nothing; a key's leading nulls have 0.
    """
    name = fresh(rows)
    part, carry = name + "part", name + "carry"
    ranged = _ranged(rows, keys, [F.asc(c) for c in order], part)
    sums = ranged.groupBy(part, *keys).agg(F.sum(value).alias(name))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    if not keys:  # as many rows as there are ranges
        before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    found = _carried(sums.withColumn(carry, F.sum(name).over(before)), ranged, keys, part, carry)
    here = F.sum(value).over(Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn(out, F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))).drop(part, carry)


def carried_last(rows: DataFrame, keys: list[str], order: list[Column], ends: str, by: str, value: str, out: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null strictly before them, in the order of their key.

    Of the rows with a value the last one of a range is that of the greatest (``ends``
    ``max_by``) or the smallest (``min_by``) ``by``, which must differ between a key's rows with a value.
    """
    name = fresh(rows)
    part, carry = name + "part", name + "carry"
    ranged = _ranged(rows, keys, order, part)
    ends = ranged.groupBy(part, *keys).agg(getattr(F, ends)(value, F.when(F.col(value).isNotNull(), F.col(by))).alias(name))
    before = Window.partitionBy(*keys).orderBy(part) if keys else Window.orderBy(part)
    carries = ends.withColumn(carry, F.last(name, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    found = _carried(carries, ranged, keys, part, carry)
    here = F.last(value, ignorenulls=True).over(Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn(out, F.coalesce(here, F.col(carry))).drop(part, carry)
