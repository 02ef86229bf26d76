"""Unions that promise no partitioning, and names that no frame uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apart(rows: DataFrame) -> DataFrame:
    """The same rows, without what the planner knows of their partitioning.

    Spark 4.1 zips the children of a union that are partitioned alike, and fails
    where adaptive execution has coalesced these children to different numbers of
    partitions.  A child that has passed through a generator has no partitioning to zip by.
    """
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("_row")).select("_row.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames of the same columns, by name."""
    return reduce(lambda a, b: a.unionByName(apart(b)), frames)


def fresh(*frames: DataFrame) -> str:
    """A column prefix that no frame uses."""
    taken = {c for f in frames for c in f.columns}
    name = "_bin"
    while any(c.startswith(name) for c in taken):
        name = "_" + name
    return name


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with these columns, each computed once for a row.

    Catalyst copies the expression of a plain column into every later one, and every
    filter, that names it, which for a parsed CIGAR or a list of qualities is most of
    the work; it copies nothing through a generator.
    """
    x = fresh(rows)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    made = rows.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(x))
    return made.select(*kept, *[F.col(f"{x}.`{n}`").alias(n) for n in columns])
