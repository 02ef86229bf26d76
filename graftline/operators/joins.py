"""Range joins by bins, and nearest-neighbour joins by windows.

Spark plans a join without an equality as a nested loop.  Here every range join
has a bin of the position in its key, so it is an equi-join that Catalyst can hash
or sort, and a long contig is spread over many keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .unions import apart, fresh


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, below: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys and ``left_pos - below <= right_pos < left_pos``.

    Bins are ``below`` wide, so a left row meets exactly two of them and a right
    row one; no pair comes twice.  The frames share no other column names.
    """
    b = fresh(left, right)
    bin_of = lambda c: F.floor(F.col(c) / F.lit(below)).cast("long")
    left = left.withColumn(b, F.explode(F.array(bin_of(left_pos), bin_of(left_pos) - 1)))
    right = right.withColumn(b, bin_of(right_pos))
    pairs = left.join(right, [*keys, b], how).filter((F.col(right_pos) < F.col(left_pos)) & (F.col(right_pos) >= F.col(left_pos) - below))
    return pairs.drop(b)


def dealt_join(rows: DataFrame, few: DataFrame, keys: list[str], by: list[str], shares: int = 64) -> DataFrame:
    """``rows.join(few, keys)`` where a few keys may hold most rows.

    A key's rows are dealt to ``shares`` by their values of ``by``, and ``few``, whose
    rows are copied to all shares, is met there: no task gets a whole key.
    """
    s = fresh(rows, few)
    dealt = rows.withColumn(s, F.pmod(F.xxhash64(*by), F.lit(shares)).cast("int"))
    return dealt.join(few.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), [*keys, s]).drop(s)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 1024, levels: int = 0) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans [start, end) overlap.

    Both sides are dealt to the bins they cover, and a pair stands in the bin of the
    later start alone, so it comes once.  Empty spans overlap nothing.

    Where spans can be far longer than ``width``, further ``levels`` of bins, each
    eight times as wide as the one below, keep a span from making a row for every
    ``width`` positions: a span's own level is the first whose bins are as long as it
    is, it is dealt to this and the wider ones, and a pair meets at the higher of
    its two levels alone: wider copies of a row meet only rows whose own level that is.
    A row then makes at most ``levels`` + 2 rows, or one more for each of the widest
    bins that it covers.
    """
    b = fresh(left, right)
    ls, le = left_span
    rs, re = right_span
    step, top = 8, levels
    at, side = b + "k", b + "m"

    def level(s: str, e: str) -> Column:
        if not top:
            return F.lit(0)
        length = (F.col(e) - F.col(s)).cast("double")
        return F.least(F.lit(top), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length, F.lit(1.0)) / width) / math.log(step) - 1e-12).cast("int"))).cast("int")

    size = F.element_at(F.array(*[F.lit(width * step**k).cast("long") for k in range(top + 1)]), F.col(at) + 1)

    def binned(df: DataFrame, s: str, e: str, own: str, met: Column) -> DataFrame:
        rows = df.filter(F.col(s) < F.col(e)).withColumn(own, level(s, e))
        rows = rows.withColumn(at, F.explode(F.sequence(F.col(own), F.lit(top)))).withColumn(side, F.explode(met))
        return rows.withColumn(own, F.floor(F.col(s) / size).cast("long")).withColumn(b, F.explode(F.sequence(F.col(own), F.floor((F.col(e) - 1) / size).cast("long"))))

    # Meeting 0: a right row at its own level; meeting 1: a left row at its own level and a right row of a lower one.
    lefts = binned(left, ls, le, b + "l", F.when((F.col(at) == F.col(b + "l")) & (F.col(at) > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rights = binned(right, rs, re, b + "r", F.array(F.when(F.col(at) == F.col(b + "r"), F.lit(0)).otherwise(F.lit(1))))
    pairs = lefts.join(rights, [*keys, at, side, b])
    pairs = pairs.filter((F.col(b) == F.greatest(b + "l", b + "r")) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    return pairs.drop(b, at, side, b + "l", b + "r")


def nearest_within(sites: DataFrame, keys: list[str], pos: str, is_5p: Column, is_3p: Column, distance: int, out_5p: str = "near_5p", out_3p: str = "near_3p", width: int | None = None) -> DataFrame:
    """``sites`` with two flags: a 3p site at most ``distance`` below, and a 5p site at most ``distance`` above, neither at the position itself.

    Equal to a strict nearest-neighbour search on both sides.  Windows run over
    bins of ``width`` positions; a site near a bin's edge is also read by the bin
    next to it, so one long contig does not end in one task.
    """
    width = width or max(64 * distance, 4096)
    b = fresh(sites)
    own = F.floor(F.col(pos) / width).cast("long")
    at = F.col(pos) - own * width
    bins = F.array_compact(F.array(own, F.when(at < distance, own - 1), F.when(at >= width - distance, own + 1)))
    halo = sites.withColumn(b + "5", is_5p).withColumn(b + "3", is_3p).withColumn(b + "own", own).withColumn(b, F.explode(bins))
    order = Window.partitionBy(*keys, b).orderBy(F.col(pos).cast("long"))
    below = F.max(F.when(F.col(b + "3"), F.lit(1))).over(order.rangeBetween(-distance, -1))
    above = F.max(F.when(F.col(b + "5"), F.lit(1))).over(order.rangeBetween(1, distance))
    out = halo.withColumn(out_5p, below.isNotNull()).withColumn(out_3p, above.isNotNull())
    return out.filter(F.col(b) == F.col(b + "own")).drop(b, b + "own", b + "5", b + "3")


def filter_by_mate(sites: DataFrame, keys: list[str], pos: str, keep_5p: str, keep_3p: str, has_5p: Column, has_3p: Column, distance: int) -> DataFrame:
    """Switch off the keep flags of sites without a mate within the distance; the positions are frozen before."""
    out = nearest_within(sites, keys, pos, has_5p, has_3p, distance, "_near_5p", "_near_3p")
    return out.withColumn(keep_5p, F.col(keep_5p) & F.col("_near_5p")).withColumn(keep_3p, F.col(keep_3p) & F.col("_near_3p")).drop("_near_5p", "_near_3p")


def asof(probe: DataFrame, build: DataFrame, keys: list[str], probe_pos: str, build_pos: str, values: list[str], direction: str = "backward", tie: str | None = None) -> DataFrame:
    """Each probe row with the build row of the greatest position strictly below (or the smallest strictly above).

    Both sides are dealt to ranges of key and position and the nearest build row is
    carried along (``scan.carried_last``); no pair is made, and a key with very many
    rows is many tasks.  Of build rows at one position the one with the greatest
    ``tie`` stands (by all values, if none is named).  Unmatched probes get nulls.
    ``values`` are build columns whose names probe does not use.
    """
    name = fresh(probe, build)
    side, held, at, row, near = (name + x for x in ("side", "held", "at", "row", "near"))
    best = build.groupBy(*keys, F.col(build_pos).alias(at)).agg(F.max_by(F.struct(build_pos, *values), F.struct(*([tie] if tie else []), *values)).alias(held))
    left = probe.select(*keys, F.col(probe_pos).alias(at), F.lit(0).alias(side), F.struct(*probe.columns).alias(row))
    right = best.select(*keys, at, F.lit(1).alias(side), held)
    both = left.unionByName(apart(right), allowMissingColumns=True)
    # At one position probes come before build rows, so that only strictly nearer ones count.
    order = F.asc(at) if direction == "backward" else F.desc(at)
    ends = "max_by" if direction == "backward" else "min_by"
    found = scan.carried_last(both, keys, [order, F.asc(side)], ends, at, held, near).filter(F.col(side) == 0)
    return found.select(f"{row}.*", *[F.col(f"{near}.{c}").alias(c) for c in (build_pos, *values)])
