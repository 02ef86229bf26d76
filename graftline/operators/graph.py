"""Connected components by alternating stars, and greedy covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import discard, stash
from .unions import union_all


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the smallest of u and its neighbours."""
    both = union_all([edges, edges.select(F.col("v").alias("u"), F.col("u").alias("v"))])
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return union_all([moved, least.select("u", F.col("m").alias("v"))]).filter("u <> v").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable.

    ``edges`` has columns u and v of one orderable type; ``nodes`` (column node)
    adds nodes without edges.  Only two figures of a round reach the driver.
    """
    now = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    digest = None
    for _ in range(rounds):
        after = stash(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == digest or not seen["n"]:
            break
        digest = (seen["n"], seen["s"])
    else:
        raise RuntimeError("components did not converge")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = union_all([found, found.select(F.col("component").alias("node"), "component").distinct()])
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def greedy_cover(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, rep): each node's representative under greedy clustering in order of ``rank``.

    In order of rank (least first), a node joins the first representative it has an
    edge to, or becomes one.  A node is settled as a representative once every
    neighbour before it is settled and none of these is a representative.
    ``nodes``: node, rank (a total order); ``edges``: u, v, each pair once.
    """
    both = union_all([edges.select("u", "v"), edges.select(F.col("v").alias("u"), F.col("u").alias("v"))]).filter("u <> v").distinct()
    a = nodes.select(F.col("node").alias("u"), F.col("rank").alias("ru"))
    b = nodes.select(F.col("node").alias("v"), F.col("rank").alias("rv"))
    # v stands before u.
    before = stash(both.join(a, "u").join(b, "v").filter("rv < ru").select("u", "v", "rv"), "before")
    state = stash(nodes.select("node", F.lit(None).cast("boolean").alias("is_rep")), "state")
    for _ in range(rounds):
        open_ = state.filter("is_rep is null").select(F.col("node").alias("u"))
        if open_.isEmpty():
            break
        known = before.join(open_, "u").join(state.withColumnRenamed("node", "v"), "v")
        seen = known.groupBy("u").agg(F.max(F.coalesce("is_rep", F.lit(False))).alias("has_rep"), F.max(F.col("is_rep").isNull()).alias("waits"))
        verdict = open_.join(seen, "u", "left").select(F.col("u").alias("node"), F.when(F.coalesce("has_rep", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True).alias("verdict"))
        after = stash(state.join(verdict, "node", "left").select("node", F.coalesce("is_rep", "verdict").alias("is_rep")), "state")
        discard(state)
        state = after
    else:
        raise RuntimeError("greedy clustering did not end")
    reps = state.filter("is_rep").select(F.col("node").alias("v"))
    joined = before.join(reps, "v").groupBy("u").agg(F.min_by("v", "rv").alias("rep"))
    return state.join(joined, state.node == joined.u, "left").select("node", F.when(F.col("is_rep"), F.col("node")).otherwise(F.col("rep")).alias("rep"))
