"""CIGAR and clip functions over ``array<struct<op,len>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col

_KIND = "array<struct<op:string,len:int>>"


def parse_cigar(text: Column | str) -> Column:
    """A CIGAR string as an array; ``*`` and null give an empty one."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("(\\d+[MIDNSHP=X])"), 1)
    return F.transform(found, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"))).cast(_KIND)


def _sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, x: a + F.when(F.lit(ops).contains(x["op"]), x["len"]).otherwise(0))


def reference_length(cigar: Column | str) -> Column:
    return _sum(col(cigar), "MDN=X")


def query_aligned_length(cigar: Column | str) -> Column:
    """Query bases between the clips."""
    return _sum(col(cigar), "MI=X")


def _end(cigar: Column, side: str) -> Column:
    return F.try_element_at(cigar, F.lit(1 if side == "left" else -1))


def strictly_clipped(cigar: Column | str, side: str) -> Column:
    return F.coalesce(_end(col(cigar), side)["op"] == "S", F.lit(False))


def terminal_mismatch(md: Column | str, side: str) -> Column:
    """Whether the first, or last, aligned base mismatches."""
    md = col(md)
    return F.coalesce(md.rlike("^0[A-Za-z]") if side == "left" else md.rlike("[^0-9]0$"), F.lit(False))


def leniently_clipped(cigar: Column | str, md: Column | str, side: str) -> Column:
    return strictly_clipped(cigar, side) | terminal_mismatch(md, side)


def strict_length(cigar: Column | str, side: str) -> Column:
    return F.when(strictly_clipped(cigar, side), _end(col(cigar), side)["len"]).otherwise(0)


def lenient_length(cigar: Column | str, md: Column | str, side: str) -> Column:
    """Clipped bases; a terminal mismatch counts one."""
    return F.when(strictly_clipped(cigar, side), _end(col(cigar), side)["len"]).when(terminal_mismatch(md, side), 1).otherwise(0)


def terminal_op_length(cigar: Column | str, side: str) -> Column:
    """Length of the terminal operation, whatever it is."""
    return _end(col(cigar), side)["len"]


def clip_site(cigar: Column | str, md: Column | str, start: Column | str, end: Column | str, side: str) -> Column:
    """The position a clip is counted at: next to the alignment, or the mismatching base itself."""
    start, end = col(start), col(end)
    if side == "left":
        return F.when(strictly_clipped(cigar, side), start - 1).when(terminal_mismatch(md, side), start)
    return F.when(strictly_clipped(cigar, side), end).when(terminal_mismatch(md, side), end - 1)


def clipped_seq(seq: Column | str, n: Column, side: str) -> Column:
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(col(seq), F.lit(1), n) if side == "left" else F.substring(col(seq), -n, n))


def clipped_quals(quals: Column | str, n: Column, side: str) -> Column:
    quals = col(quals)
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.slice(quals, F.lit(1), n) if side == "left" else F.slice(quals, F.size(quals) - n + 1, n))


def clip_proportion(cigar: Column | str, seq: Column | str, side: str) -> Column:
    return F.try_divide(strict_length(cigar, side).cast("double"), F.length(col(seq)))


def inner_length(seq: Column | str, cigar: Column | str, md: Column | str) -> Column:
    return F.length(col(seq)) - lenient_length(cigar, md, "left") - lenient_length(cigar, md, "right")


def passes_read_filters(min_quality: int, min_inner: int) -> Column:
    """Mapping quality, and for reads clipped at both ends the length between the clips."""
    both = leniently_clipped("cigar", "md", "left") & leniently_clipped("cigar", "md", "right")
    return (F.col("mapq") >= min_quality) & ~(both & (inner_length("seq", "cigar", "md") < min_inner))


def blocks(cigar: Column | str, start: Column | str) -> Column:
    """Aligned blocks array<struct<start,end,gap,inserted>>, in order.

    ``gap`` counts the reference bases deleted and ``inserted`` the query bases
    inserted before the block.  M, = and X runs that touch are one block.
    """
    begin = F.struct(col(start).cast("int").alias("at"), F.lit(0).alias("gap"), F.lit(0).alias("ins"), F.array().cast("array<struct<start:int,end:int,gap:int,inserted:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        is_match, is_gap, is_ins = x["op"].isin("M", "=", "X"), x["op"].isin("D", "N"), x["op"] == "I"
        last = F.try_element_at(a["out"], F.lit(-1))
        joins = is_match & (a["gap"] == 0) & (a["ins"] == 0) & (F.size(a["out"]) > 0)
        grown = F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (last["end"] + x["len"]).alias("end"), last["gap"].alias("gap"), last["inserted"].alias("inserted"))))
        added = F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + x["len"]).alias("end"), F.when(F.size(a["out"]) == 0, 0).otherwise(a["gap"]).alias("gap"), F.when(F.size(a["out"]) == 0, 0).otherwise(a["ins"]).alias("inserted"))))
        return F.struct(
            (a["at"] + F.when(is_match | is_gap, x["len"]).otherwise(0)).alias("at"),
            F.when(is_match, 0).when(is_gap, a["gap"] + x["len"]).otherwise(a["gap"]).alias("gap"),
            F.when(is_match, 0).when(is_ins, a["ins"] + x["len"]).otherwise(a["ins"]).alias("ins"),
            F.when(joins, grown).when(is_match, added).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(col(cigar), begin, step, lambda a: a["out"])


def site_evidence(blocks_col: Column | str, pos: Column | str, large: int) -> Column:
    """What an unclipped read says of a position: one of the six kinds, or null.

    By priority: an insertion that starts right at the position (5p) or right after
    it (3p), small before large; a deletion over it; an aligned base on it.
    """
    b, pos = col(blocks_col), col(pos)
    touching = lambda x: (x["gap"] == 0) & (x["inserted"] > 0)
    at_5p = lambda x: touching(x) & (x["start"] == pos)
    at_3p = lambda x: touching(x) & (x["start"] - 1 == pos)
    return (
        F.when(F.exists(b, lambda x: at_5p(x) & (x["inserted"] < large)), "small_insertion_5p")
        .when(F.exists(b, lambda x: at_3p(x) & (x["inserted"] < large)), "small_insertion_3p")
        .when(F.exists(b, lambda x: at_5p(x) & (x["inserted"] >= large)), "large_insertion_5p")
        .when(F.exists(b, lambda x: at_3p(x) & (x["inserted"] >= large)), "large_insertion_3p")
        .when(F.exists(b, lambda x: (x["gap"] > 0) & (pos >= x["start"] - x["gap"]) & (pos < x["start"])), "deletion")
        .when(F.exists(b, lambda x: (pos >= x["start"]) & (pos < x["end"])), "runthrough")
    )


def large_insertion_at(blocks_col: Column | str, pos: Column | str, large: int) -> Column:
    """Whether the read has a large insertion beside the position."""
    b, pos = col(blocks_col), col(pos)
    return F.exists(b, lambda x: (x["gap"] == 0) & (x["inserted"] >= large) & ((x["start"] == pos) | (x["start"] - 1 == pos)))


def aligned_bases(cigar: Column | str, start: Column | str) -> Column:
    """array<struct<pos,at>> of every aligned base: reference position and place in the query."""
    begin = F.struct(col(start).cast("int").alias("pos"), F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,at:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        is_match = x["op"].isin("M", "=", "X")
        run = F.transform(F.sequence(F.lit(0), F.greatest(x["len"] - 1, F.lit(0))), lambda k: F.struct((a["pos"] + k).cast("int").alias("pos"), (a["at"] + k).cast("int").alias("at")))
        return F.struct(
            (a["pos"] + F.when(is_match | x["op"].isin("D", "N"), x["len"]).otherwise(0)).alias("pos"),
            (a["at"] + F.when(is_match | x["op"].isin("I", "S"), x["len"]).otherwise(0)).alias("at"),
            F.when(is_match & (x["len"] > 0), F.concat(a["out"], run)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(col(cigar), begin, step, lambda a: a["out"])


def aligned_blocks(cigar: Column | str, start: Column | str) -> Column:
    """array<struct<start,end,at>> of every run of aligned bases: reference span, and the place of its first base in the query."""
    begin = F.struct(col(start).cast("int").alias("pos"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,at:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        is_match = x["op"].isin("M", "=", "X")
        run = F.array(F.struct(a["pos"].alias("start"), (a["pos"] + x["len"]).alias("end"), a["at"].alias("at")))
        return F.struct(
            (a["pos"] + F.when(is_match | x["op"].isin("D", "N"), x["len"]).otherwise(0)).alias("pos"),
            (a["at"] + F.when(is_match | x["op"].isin("I", "S"), x["len"]).otherwise(0)).alias("at"),
            F.when(is_match & (x["len"] > 0), F.concat(a["out"], run)).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(col(cigar), begin, step, lambda a: a["out"])
