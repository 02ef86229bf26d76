"""Flank pairing: candidates, inverted repeats, matching, junction filter and direct repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import sequence as sq
from ..operators import joins, matching
from ..operators.consensus import ordered_concat, positional_consensus
from ..operators.stash import stash
from ..params import PairFlanks
from ..schemas import PAIRS

PAIR = ["sample", "contig", "pos_5p", "pos_3p"]


def candidate_pairs(flanks: DataFrame, p: PairFlanks = PairFlanks()) -> DataFrame:
    """5p and 3p flanks of a contig with ``pos_5p - max_direct_repeat_length - 1 <= pos_3p < pos_5p``."""

    def side(o: str) -> DataFrame:
        return flanks.filter(F.col("orient") == o).select("sample", "contig", F.col("flank_id").alias(f"flank_{o}"), F.col("pos").alias(f"pos_{o}"), F.col("consensus_softclip_count").alias(f"softclip_count_{o}"), F.col("total_count").alias(f"total_count_{o}"), F.col("consensus_seq").alias(f"seq_{o}"))

    return joins.band_join(side("5p"), side("3p"), ["sample", "contig"], "pos_5p", "pos_3p", p.max_direct_repeat_length + 1)


def with_inverted_repeats(pairs: DataFrame, p: PairFlanks = PairFlanks()) -> DataFrame:
    """Pairs with the inverted repeat of their insertion ends; written once, so that the search runs once."""
    n = p.truncated_flank_length
    found = pairs.withColumn("_ir", sq.inverted_repeats(sq.truncate("seq_5p", n, "5p"), sq.truncate("seq_3p", n, "3p"), p.ir_distance_from_end))
    out = found.withColumn("IR_5p", F.col("_ir.IR_5p")).withColumn("IR_3p", F.col("_ir.IR_3p")).drop("_ir")
    return stash(out.withColumn("has_IR", F.col("IR_5p").isNotNull()).withColumn("IR_length", F.coalesce(F.length("IR_5p"), F.lit(0))), "repeats")


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs: longest inverted repeat, then least difference of counts, then of lengths, then by place."""
    order = [-F.col("IR_length"), F.abs(F.col("softclip_count_5p") - F.col("softclip_count_3p")), F.abs(F.length("seq_5p") - F.length("seq_3p")), F.col("sample"), F.col("contig"), F.col("pos_5p"), F.col("pos_3p"), F.col("flank_5p"), F.col("flank_3p")]
    return matching.greedy_match(pairs, ["sample", "flank_5p"], ["sample", "flank_3p"], order)


def spanning_counts(pairs: DataFrame, alignments: DataFrame, p: PairFlanks = PairFlanks()) -> DataFrame:
    """Pairs with the distinct names of reads that run through the whole junction without a large insertion."""
    rows = alignments.filter(~F.coalesce("is_unmapped", F.lit(False))).filter(cg.passes_read_filters(p.min_alignment_quality, p.min_alignment_inner_length))
    reads = rows.select("sample", "contig", "read_name", "ref_start", "ref_end", cg.blocks("cigar", "ref_start").alias("blocks"))
    at = pairs.select(*PAIR).distinct().withColumn("_from", F.greatest(F.col("pos_3p") - 1, F.lit(0))).withColumn("_to", F.col("pos_5p") + 2)
    near = joins.interval_join(at, reads, ["sample", "contig"], ("_from", "_to"), ("ref_start", "ref_end"))
    k = p.insertion_spanning_length
    through = near.filter((F.col("ref_start") < F.col("pos_3p") - k) & (F.col("ref_end") > F.col("pos_5p") + k + 1))
    through = through.filter(~(cg.large_insertion_at("blocks", "pos_3p", p.large_insertion_cutoff) | cg.large_insertion_at("blocks", "pos_5p", p.large_insertion_cutoff)))
    n = through.groupBy(*PAIR).agg(F.countDistinct("read_name").alias("spanning_count"))
    return pairs.join(n, PAIR, "left").withColumn("spanning_count", F.coalesce("spanning_count", F.lit(0)))


def junction_filter(pairs: DataFrame, p: PairFlanks = PairFlanks()) -> DataFrame:
    mean = (F.col("total_count_5p") + F.col("total_count_3p")) / 2
    return pairs.filter(F.try_divide(F.col("spanning_count").cast("double"), mean) < p.max_junction_spanning_prop)


def region_consensus(regions: DataFrame, alignments: DataFrame, genome: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, out): the consensus of reads and reference over each region [start, end) of a contig.

    At each position base qualities are summed, the reference base weighs 1 and
    wins ties.  Positions off the contig are left out, so that nothing is misplaced.
    """
    ref = regions.join(genome.select(F.col("name").alias("contig"), "seq"), "contig").withColumn("_s", F.greatest("start", F.lit(0))).withColumn("_e", F.least("end", F.length("seq"))).filter("_s < _e")
    ref = ref.select(*keys, "contig", "_s", "_e", F.upper(sq.slice_seq("seq", F.col("_s"), F.col("_e"))).alias("_r"))
    seed = ref.select(*keys, F.posexplode(F.split("_r", "")).alias("_i", "base"), "_s").filter("base <> ''").select(*keys, (F.col("_s") + F.col("_i")).cast("int").alias("pos"), "base")
    # A row for each aligned block, with no more than its own bases and qualities: a region's edge is at a place of the block.
    reads = alignments.filter(~F.coalesce("is_unmapped", F.lit(False))).select("sample", "contig", "seq", "quals", F.explode(cg.aligned_blocks("cigar", "ref_start")).alias("_b"))
    size = F.col("_b.end") - F.col("_b.start")
    blocks = reads.select("sample", "contig", F.col("_b.start").alias("_from"), F.col("_b.end").alias("_to"), F.substring("seq", F.col("_b.at") + 1, size).alias("_seq"), F.slice("quals", F.col("_b.at") + 1, size).cast("array<smallint>").alias("_quals"))
    shared = ["sample", "contig"] if "sample" in keys else ["contig"]
    near = joins.interval_join(ref.select(*dict.fromkeys([*keys, "contig"]), "_s", "_e"), blocks if "sample" in keys else blocks.drop("sample"), shared, ("_s", "_e"), ("_from", "_to"))
    at = near.select(*keys, "_from", "_seq", "_quals", F.explode(F.sequence(F.greatest("_s", "_from"), F.least("_e", "_to") - 1)).alias("pos"))
    place = (F.col("pos") - F.col("_from")).cast("int")
    bases = at.select(*keys, F.col("pos").cast("int").alias("pos"), F.upper(F.substring("_seq", place + 1, F.lit(1))).alias("base"), F.get("_quals", place).alias("weight"))
    return ordered_concat(positional_consensus(bases, keys, "pos", "base", "weight", seed), keys, "pos", "base", out)


def direct_repeats(pairs: DataFrame, alignments: DataFrame, genome: DataFrame, p: PairFlanks = PairFlanks()) -> DataFrame:
    """Pairs with the direct repeat of the reference and of the reads' consensus around it."""
    places = pairs.select(*PAIR).distinct()
    half = p.target_region_size // 2
    centre = sq.window_centre("pos_5p", "pos_3p").cast("int")
    windows = places.withColumn("start", centre - half).withColumn("end", centre + half)
    text = region_consensus(windows, alignments, genome, PAIR, "_region")
    from_start = F.greatest(F.bround((F.col("pos_5p") + F.col("pos_3p")) / 2).cast("int") - half, F.lit(0))
    reads = text.select(*PAIR, sq.slice_seq("_region", F.col("pos_3p") + 1 - from_start, F.col("pos_5p") - from_start).alias("direct_repeat_reads_consensus"))
    ref = places.join(genome.select(F.col("name").alias("contig"), "seq"), "contig").select(*PAIR, sq.slice_seq("seq", F.col("pos_3p") + 1, F.col("pos_5p")).alias("direct_repeat_reference"))
    return pairs.join(ref, PAIR, "left").join(reads, PAIR, "left")


def pair_flanks(flanks: DataFrame, alignments: DataFrame, genome: DataFrame, p: PairFlanks = PairFlanks()) -> DataFrame:
    """The pairs table of ``schemas.PAIRS``; empty in, empty out."""
    matched = assign(with_inverted_repeats(candidate_pairs(flanks, p), p))
    kept = junction_filter(spanning_counts(matched, alignments, p), p)
    full = direct_repeats(kept, alignments, genome, p)
    number = Window.partitionBy("sample").orderBy("contig", "pos_5p", "pos_3p")
    return full.withColumn("pair_id", F.row_number().over(number)).select([F.col(f.name).cast(f.dataType) for f in PAIRS])
